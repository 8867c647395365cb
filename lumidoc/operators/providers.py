"""Model providers behind plain functions, with deterministic stand-ins: encoders, readers, word analysers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring as S

DIM = 64


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """A unit vector of hashed character 3-grams: a stand-in encoder that every engine can repeat."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    grams = S.let(padded, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 2)), lambda i: F.substring(t, i, F.lit(3))))
    buckets = F.transform(grams, lambda g: F.pmod(F.conv(F.substring(F.md5(g.cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(dim)))
    counts = S.let(buckets, lambda bs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(bs, lambda x: x == b)).cast("double")))
    return S.unit(counts)


def hash_vectors(docs: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, vec, norm): hash_embedding of whole long texts, by counting; norm is the counts' length.

    3-grams become rows that are counted by document and bucket before the shuffle, so that holds at most `dim`
    rows for a document and task, however long the text.
    """
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))
    # substring() walks a text from its start each time: single characters, taken apart once, don't
    grams = S.let(F.filter(F.split(padded, ""), lambda c: c != ""), lambda cs: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(cs) - 3)), lambda i: F.concat(F.get(cs, i), F.coalesce(F.get(cs, i + 1), F.lit("")), F.coalesce(F.get(cs, i + 2), F.lit("")))))
    rows = docs.select(key, F.explode(grams).alias("gram"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("gram").cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(dim))
    counts = rows.groupBy(key, bucket.alias("b")).agg(F.count("*").cast("double").alias("n"))
    whole = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return whole.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)) / F.col("norm")).alias("vec"), "norm")


def encoder(encode: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Callable[[Column], Column]:
    """A provider of vectors as a column function: texts go through in Arrow batches, `batch` at a time."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.fillna("").tolist()
            out = [v for k in range(0, len(values), batch) for v in encode(values[k : k + batch])]
            yield pd.Series(out)

    return run


def encode_once(rows: DataFrame, text: str, encode: Callable[[Column], Column], cache: DataFrame | None = None) -> DataFrame:
    """rows with `vec`: different texts are encoded once, those in cache(text, vec) not at all, and zero vectors are null."""
    wanted = rows.select(F.col(text).alias("_t")).distinct()
    if cache is not None:
        known = cache.select(F.col("text").alias("_t"), "vec")
        missing = wanted.join(known, "_t", "left_anti").withColumn("vec", encode(F.col("_t")))
        vectors = wanted.join(known, "_t").unionByName(missing)
    else:
        vectors = wanted.withColumn("vec", encode(F.col("_t")))
    vectors = vectors.withColumn("vec", F.when(S.norm(F.col("vec")) > S.TINY, F.col("vec")))
    return rows.join(vectors, rows[text] == vectors["_t"], "left").drop("_t")


def routed(text: Column, providers: list[Callable[[Column], Column]], dim: int) -> Column:
    """The first provider's vector of the agreed dimension, else zeros."""
    tries = [F.when(F.size(p(text)) == dim, p(text)) for p in providers]
    return F.coalesce(*tries, F.array_repeat(F.lit(0.0), dim))


def entity_verdict(upos: Column, deprel: Column) -> Column:
    """Whether word classes and relations can make up an entity: some class and some relation (before a colon) must be one of an entity's."""
    classes = F.array(*[F.lit(x) for x in ("NOUN", "PROPN", "NUM", "SYM", "X")])
    relations = F.array(*[F.lit(x) for x in ("root", "nsubj", "obj", "obl", "nmod", "appos", "flat", "compound", "nummod", "conj", "dep")])
    base = F.transform(deprel, lambda d: F.substring_index(d, ":", 1))
    return F.arrays_overlap(upos, classes) & F.arrays_overlap(base, relations)


def keep_entity_lines(lines: DataFrame, page: str, verdict: str = "entity", ratio: str = "ratio", least: float = 0.20) -> DataFrame:
    """Lines that can be entities or have enough content words; all of a page's lines if none would stay."""
    from pyspark.sql import Window

    good = F.col(verdict) | (F.col(ratio) >= least)
    any_good = F.max(good).over(Window.partitionBy(page))
    return lines.withColumn("_any", any_good).where(good | ~F.col("_any")).drop("_any")
