"""Documents from files: whole texts, images and page texts by extension; models behind provider functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

TEXT_EXTENSIONS = ["txt", "md", "csv", "json"]


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def route(ext: Column) -> Column:
    """text, pdf or image."""
    return F.when(ext.isin(*TEXT_EXTENSIONS), "text").when(ext == "pdf", "pdf").otherwise("image")


def load(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, mode, text, content): whole UTF-8 texts; pdf pages by a provider; images as bytes.

    A pdf with enough of a text layer takes the text way, else the image way.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content").withColumn("mode", route(extension("path")))

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    texts = files.where("mode = 'text'").select("path", "mode", decoded("content").alias("text"), F.lit(None).cast("binary").alias("content"))
    images = files.where("mode = 'image'").select("path", "mode", F.lit(None).cast("string").alias("text"), "content")
    out = texts.unionByName(images)
    pdfs = files.where("mode = 'pdf'")
    if pages_of is None:
        return out.unionByName(pdfs.select("path", F.lit("image").alias("mode"), F.lit(None).cast("string").alias("text"), "content"))

    @F.pandas_udf("array<string>")
    def paged(content: pd.Series) -> pd.Series:
        return content.map(lambda b: pages_of(bytes(b)))

    read = pdfs.withColumn("pages", paged("content"))
    layer = has_text_layer(F.col("pages"))
    text = merged_text(F.col("pages"))
    way = layer & (F.length(text) >= 60)
    return out.unionByName(read.select("path", F.when(way, "text").otherwise("image").alias("mode"), F.when(way, text).alias("text"), F.when(~way, F.col("content")).alias("content")))


def page_has_text(page: Column) -> Column:
    return (F.length(X.trimmed(page)) >= 40) & (F.regexp_count(page, F.lit(r"[\p{L}\p{N}]")) >= 20)


def has_text_layer(pages: Column) -> Column:
    """At least half of the pages have a text layer."""
    return F.size(F.filter(pages, page_has_text)) * 2 >= F.size(pages)


def merged_text(pages: Column) -> Column:
    return F.array_join(F.filter(F.transform(pages, X.trimmed), lambda p: p != ""), "\n\n")


def fit_dpi(width_pt: Column, height_pt: Column, dpi: Column, longest: int = 4000, least: int = 72) -> Column:
    """The resolution at which the longer side has at most `longest` pixels."""
    side = F.greatest(width_pt, height_pt) / 72.0
    return F.greatest(F.lit(least), F.least(dpi, F.floor(longest / F.greatest(side, F.lit(1e-9))).cast("int")))


def page_budget(asked: Column) -> Column:
    return F.least(F.lit(512), F.greatest(F.lit(1), F.coalesce(asked, F.lit(32))))


def clean_record(fields: Column) -> Column:
    """A map without internal (`__`) and empty entries."""
    return F.map_filter(fields, lambda k, v: ~F.startswith(k, F.lit("__")) & v.isNotNull() & (v != ""))


def save_results(records: DataFrame, path: str) -> None:
    """Results as JSON lines, one file set, overwritten."""
    records.write.mode("overwrite").json(path)


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    """A dictionary cut off in the middle, up to its last whole top-level entry; null if there is none."""

    def one(s: str | None) -> str | None:
        depth, inside, escaped, safe = 0, False, False, -1
        for k, ch in enumerate(s or ""):
            if escaped:
                escaped = False
            elif inside:
                escaped, inside = ch == "\\", ch != '"'
            elif ch == '"':
                inside = True
            elif ch in "{[":
                depth += 1
            elif ch in "}]":
                depth -= 1
                if depth == 1:
                    safe = k
        if depth <= 0 or safe < 0:
            return s if depth == 0 else None
        return s[: safe + 1].rstrip().removesuffix(",") + "\n}"

    return text.map(one)
