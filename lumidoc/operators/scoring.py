"""Similarity, pooling and normalisation: vectors against phrase banks, as matrix products and window aggregates.

A bank is a dictionary (fields and their phrases), not data: it is sent to the executors in blocks of a fixed size, so
a larger bank makes more blocks, not larger ones. Vectors are never shuffled before they are pooled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..ship import shipped

#: Bank vectors that go to the executors at a time.
BLOCK = 65_536
TINY = 1e-8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return let(a, lambda v: F.sqrt(dot(v, v)))


def unit(a: Column) -> Column:
    """A vector at length 1; one near zero stays as it is."""
    return let(a, lambda v: let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n < TINY, 1.0).otherwise(n))))


def cosine(a: Column, b: Column) -> Column:
    return let(a, lambda x: let(b, lambda y: let(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), lambda n: F.when(n < TINY * TINY, 0.0).otherwise(dot(x, y) / n))))


def gumbel(n: Column) -> Column:
    """The expected greatest of n standard scores: sqrt(2 ln n), 0 for up to one."""
    return F.when(n <= 1, 0.0).otherwise(F.sqrt(2 * F.log(n.cast("double"))))


def z_score(x: Column, over: Window) -> Column:
    sd = F.stddev_pop(x).over(over)
    return F.when(sd < TINY, 0.0).otherwise((x - F.avg(x).over(over)) / sd)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n < TINY, m, m / np.where(n < TINY, 1, n))


def bank_blocks(bank: DataFrame, columns: list[str], block: int = BLOCK) -> Iterator[list]:
    """The bank's rows in order, block by block."""
    rows = bank.select(*columns).orderBy(*columns[:-1]).toLocalIterator()
    held = []
    for r in rows:
        held.append(tuple(r))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def max_pool(vectors: DataFrame, bank: DataFrame, key: str, by: list[str], vec: str = "vec", normalise: bool = True) -> DataFrame:
    """(key, *by, score, ord): for each vector the greatest weighted cosine with each group of bank(*by, ord, weight, vec).

    The first phrase (by ord) wins ties. bank.ord is unique inside a group.
    """
    spark = vectors.sparkSession
    shipped(spark)
    out = None
    kinds = [bank.schema[c].dataType.simpleString() for c in by]
    shape = ", ".join([f"`{key}` {vectors.schema[key].dataType.simpleString()}", *[f"`{c}` {t}" for c, t in zip(by, kinds, strict=True)], "score double", "ord int"])
    for rows in bank_blocks(bank, [*by, "ord", "weight", "vec"]):
        groups = sorted({r[: len(by)] for r in rows})
        number = {g: k for k, g in enumerate(groups)}
        member = np.array([number[r[: len(by)]] for r in rows])
        matrix = np.array([r[-1] for r in rows], np.float64)
        shared = spark.sparkContext.broadcast((groups, member, np.array([r[len(by)] for r in rows]), np.array([r[len(by) + 1] for r in rows], np.float64), _units(matrix) if normalise else matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            groups, member, ords, weights, matrix = shared.value
            for batch in batches:
                for begin in range(0, batch.num_rows, 2048):
                    part = batch.slice(begin, 2048)
                    m = _matrix(part.column(1))
                    if not len(m):
                        continue
                    sims = (_units(m) @ matrix.T) * weights
                    best, first = np.empty((len(m), len(groups))), np.empty((len(m), len(groups)), np.int32)
                    for g in range(len(groups)):
                        own = np.flatnonzero(member == g)
                        at = np.argmax(sims[:, own], axis=1)
                        best[:, g], first[:, g] = sims[np.arange(len(m)), own[at]], ords[own[at]]
                    keys = part.column(0).take(pa.array(np.repeat(np.arange(len(m)), len(groups))))
                    cols = [pa.array([g[k] for g in groups] * len(m)) for k in range(len(groups[0]))]
                    yield pa.RecordBatch.from_arrays([keys, *cols, pa.array(best.ravel()), pa.array(first.ravel(), pa.int32())], names=[key, *by, "score", "ord"])

        part = vectors.select(key, vec).mapInArrow(run, shape)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], shape)
    best = F.max(F.struct("score", (-F.col("ord")).alias("ord"))).alias("best")
    return out.groupBy(key, *by).agg(best).select(key, *by, "best.score", (-F.col("best.ord")).alias("ord"))


def surprisal(vectors: DataFrame, bank: DataFrame, key: str, vec: str = "vec", damp: float = 0.25) -> DataFrame:
    """(key, field, bias, prejudice, net, z, penalty, surprisal, rank) for every vector and field of bank(field, kind, ord, weight, vec).

    net is the greatest bias cosine less a positive greatest prejudice cosine; z is taken over the fields of one
    vector; the penalty grows with the size of a field's bias bank, against the mean of all.
    """
    pooled = max_pool(vectors, bank, key, ["field", "kind"], vec)
    wide = pooled.groupBy(key, "field").agg(F.max(F.when(F.col("kind") == "bias", F.col("score"))).alias("bias"), F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("kind") == "prejudice", F.col("score"))), F.lit(0.0))).alias("prejudice")).where("bias is not null")
    sizes = bank.where("kind = 'bias'").groupBy("field").agg(F.count("*").alias("bank_size"))
    rows = wide.join(sizes, "field").withColumn("net", F.col("bias") - F.col("prejudice"))
    one = Window.partitionBy(key)
    g = gumbel(F.col("bank_size"))
    rows = rows.withColumns({"z": z_score(F.col("net"), one), "penalty": (g - F.avg(g).over(one)) * damp}).withColumn("surprisal", F.col("z") - F.col("penalty"))
    rank = F.row_number().over(one.orderBy(F.round("surprisal", 9).desc(), "field"))
    return rows.withColumn("rank", rank).select(key, "field", "bias", "prejudice", "net", "z", "penalty", "surprisal", "rank")


def top_fields(scores: DataFrame, key: str, gate: float = 0.0) -> DataFrame:
    """(key, field, score, margin, passed): the best field of each vector, its lead, and how many pass the gate."""
    return scores.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("field"))).alias("field"), F.max(F.when(F.col("rank") == 1, F.col("surprisal"))).alias("score"),
        (F.max(F.when(F.col("rank") == 1, F.col("surprisal"))) - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("surprisal"))), F.lit(0.0))).alias("margin"),
        F.count_if(F.col("surprisal") > gate).alias("passed"),
    ).withColumn("field", F.when(F.col("passed") > 0, F.col("field")))


def bank_neutral(scores: DataFrame, row: str, col: str, chrome: DataFrame | None = None) -> DataFrame:
    """scores(row, col, score) as (row, col, neutral): less the row's mean, over the global deviation, less the column's chrome, less the column's mean.

    chrome(col, z): how far a column is above the mean in what no row wants; only the positive part counts.
    """
    centred = scores.withColumn("x", F.col("score") - F.avg("score").over(Window.partitionBy(row)))
    sd = centred.agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("sd"), F.countDistinct(row).alias("rows"))
    rows = centred.crossJoin(F.broadcast(sd)).withColumn("x", F.col("x") / F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd")))
    if chrome is not None:
        rows = rows.join(chrome, col, "left").withColumn("x", F.col("x") - F.greatest(F.lit(0.0), F.coalesce("z", F.lit(0.0))))
    mean = F.avg("x").over(Window.partitionBy(col))
    return rows.select(row, col, F.when(F.col("rows") >= 2, F.col("x") - mean).otherwise(F.col("x")).alias("neutral"))


def cohesion(vectors: DataFrame, group: str, key: str, vec: str = "vec") -> DataFrame:
    """(group, cohesion): the mean cosine of different vectors of a group, within 0 and 1.

    The mean over pairs comes from the sum of unit vectors, so no pairs are made: |sum|^2 = n + 2 * (sum over pairs).
    """
    rows = vectors.select(group, F.posexplode(unit(F.col(vec))).alias("i", "x"))
    sums = rows.groupBy(group, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    whole = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.sum("q").alias("own"), F.max("n").alias("n"))
    mean = (F.col("square") - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return whole.select(group, F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean))).alias("cohesion"))


def decisive_margin(scores: DataFrame, group: str, score: str = "score") -> DataFrame:
    """(group, m12, band, decisive): the lead of the best score against the spread of all others."""
    finite = scores.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < float("inf")))
    ranked = finite.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc())))
    rows = ranked.groupBy(group).agg(F.count("*").alias("n"), F.max(F.when(F.col("rn") == 1, F.col(score))).alias("top"), F.max(F.when(F.col("rn") == 2, F.col(score))).alias("second"), F.stddev_pop(F.when(F.col("rn") > 1, F.col(score))).alias("sd"))
    m12, band = F.col("top") - F.col("second"), F.when(F.col("sd") <= 1e-6, 0.0).otherwise(F.col("sd"))
    few = F.col("n") < 2
    return rows.select(group, F.when(few, 0.0).otherwise(m12).alias("m12"), F.when(few, 0.0).otherwise(band).alias("band"), F.when(few, True).otherwise(F.when(F.col("sd") <= 1e-6, m12 > 0).otherwise(F.round(m12, 9) >= F.round(band, 9))).alias("decisive"))


def prejudice_dominates(own: Column, prejudice: Column, held: Column) -> Column:
    relief = F.greatest(F.lit(0.0), F.least(F.lit(0.5), held))
    return F.when(own.isNull() | F.isnan(own) | (own <= 0), True).otherwise(prejudice > own * (1 + relief))


def otsu(values: DataFrame, value: str = "value", group: list[str] | None = None, bins: int = 64) -> DataFrame:
    """(*group, gate): the centre of the histogram bin that parts the values with the greatest variance between."""
    group = group or []
    bounds = values.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = values.join(bounds, group) if group else values.crossJoin(F.broadcast(bounds))  # without groups one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") <= F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width)))
    counts = rows.withColumn("bin", at.cast("int")).groupBy(*group, "lo", "hi", "bin").agg(F.count("*").alias("n"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    before = Window.partitionBy(*group).orderBy("bin")
    rows = counts.withColumns({"centre": centre, "total": F.sum("n").over(Window.partitionBy(*group)), "mass": F.sum(F.col("n") * centre).over(Window.partitionBy(*group)), "w0": F.sum("n").over(before), "m0": F.sum(F.col("n") * centre).over(before)})
    w1 = F.col("total") - F.col("w0")
    between = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("m0") / F.col("w0") - (F.col("mass") - F.col("m0")) / w1, F.lit(2.0))).otherwise(0.0)
    best = F.max(F.struct(F.round(between, 9).alias("b"), (-F.col("bin")).alias("less"), "centre")).alias("best")
    return rows.groupBy(*group).agg(best).select(*group, F.col("best.centre").alias("gate"))


def describe(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: least, greatest, mean and deviation of all components, the median length, and how many aren't finite."""
    items = vectors.select(F.explode(vec).alias("x")).select(F.col("x").cast("double").alias("x"))
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs(F.col("x")) == float("inf"))
    a = items.agg(F.min(F.when(~bad, F.col("x"))).alias("low"), F.max(F.when(~bad, F.col("x"))).alias("high"), F.avg(F.when(~bad, F.col("x"))).alias("mean"), F.stddev_pop(F.when(~bad, F.col("x"))).alias("sd"), F.count_if(bad).alias("bad"))
    return a.crossJoin(vectors.agg(F.percentile(norm(F.col(vec)), F.lit(0.5)).alias("median_norm")))


def quantize_fp8(v: Column, top: float = 448.0) -> Column:
    """A vector's scale and its components scaled to E4M3's range, rounded to 3 mantissa bits."""
    amax = F.array_max(F.transform(v, F.abs)).cast("double")
    scale = F.when(amax > 0, amax / top).otherwise(1.0)

    def snap(x: Column) -> Column:
        y = F.least(F.lit(top), F.greatest(F.lit(-top), x.cast("double") / scale))
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(F.abs(y), F.lit(2.0**-9)))), F.lit(-6)) - 3)
        return F.bround(y / step) * step

    return F.struct(scale.alias("scale"), F.transform(v, snap).alias("q"))


def top_k(queries: DataFrame, store: DataFrame, qid: str, rid: str, k: int, vec: str = "vec", block: int = 4096) -> DataFrame:
    """(qid, rid, score, rank): the k nearest rows of store by cosine for each query; k below 1 gives one.

    The queries are the stated set: they go through the store in blocks, and every task carries its k best from batch
    to batch, so the shuffle holds k rows for each query and task, however many batches a task reads.
    """
    spark = store.sparkSession
    shipped(spark)
    k = max(1, k)
    shape = f"`{qid}` {queries.schema[qid].dataType.simpleString()}, `{rid}` {store.schema[rid].dataType.simpleString()}, score double"
    kinds = [to_arrow_type(queries.schema[qid].dataType), to_arrow_type(store.schema[rid].dataType)]
    out = None
    for rows in bank_blocks(queries, [qid, vec], block):
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], _units(np.array([r[1] for r in rows], np.float64))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best: np.ndarray | None = None  # (queries, up to k) scores, and beside them the rows' names
            for batch in batches:
                if not batch.num_rows:
                    continue
                sims = np.round(q @ _units(_matrix(batch.column(1))).T, 12)
                own = np.broadcast_to(batch.column(0).to_numpy(zero_copy_only=False), sims.shape)
                if sims.shape[1] > k:  # what is under the k-th score can't come back; equal ones stay for the order of names
                    floor = np.partition(sims, -k, axis=1)[:, -k]
                    some = np.flatnonzero((sims >= floor[:, None]).any(axis=0))
                    sims, own = sims[:, some], own[:, some]
                if best is not None:
                    sims, own = np.concatenate([best, sims], axis=1), np.concatenate([names, own], axis=1)
                order = np.lexsort((own, -sims), axis=1)[:, :k]
                best, names = np.take_along_axis(sims, order, 1), np.take_along_axis(own, order, 1)
            if best is not None:
                at = np.repeat(np.arange(len(ids)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], kinds[0]), pa.array(names.ravel(), kinds[1]), pa.array(best.ravel())], names=[qid, rid, "score"])

        part = store.select(rid, vec).mapInArrow(run, shape)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], shape + ", rank int")
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.col("score").desc(), rid))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def net_scores(vectors: DataFrame, bank: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, field, net): the greatest bias cosine less the greatest prejudice cosine, weights and signs aside; 0 for an empty side."""
    pooled = max_pool(vectors, bank.withColumn("weight", F.lit(1.0)), key, ["field", "kind"], vec)
    side = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    return pooled.groupBy(key, "field").agg((side("bias") - side("prejudice")).alias("net"))


def space_quality(pairs: DataFrame) -> DataFrame:
    """(good, bad, gap, verdict) of pairs(same BOOLEAN, a, b): does an encoder's space keep like pairs closer than unlike ones?"""
    rows = pairs.select("same", cosine(F.col("a"), F.col("b")).alias("c"))
    means = rows.agg(F.avg(F.when(F.col("same"), F.col("c"))).alias("good"), F.avg(F.when(~F.col("same"), F.col("c"))).alias("bad"))
    gap = F.col("good") - F.col("bad")
    return means.select("good", "bad", gap.alias("gap"), F.when(gap >= 0.10, "good").when(gap > 0.02, "weak").otherwise("collapsed").alias("verdict"))


def kv_bytes(layers: Column, heads: Column, dim: Column, tokens: Column, width: int = 2) -> Column:
    """Bytes of a key and value cache."""
    return (2 * layers * heads * dim * width * tokens).cast("bigint")


def score_matrix(scores: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each key, one column for each field; null where there is no score."""
    return scores.groupBy(key).pivot("field", fields).agg(F.max("surprisal"))
