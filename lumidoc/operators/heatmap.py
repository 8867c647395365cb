"""Category heat maps over a grid of patches, and what cleans them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import shipped
from ..sources.shared import settled
from . import scoring as S

#: Claims and patches of a page that one task holds against each other, and claims at a time.
GROUNDED_BLOCK, GROUNDED_STEP = 4096, 256


def calibrated(patches: DataFrame, bank: DataFrame) -> DataFrame:
    """(idx, category, net, score) of patches(idx, vec): bias less positive prejudice, standardised per patch, then per category."""
    pooled = S.max_pool(patches, bank, "idx", ["field", "kind"])
    wide = pooled.groupBy("idx", F.col("field").alias("category")).agg(F.max(F.when(F.col("kind") == "bias", F.col("score"))).alias("bias"), F.max(F.when(F.col("kind") == "prejudice", F.col("score"))).alias("against"))
    rows = wide.withColumn("net", F.col("bias") - F.greatest(F.lit(0.0), F.coalesce("against", F.lit(0.0))))
    rows = rows.withColumn("z", S.z_score(F.col("net"), Window.partitionBy("idx")))
    return rows.select("idx", "category", "net", S.z_score(F.col("z"), Window.partitionBy("category")).alias("score"))


def title_band(rows: Column, ratio: float = 0.12) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(2), F.bround(rows * ratio).cast("int")))


def suppress_titles(scores: DataFrame, rows: int, exempt: list[str], ratio: float = 0.12, penalty: float = 0.5) -> DataFrame:
    """scores(idx, r, category, score) with the penalty on the title rows of all but the exempt categories."""
    band = max(1, min(2, round(rows * ratio)))
    if band >= rows:
        return scores
    return scores.withColumn("score", F.when((F.col("r") < band) & ~F.col("category").isin(*exempt), F.col("score") - penalty).otherwise(F.col("score")))


def spatial_residual(scores: DataFrame) -> DataFrame:
    """scores(idx, r, c, category, score) with row and column means taken out of the most diffuse categories.

    A category is diffuse if its share of positive patches is at least the upper median of all shares plus their upper
    median deviation. A residual without a positive patch is taken back. Null scores count 0 in means and stay null.
    """
    shares = scores.groupBy("category").agg((F.count_if(F.col("score") > 0) / F.count("*")).alias("share"))

    def upper(x: Column) -> Column:
        return F.element_at(F.array_sort(F.collect_list(x)), (F.floor(F.count(x) / 2) + 1).cast("int"))

    mid = shares.agg(upper(F.col("share")).alias("mid"), F.count("*").alias("n"))
    dev = shares.crossJoin(F.broadcast(mid)).groupBy("mid", "n").agg(upper(F.abs(F.col("share") - F.col("mid"))).alias("dev"))
    gate = dev.select((F.col("mid") + F.when(F.col("dev") > 1e-6, F.col("dev")).otherwise(0.0)).alias("gate"), "n")
    wide = shares.crossJoin(F.broadcast(gate)).select("category", ((F.col("share") >= F.col("gate")) & (F.col("n") >= 3)).alias("diffuse"))
    x = F.coalesce("score", F.lit(0.0))
    one = Window.partitionBy("category")
    residual = x - F.avg(x).over(Window.partitionBy("category", "r")) - F.avg(x).over(Window.partitionBy("category", "c")) + F.avg(x).over(one)
    rows = scores.join(F.broadcast(wide), "category").withColumn("residual", F.when(F.col("score").isNotNull(), residual))
    positive = F.max(F.coalesce(F.round("residual", 9) > 0, F.lit(False))).over(one)
    return rows.select("idx", "r", "c", "category", F.when(F.col("diffuse") & positive, F.col("residual")).otherwise(F.col("score")).alias("score"))


def positive_stats(scores: DataFrame, group: str = "category") -> DataFrame:
    """(group, mean, sd, n, gate): of the positive scores; the gate is mean + sd from four scores on, else 0."""
    p = F.when(F.col("score") > 0, F.col("score"))
    rows = scores.groupBy(group).agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("sd"), F.count(p).alias("n"))
    few = F.col("n") < 2
    return rows.select(group, F.when(few, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(few, 0.0).otherwise(F.col("sd")).alias("sd"), "n", F.when(F.col("n") < 4, 0.0).otherwise(F.col("mean") + F.col("sd")).alias("gate"))


def _widths(vecs: pd.Series) -> np.ndarray:
    """The length of each vector; -1 for a missing one or one with a missing value."""
    return np.array([-1 if v is None or any(x is None for x in v) else len(v) for v in vecs], np.int64)


def grounded(claims: DataFrame, patches: DataFrame, page: str, leeway: float = 0.5) -> DataFrame:
    """(claim, s_in, s_out, accepted) of claims(page, claim, vec, r0, r1, c0, c1): does the best patch inside its box beat those outside?

    Every claim meets every patch of its own page. A page's claims and patches are dealt into blocks, and each two blocks
    are one matrix product whose similarities never leave it: a claim gets one row of counts, sums and maxima from each.
    Vectors that are missing or of another length have no similarity.
    """
    shipped(claims.sparkSession)
    sizes = claims.groupBy(page).agg(F.ceil(F.count("*") / GROUNDED_BLOCK).alias("blocks")).join(patches.groupBy(page).agg(F.ceil(F.count("*") / GROUNDED_BLOCK).alias("others")), page)

    def dealt(rows: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        return rows.join(sizes, page).withColumn(own, F.pmod(F.xxhash64(*by), F.col("blocks" if own == "i" else "others"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others" if own == "i" else "blocks") - 1))).drop("blocks", "others")

    left = dealt(claims.select(page, "claim", "vec", "r0", "r1", "c0", "c1"), "i", "j", "claim")
    right = dealt(patches.select(page, "r", "c", F.col("vec").alias("pvec")), "j", "i", "r", "c")
    right = right.toDF("own", "r", "c", "pvec", "j2", "i2")  # names of its own: both sides may come from one table
    names = ["claim", "n", "total", "squares", "in", "out", "n_in", "n_out"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({k: [] for k in names})
        wide, r, c = _widths(right["pvec"]), right["r"].to_numpy(np.float64), right["c"].to_numpy(np.float64)
        parts = []
        for k in range(0, len(left), GROUNDED_STEP):
            part = left.iloc[k : k + GROUNDED_STEP]
            own = _widths(part["vec"])
            sims, valid = np.zeros((len(part), len(right))), (own[:, None] == wide) & (own[:, None] >= 0)
            for width in set(own[own > 0].tolist()) & set(wide.tolist()):
                a, b = np.flatnonzero(own == width), np.flatnonzero(wide == width)
                x, y = (np.array(v.tolist(), np.float64) for v in (part["vec"].iloc[a], right["pvec"].iloc[b]))
                length = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
                sims[np.ix_(a, b)] = np.where(length < S.TINY * S.TINY, 0.0, (x @ y.T) / np.maximum(length, S.TINY * S.TINY))
            r0, r1, c0, c1 = (part[k].to_numpy(np.float64)[:, None] for k in ("r0", "r1", "c0", "c1"))
            inside, outside = (r >= r0) & (r <= r1) & (c >= c0) & (c <= c1), (r < r0) | (r > r1) | (c < c0) | (c > c1)
            best = [np.where(valid & side, sims, -np.inf).max(axis=1) for side in (inside, outside)]
            kept = np.where(valid, sims, 0.0)
            parts.append(pd.DataFrame(dict(zip(names, [part["claim"].to_numpy(), valid.sum(axis=1), kept.sum(axis=1), (kept * kept).sum(axis=1), *best, inside.sum(axis=1), outside.sum(axis=1)], strict=True))))
        return pd.concat(parts)

    shape = f"claim {claims.schema['claim'].dataType.simpleString()}, n bigint, total double, squares double, `in` double, out double, n_in bigint, n_out bigint"
    found = left.groupBy(page, "i", "j").cogroup(right.groupBy("own", "i2", "j2")).applyInPandas(run, shape)
    best = lambda k: F.max(F.when(F.col(k) != float("-inf"), F.col(k))).alias(k)
    sums = found.groupBy("claim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), best("in"), best("out"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    mean = F.try_divide("total", F.col("n").cast("double"))
    rows = sums.withColumn("mean", mean).withColumn("sd", F.greatest(F.sqrt(F.greatest(F.try_divide("squares", F.col("n").cast("double")) - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(1e-6)))
    s_in = (F.col("in") - F.col("mean")) / F.col("sd") - S.gumbel(F.col("n_in"))
    s_out = (F.col("out") - F.col("mean")) / F.col("sd") - S.gumbel(F.col("n_out"))
    return rows.select("claim", s_in.alias("s_in"), s_out.alias("s_out"), F.when(s_in.isNull() | s_out.isNull(), True).otherwise((s_in >= s_out) | (s_out - s_in < leeway)).alias("accepted"))


def dropped_fields(verdicts: DataFrame, doc: str, field: str) -> DataFrame:
    """(doc, field) with a refused claim and no accepted one."""
    return verdicts.groupBy(doc, field).agg(F.max("accepted").alias("any")).where("not any").select(doc, field)


def dense_band(rows: DataFrame, least: int = 2) -> DataFrame:
    """(r0, r1, span) of the longest run of dense rows(r, n): at least the Otsu gate and the median of the rows with ink."""
    active = rows.where("n > 0")
    gate = S.otsu(active.select(F.col("n").cast("double").alias("value"))).crossJoin(active.agg(F.percentile("n", F.lit(0.5)).alias("med")))
    dense = rows.crossJoin(F.broadcast(gate)).where(F.col("n") >= F.greatest("gate", "med"))
    # a page's grid has a few dozen rows: one small group
    runs = dense.withColumn("island", F.col("r") - F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("r")))
    spans = runs.groupBy("island").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.count("*").alias("span")).where(F.col("span") >= least)
    best = spans.agg(F.max(F.struct("span", (-F.col("r0")).alias("less"), "r1")).alias("b")).where("b is not null")
    return best.select((-F.col("b.less")).alias("r0"), F.col("b.r1").alias("r1"), F.col("b.span").alias("span"))


def grid_components(cells: DataFrame, group: str = "category") -> DataFrame:
    """(group, r, c, comp) of cells(group, r, c): 4-connected components, named by their least cell number.

    Runs of a row are found by windows first; then each run takes the least label of the runs that touch it above
    and below, and then the label of its label (pointer jumping), until nothing changes.
    """
    order = Window.partitionBy(group, "r").orderBy("c")
    runs = cells.withColumn("island", F.col("c") - F.row_number().over(order))
    spans = runs.groupBy(group, "r", "island").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    spans = spans.withColumn("node", F.col("r") * 100000 + F.col("c0"))
    below = spans.select(group, (F.col("r") - 1).alias("r"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("node").alias("b"))
    edges = spans.join(below, [group, "r"]).where((F.col("c0") <= F.col("d1")) & (F.col("d0") <= F.col("c1"))).select(group, F.col("node").alias("a"), "b")
    edges = settled(edges.unionByName(edges.select(group, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = settled(spans.select(group, "node", F.col("node").alias("comp")))
    while True:
        near = edges.join(labels.select(group, F.col("node").alias("b"), "comp"), [group, "b"]).groupBy(group, F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        hops = settled(labels.join(near, [group, "node"], "left").select(group, "node", F.col("comp").alias("old"), F.least("comp", F.coalesce("low", "comp")).alias("hop")))
        jump = hops.select(group, F.col("node").alias("hop"), F.col("hop").alias("comp"))
        after = settled(hops.join(jump, [group, "hop"]).select(group, "node", "comp", (F.col("comp") < F.col("old")).alias("moved")))
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return runs.join(spans.select(group, "r", "island", "node"), [group, "r", "island"]).join(labels, [group, "node"]).select(group, "r", "c", "comp")
