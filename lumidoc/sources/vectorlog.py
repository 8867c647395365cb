"""A keyed vector log: appended rows, last write wins, tombstones, compaction.

Rows are (rid, seq, live, vec, ...) in Parquet, in a folder for each namespace, dimension and recipe; the latest
view is an aggregate with map-side combine, so a key that was written often costs no skewed task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT_LEAST = 64
COMPACT_SHARE = 0.35


def latest(log: DataFrame) -> DataFrame:
    """The live row with the greatest seq of each rid; of rows with the same seq a tombstone wins, then the greater meta."""
    rest = [c for c in log.columns if c not in ("rid", "seq")]
    told = [F.coalesce("meta", F.lit(""))] if "meta" in rest else []
    best = log.groupBy("rid").agg(F.max_by(F.struct("seq", *rest), F.struct("seq", ~F.col("live"), *told)).alias("row"))
    return best.select("rid", "row.*").where("live").drop("live")


def stats(log: DataFrame) -> DataFrame:
    """One row: live keys, dead rows, and whether the log is due for compaction. A row that was written twice counts once."""
    one = log.groupBy("rid", "seq").agg(F.bool_and("live").alias("live")).groupBy("rid").agg(F.count("*").alias("n"), F.max_by("live", "seq").alias("live"))
    rows = one.agg(F.count_if("live").alias("live"), F.sum("n").alias("written"))
    dead = F.col("written") - F.col("live")
    return rows.select("live", dead.alias("dead"), ((F.col("live") > 0) & (dead >= COMPACT_LEAST) & (dead >= COMPACT_SHARE * F.col("live"))).alias("compact"))


class VectorLog:
    """A log at path/namespace=<n>/dim=<d>/recipe=<r>."""

    def __init__(self, spark: SparkSession, path: str, namespace: str, dim: int, recipe: str) -> None:
        self.spark, self.dim = spark, dim
        self.path = f"{path}/namespace={namespace}/dim={dim}/recipe={recipe}"

    def upsert(self, rows: DataFrame, seq: int) -> None:
        """Append rows(rid, vec, meta); vectors of another dimension are left out, and of a rid's rows that with the greatest meta stays."""
        fit = rows.where(F.size("vec") == self.dim).groupBy("rid").agg(F.max_by(F.struct("vec", "meta"), F.coalesce("meta", F.lit(""))).alias("r"))
        fit.select("rid", "r.vec", "r.meta").select("rid", F.lit(seq).cast("bigint").alias("seq"), F.lit(True).alias("live"), "vec", "meta").write.mode("append").parquet(self.path)

    def delete(self, ids: DataFrame, seq: int) -> None:
        """Append tombstones for ids(rid)."""
        none = F.array().cast("array<float>")
        ids.select("rid", F.lit(seq).cast("bigint").alias("seq"), F.lit(False).alias("live"), none.alias("vec"), F.lit(None).cast("string").alias("meta")).write.mode("append").parquet(self.path)

    def next_seq(self) -> int:
        """A number over all that the log has; 0 if it has none."""
        try:
            last = self.log().agg(F.max("seq").alias("n")).first()["n"]
        except AnalysisException:  # nothing was written yet
            last = None
        return 0 if last is None else last + 1

    def log(self) -> DataFrame:
        return self.spark.read.schema("rid string, seq bigint, live boolean, vec array<float>, meta string").parquet(self.path)

    def live(self) -> DataFrame:
        return latest(self.log())

    def get_many(self, ids: DataFrame) -> DataFrame:
        return self.live().join(ids.select("rid"), "rid", "left_semi")

    def compacted(self, path: str) -> "VectorLog":
        """The latest view written as a new log; the old one stays until it is dropped."""
        fresh = VectorLog.__new__(VectorLog)
        fresh.spark, fresh.dim, fresh.path = self.spark, self.dim, path
        self.live().select("rid", "seq", F.lit(True).alias("live"), "vec", "meta").write.mode("overwrite").parquet(path)
        return fresh
