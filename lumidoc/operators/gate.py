"""Formats of fields and gates over chunks before they compete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from . import scoring as S

#: Least lead of the best format anchor over the second.
ANCHOR_LEAD = 0.015
UNCLASSIFIED = "unclassified"


def anchored_format(fields: DataFrame, anchors: DataFrame, lead: float = ANCHOR_LEAD) -> DataFrame:
    """(field, format) of fields(field, vec): the nearest of anchors(format, ord, vec) where it leads the second by enough."""
    bank = anchors.select("format", "ord", F.lit(1.0).alias("weight"), "vec")
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "ord", "format")))
    best = S.max_pool(fields, bank, "field", ["format"]).groupBy("field").agg(order.alias("o"))
    gap = F.when(F.size("o") > 1, F.col("o")[1]["less"] - F.col("o")[0]["less"]).otherwise(-F.col("o")[0]["less"])
    return best.where(gap >= lead).select("field", F.col("o")[0]["format"].alias("format"))


def inferred_formats(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, format) by the majority of samples(*keys, ord, value); no row where nothing is found."""
    rows = samples.withColumn("v", X.trimmed("value")).where("v <> ''").withColumn("fmt", X.format_probe("v"))
    counts = rows.groupBy(*keys, "fmt").agg(F.count("*").alias("c"), F.min("ord").alias("first"), F.sum(F.length("v")).alias("chars"))
    best = F.max(F.when(F.col("fmt").isNotNull(), F.struct("c", (-F.col("first")).alias("less"), "fmt")))
    out = counts.groupBy(*keys).agg(best.alias("best"), F.sum("c").alias("n"), F.sum("chars").alias("chars"))
    long = F.when(F.col("chars") / F.col("n") >= 40, "synthesis")
    found = F.when(F.col("best").isNull(), long).when(F.col("best.c") * 2 >= F.col("n"), F.col("best.fmt"))
    return out.select(*keys, found.alias("format")).where("format is not null")


def detected_formats(fields: DataFrame, samples: DataFrame, anchored: DataFrame | None = None) -> DataFrame:
    """(field, format) for every row of fields(field, format): its own if it is a known one, else inferred from its
    samples(field, key, ord, value) under value, bias or examples (the first of these that tells), else anchored, else text."""
    told = inferred_formats(samples, ["field", "key"]).groupBy("field").agg(
        F.min_by("format", F.when(F.col("key") == "value", 0).when(F.col("key") == "bias", 1).otherwise(2)).alias("told")
    )
    own = F.lower(F.btrim("format"))
    out = fields.select("field", F.when(own.isin(P.FORMATS), own).alias("own")).join(told, "field", "left")
    out = out.join(anchored.withColumnRenamed("format", "near"), "field", "left") if anchored is not None else out.withColumn("near", F.lit(None).cast("string"))
    return out.select("field", F.coalesce("own", "told", "near", F.lit("text")).alias("format"))


def format_gate(chunks: DataFrame, formats: DataFrame) -> DataFrame:
    """chunks(property, text, value_part, confirmed, status) with `format` and `verdict`; what doesn't fit its field's
    format loses its property and gets the status format-rejected. formats(field, format) is a dictionary table."""
    named = (F.coalesce("property", F.lit("")) != "") & (F.col("property") != UNCLASSIFIED)
    rows = chunks.join(formats.select(F.col("field").alias("property"), F.col("format").alias("format")), "property", "left")
    fmt = F.when(named, F.coalesce("format", F.lit("text")))
    target = F.when(F.coalesce("value_part", F.lit("")) != "", F.col("value_part")).otherwise(F.col("text"))
    rows = rows.withColumn("format", fmt).withColumn("verdict", F.when(~named, None).when(F.col("confirmed"), "confirmed-bypass").when(X.value_matches_format(target, "format"), "pass").otherwise("reject"))
    out = F.coalesce(F.col("verdict") == "reject", F.lit(False))
    return rows.withColumn("property", F.when(out, UNCLASSIFIED).otherwise(F.col("property"))).withColumn("status", F.when(out, "format-rejected").otherwise(F.col("status")))


def label_echo(chunks: DataFrame, bank: Column | None = None) -> DataFrame:
    """chunks(text, confirmed, property, status) of which unconfirmed printed labels are set aside as label-echo."""
    echo = ~F.coalesce("confirmed", F.lit(False)) & X.is_printed_label("text", bank)
    return chunks.withColumn("property", F.when(echo, UNCLASSIFIED).otherwise(F.col("property"))).withColumn("status", F.when(echo, "label-echo").otherwise(F.col("status")))


def text_axis(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc, code, score) of docs(doc, vec): the greatest cosine with each code's anchors(code, ord, vec); zero vectors have none."""
    full = docs.where(F.exists("vec", lambda x: x != 0))
    return S.max_pool(full, anchors.select("code", "ord", F.lit(1.0).alias("weight"), "vec"), "doc", ["code"]).select("doc", "code", "score")


def joint_space(patches: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row: mean and deviation of each anchor's best cosine with patches(idx, vec), for anchors(name, vec), and whether they tell apart."""
    bank = anchors.select("name", F.lit(0).alias("ord"), F.lit(1.0).alias("weight"), "vec")
    peaks = S.max_pool(patches, bank, "idx", ["name"]).groupBy("name").agg(F.max("score").alias("peak"))
    return peaks.agg(F.count("*").alias("anchors"), F.avg("peak").alias("mean"), F.stddev_pop("peak").alias("spread")).withColumn("tells_apart", F.col("spread") >= 0.01)


def unprejudiced(patches: DataFrame, bank: DataFrame) -> DataFrame:
    """(idx, field, bias, prejudice) of the pairs whose first prejudice phrase is no nearer than the first bias phrase of bank(field, kind, ord, vec)."""
    first = bank.groupBy("field", "kind").agg(F.min_by("vec", "ord").alias("vec")).select("field", "kind", F.lit(0).alias("ord"), F.lit(1.0).alias("weight"), "vec")
    scores = S.max_pool(patches, first, "idx", ["field", "kind"]).groupBy("idx", "field").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "bias", F.col("score"))), F.lit(0.0)).alias("bias"), F.coalesce(F.max(F.when(F.col("kind") == "prejudice", F.col("score"))), F.lit(0.0)).alias("prejudice")
    )
    return scores.where("prejudice <= bias")
