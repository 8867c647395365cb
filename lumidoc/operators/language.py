"""A document's language from scripts, word lists and vector evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from . import scoring as S


def anchors(spark, encode, names: dict[str, str] = P.LANGUAGE_NAMES) -> DataFrame:
    """(code, template, vec): every language's template sentences; code `noise` for sentences of no language."""
    rows = [(code, k, t.format(name=name)) for code, name in names.items() for k, t in enumerate(P.LANGUAGE_TEMPLATES)]
    rows += [("noise", k, t) for k, t in enumerate(P.NOISE_SENTENCES)]
    return spark.createDataFrame(rows, "code string, template int, text string").withColumn("vec", encode(F.col("text"))).drop("text")


def profile(docs: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """(key, code, absolute, neutral, noise): the best template cosine of each language, plain and less the template's mean over languages."""
    sims = docs.crossJoin(F.broadcast(bank.withColumnRenamed("vec", "a"))).select(key, "code", "template", S.cosine(F.col("vec"), F.col("a")).alias("s"))
    rows = sims.where("code <> 'noise'").withColumn("n", F.col("s") - F.avg("s").over(Window.partitionBy(key, "template")))
    best = rows.groupBy(key, "code").agg(F.max("s").alias("absolute"), F.max("n").alias("neutral"))
    noise = sims.where("code = 'noise'").groupBy(key).agg(F.max("s").alias("noise"))
    return best.join(noise, key)


def fused(profiles: DataFrame, key: str, served: list[str], priors: dict[str, float] = P.LATIN_PRIORS, reference: str = "eng", relief: float = 0.5, peer: float = 0.010, ref_margin: float = 0.020) -> DataFrame:
    """(key, language, stage, margin): the decision list over a document's Latin-script profile.

    Noise ahead of every language: the reference. No more spread between languages than between language and
    noise: priors among served languages. The reference on top: the reference. A clear lead: the best, or a served
    one close behind it. Else priors among the first three.
    """
    order = Window.partitionBy(key).orderBy(F.round("neutral", 9).desc(), "code")
    prior = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in priors.items() for x in p]), F.col("code")), F.lit(0.0))
    rows = profiles.withColumns({"rn": F.row_number().over(order), "prior": prior, "served": F.col("code").isin(*served).cast("int")})
    pick = F.struct("served", "prior", F.round("neutral", 9).alias("neutral"), "code")
    one = rows.groupBy(key).agg(
        F.max(F.when(F.col("rn") == 1, F.col("code"))).alias("best"), F.max(F.when(F.col("rn") == 1, F.col("neutral"))).alias("n1"), F.max(F.when(F.col("rn") == 2, F.col("neutral"))).alias("n2"),
        F.max(F.when(F.col("code") == reference, F.col("neutral"))).alias("ref"), F.max("absolute").alias("abs"), F.max("noise").alias("noise"), F.stddev_pop("neutral").alias("spread"),
        F.stddev_pop(F.when(F.col("rn") > 1, F.col("neutral"))).alias("band"), F.max(pick).alias("any"), F.max(F.when((F.col("rn") <= 3) | (F.col("code") == reference), pick)).alias("top"),
        F.min(F.when(F.col("served") == 1, F.struct("rn", "code", "neutral"))).alias("alt"),
    )
    m12 = F.round(F.col("n1") - F.col("n2"), 9)
    band = F.round("band", 9)
    decisive = F.when(band <= 1e-6, (m12 >= peer) & (F.col("n1") - F.col("ref") >= ref_margin)).otherwise(m12 >= band)
    swap = ~F.col("best").isin(*served) & F.col("alt").isNotNull() & (F.col("n1") - F.col("alt.neutral") < band * 2)
    noisy = F.round("noise", 9) > F.round(F.col("abs") * (1 + relief), 9)
    flat = F.round(F.col("abs") - F.col("noise"), 9) <= F.round("spread", 9)
    stage = F.when(noisy, "noise-fallback").when(flat, "script-prior").when(F.col("best") == reference, "reference-locked").when(decisive & swap, "served-swap").when(decisive, "cosine-decided").otherwise("script-prior")
    code = F.when(noisy, reference).when(flat, F.col("any.code")).when(F.col("best") == reference, reference).when(decisive & swap, F.col("alt.code")).when(decisive, F.col("best")).otherwise(F.col("top.code"))
    return one.select(key, code.alias("language"), stage.alias("stage"), m12.alias("margin"))


def confidence(margin: Column, stage: Column) -> Column:
    """Of a margin, by a steep sigmoid; 0 where nothing was decided."""
    return F.when(stage.isin("noise-fallback", "fallback"), 0.0).otherwise(1 / (1 + F.exp(-24 * margin)))


def detect(text: Column) -> Column:
    """The language by blocks, and by words where the script is Latin."""
    found = X.script_language(X.block_census(text))
    return F.when(found["script"] == "Latin", X.latin_language(text)).otherwise(F.nullif(found["language"], F.lit("")))


def script_conflicts(lines: DataFrame, page: str, order: str, text: str, least: int = 12, share: float = 0.70) -> DataFrame:
    """lines with `conflict`: whether a line's main script differs from the dominant one of all lines before it."""
    rows = lines.select(page, order, F.explode(F.when(F.size(F.map_keys(X.block_census(text))) > 0, X.block_census(text))).alias("script", "n"))
    top = rows.groupBy(page, order).agg(F.max_by("script", F.struct("n", "script")).alias("own"))
    lines_of = lines.select(page, order).distinct()
    scripts = rows.select(page, "script").distinct()
    full = lines_of.join(scripts, page).join(rows, [page, order, "script"], "left")
    before = Window.partitionBy(page, "script").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = full.withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0)))
    dominant = run.groupBy(page, order).agg(F.sum("seen").alias("total"), F.max(F.struct("seen", "script")).alias("m"))
    doc = F.when((F.col("total") >= least) & (F.col("m.seen") >= F.col("total") * share), F.col("m.script"))
    return lines.join(dominant.select(page, order, doc.alias("dominant")), [page, order], "left").join(top, [page, order], "left").withColumn("conflict", F.coalesce(F.col("own") != F.col("dominant"), F.lit(False)))
