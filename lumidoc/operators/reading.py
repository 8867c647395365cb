"""Reading steps around the recognisers: line bands, prose lines, crops, row ledgers, choice of a recogniser, index rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..ship import shipped

#: Least height of a line, share and gap of overlapping bands, rows a ledger quantises by, its hit rate.
LINE_MIN_H = 8
OVERLAP_SHARE, MERGE_GAP = 0.30, 2
LEDGER_PX, LEDGER_HITS = 6, 0.60
PROSE_LINES = 12
SUMMARY_CHARS = 2000
BAND_BASE, BAND_RANGE, BAND_LEAST = 0.12, 0.22, 3.0
#: Re-splitting: a tall band's height in medians, its least height, rounds, base, what a gate rises by, gates tried, least range.
TALL_RATIO, TALL_MIN_H, TALL_ROUNDS = 2.2, 16, 3
TALL_BASE, TALL_STEP, TALL_GATES, TALL_LEAST = 20, 0.12, 3, 2.0
#: Columns of a line: gate and least range. Room around a line, lines of a page.
TRIM_RANGE, TRIM_LEAST = 0.30, 2.0
LINE_PAD_X, LINE_PAD_Y, LINE_MAX = 4, 3, 40


@dataclass(frozen=True)
class TextOptions:
    """Defaults of the text path."""

    margin: float = 0.0
    cliff: float = 0.75
    least_words: int = 1
    most_words: int = 6


@dataclass(frozen=True)
class VisionOptions:
    """Defaults of the vision path."""

    iou: float = 0.80
    margin: float = 0.28
    arena_margin: float = 0.12
    arena_rounds: int = 2
    arena_rivals: int = 3


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, by an exact product and an exact sum; beyond the range of the split plainly."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    p = a * b
    s = p + c
    rest = (p - (s - (s - p))) + (c - (s - p)) + (((ah * bh - p) + ah * bl + al * bh) + al * bl)
    return F.when(F.isnan(rest), s).otherwise(s + rest)


def quantile(v: str, share: float) -> Column:
    """The aggregate value at a share of a group's sorted values, between its neighbours by weights; rounded as DuckDB's quantile_cont does."""
    values = F.array_sort(F.collect_list(F.col(v).cast("double")))

    def at(x: Column) -> Column:
        place = (F.size(x) - 1) * F.lit(share)
        low, high = F.get(x, F.floor(place).cast("int")), F.get(x, F.ceil(place).cast("int"))
        part = place - F.floor(place)
        return F.when(part == 0, low).otherwise(_fused(low, 1 - part, high * part))

    return F.get(F.transform(F.array(values), at), F.lit(0))


def profile_bands(profile: DataFrame, page: str, gate: Column | None = None, least: int = LINE_MIN_H) -> DataFrame:
    """(page, y0, y1) of the runs of profile(page, y, v) over the gate that are at least `least` high; y1 is outside.

    Without a gate: the 12th percentile of the page's values and 0.22 of what the greatest is above it; a page whose values differ by less than 3 has no bands.
    """
    rows = profile
    if gate is None:
        base = quantile("v", BAND_BASE)
        stats = profile.groupBy(page).agg(base.alias("base"), F.max("v").alias("peak")).where(F.col("peak") - F.col("base") >= BAND_LEAST)
        rows = profile.join(stats.select(page, (F.col("base") + BAND_RANGE * (F.col("peak") - F.col("base"))).alias("gate")), page)
    else:
        rows = profile.withColumn("gate", gate)
    hot = rows.where(F.col("v") > F.col("gate"))
    runs = hot.withColumn("island", F.col("y") - F.row_number().over(Window.partitionBy(page).orderBy("y")))
    return runs.groupBy(page, "island").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).where(F.col("y1") - F.col("y0") >= least).drop("island")


def _runs(v: np.ndarray, gate: float) -> np.ndarray:
    """(n, 2) of the runs over the gate that are at least a line high; their ends are outside."""
    ends = np.flatnonzero(np.diff(np.concatenate([[False], v > gate, [False]]).astype(np.int8))).reshape(-1, 2)
    return ends[ends[:, 1] - ends[:, 0] >= LINE_MIN_H]


def split_tall(bands: DataFrame, profile: DataFrame, page: str) -> DataFrame:
    """(page, y0, y1): bands(page, y0, y1) much taller than the page's upper median cut where a higher gate parts them.

    profile(page, y, v) holds every row of a page from 0 on. A tall band takes the first of three gates over its own
    values that leaves two lines or more; up to three rounds, each against the median of the one before. A page's
    bands and profile, a few thousand rows, come together in one group.
    """
    shipped(bands.sparkSession)

    def parted(v: np.ndarray) -> np.ndarray | None:
        base, peak = np.percentile(v, TALL_BASE), v.max()
        tries = (_runs(v, base + (peak - base) * (BAND_RANGE + TALL_STEP * k)) for k in range(1, TALL_GATES + 1)) if peak - base >= TALL_LEAST else ()
        return next((t for t in tries if len(t) > 1), None)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        now = left[["y0", "y1"]].to_numpy(np.int64)
        v = np.zeros(int(max(right["y"].max() + 1 if len(right) else 0, now[:, 1].max() if len(now) else 0)))
        v[right["y"].to_numpy(np.int64)] = right["v"]
        for _ in range(TALL_ROUNDS if len(now) else 0):
            high = now[:, 1] - now[:, 0]
            tall = (high > np.sort(high)[len(high) // 2] * TALL_RATIO) & (high >= TALL_MIN_H)
            cuts = [(band, parted(v[band[0] : band[1]]) if far else None) for band, far in zip(now, tall, strict=True)]
            if all(c is None for _, c in cuts):
                break
            now = np.concatenate([band[None] if c is None else c + band[0] for band, c in cuts])
            now = now[np.argsort(now[:, 0], kind="stable")]
        return pd.DataFrame({page: [left[page].iloc[0]] * len(now) if len(now) else [], "y0": now[:, 0], "y1": now[:, 1]})

    shape = f"`{page}` {bands.schema[page].dataType.simpleString()}, y0 int, y1 int"
    return bands.select(page, "y0", "y1").groupBy(page).cogroup(profile.select(F.col(page).alias("own"), "y", "v").groupBy("own")).applyInPandas(run, shape)


def trimmed_columns(profile: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(*keys, x0, x1): from the first to the last of a line's columns profile(*keys, x, v) over its gate, the whole width where they hardly differ."""
    stats = profile.groupBy(*keys).agg(quantile("v", BAND_BASE).alias("base"), F.max("v").alias("peak"))
    over = F.when(F.col("v") > F.col("base") + (F.col("peak") - F.col("base")) * TRIM_RANGE, F.col("x"))
    ends = profile.join(stats, keys).groupBy(*keys, "base", "peak").agg(F.min(over).alias("a"), F.max(over).alias("b"))
    whole = (F.col("peak") - F.col("base") < TRIM_LEAST) | F.col("a").isNull()
    return ends.select(*keys, F.when(whole, 0).otherwise(F.col("a")).cast("int").alias("x0"), F.when(whole, width).otherwise(F.col("b") + 1).cast("int").alias("x1"))


def box_lines(boxes: DataFrame, page: str, width: int, height: int, most: int = LINE_MAX) -> DataFrame:
    """(page, n, x0, y0, x1, y1): the detector's boxes as lines, from top to bottom, with some room, the first `most`.

    A box goes into the first earlier one that shares at least 0.7 of the lower height and some width; slivers and
    boxes over nearly the whole page are left out. One fold over a page's sorted boxes.
    """
    sides = ("y0", "x0", "x1", "y1")
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kept = boxes.where((wide >= 4) & (high >= LINE_MIN_H) & ~((wide >= width * 0.95) & (high >= height * 0.80)))
    rows = kept.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*[F.col(k).cast("int").alias(k) for k in sides]))).alias("b"))

    def same(a: Column, b: Column) -> Column:
        shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        low = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
        return (shared > 0) & (shared >= low * (1 - OVERLAP_SHARE)) & (F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"]))

    def step(acc: Column, b: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda a: same(a, b)), True)
        both = lambda a: F.struct(*[f(a[k], b[k]).alias(k) for k, f in zip(sides, (F.least, F.least, F.greatest, F.greatest), strict=True)])
        return F.when(at == 0, F.array_append(acc, b)).otherwise(F.transform(acc, lambda a, i: F.when(i == at - 1, both(a)).otherwise(a)))

    lines = rows.select(page, F.posexplode(F.slice(F.aggregate("b", F.filter("b", lambda x: F.lit(False)), step), 1, most)).alias("n", "m"))
    low = lambda k, pad: F.greatest(F.lit(0), F.col(f"m.{k}") - pad).alias(k)
    top = lambda k, pad, end: F.least(F.lit(end), F.col(f"m.{k}") + pad).alias(k)
    return lines.select(page, "n", low("x0", LINE_PAD_X), low("y0", LINE_PAD_Y), top("x1", LINE_PAD_X, width), top("y1", LINE_PAD_Y, height))


def resolved_bands(bands: DataFrame, page: str) -> DataFrame:
    """(page, n, y0, y1): bands(page, y0, y1) of a page without overlap: those that share most become one, others are cut
    in the middle; then small gaps close. Two folds over one sorted array: a page has at most a few hundred bands."""
    band = lambda y0, y1: F.struct(y0.cast("int").alias("y0"), y1.cast("int").alias("y1"))
    but_last = lambda acc: F.slice(acc, 1, F.size(acc) - 1)

    def settle(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        shared, span = last["y1"] - b["y0"], F.least(last["y1"] - last["y0"], b["y1"] - b["y0"])
        cut = F.floor((last["y1"] + b["y0"]) / 2)
        upper = F.when(cut - last["y0"] >= LINE_MIN_H, band(last["y0"], cut)).otherwise(last)
        lower = F.when(b["y1"] - cut >= LINE_MIN_H, F.array(upper, band(cut, b["y1"]))).otherwise(F.array(band(upper["y0"], F.greatest(upper["y1"], b["y1"]))))
        one = F.array(band(F.least(last["y0"], b["y0"]), F.greatest(last["y1"], b["y1"])))
        return (
            F.when(F.size(acc) == 0, F.array(b)).when(b["y0"] >= last["y1"], F.array_append(acc, b)).when(span <= 0, acc)
            .when(shared >= span * (1 - OVERLAP_SHARE), F.concat(but_last(acc), one)).otherwise(F.concat(but_last(acc), lower))
        )

    def close(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (b["y0"] - last["y1"] <= MERGE_GAP) & (b["y1"] - last["y0"] <= (b["y1"] - b["y0"]) * 1.6)
        return F.when(F.size(acc) == 0, F.array(b)).when(near, F.concat(but_last(acc), F.array(band(last["y0"], b["y1"])))).otherwise(F.array_append(acc, b))

    rows = bands.groupBy(page).agg(F.array_sort(F.collect_list(band(F.col("y0"), F.col("y1")))).alias("b"))
    none = F.array().cast("array<struct<y0:int,y1:int>>")
    rows = rows.withColumn("b", F.aggregate("b", none, settle)).withColumn("b", F.aggregate("b", none, close))
    return rows.select(page, F.posexplode(F.filter("b", lambda x: x["y1"] - x["y0"] >= LINE_MIN_H)).alias("n", "x")).select(page, "n", "x.y0", "x.y1")


def prose_lines(texts: DataFrame, page: str, labels: Column | None = None, most: int = PROSE_LINES) -> DataFrame:
    """(page, lines, value) of texts(page, text) without a single label line: the plausible lines of enough characters, the first `most`."""
    every = F.filter(F.transform(F.split("text", "\r\n|[\n\r]"), X.trimmed), lambda x: x != "")
    solid = lambda x: F.length(F.regexp_replace(x, r"\s", ""))
    dense = lambda x: x.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")
    rows = texts.select(page, every.alias("every")).where((F.size("every") > 0) & ~F.exists("every", lambda x: X.is_printed_label(x, labels)))
    kept = F.slice(F.filter("every", lambda x: X.value_plausible(x) & (solid(x) >= F.when(dense(x), 1).otherwise(3))), 1, most)
    return rows.select(page, kept.alias("lines")).where(F.size("lines") > 0).select(page, "lines", F.array_join("lines", " ").alias("value"))


def field_value(refined: Column, category: Column, read: Column) -> Column:
    """The first text of a map of refined values under value, text or the category, else what was read."""
    out = X.trimmed(read)
    for key in (category, F.lit("text"), F.lit("value")):
        own = X.trimmed(F.try_element_at(refined, key))
        out = F.when(own != "", own).otherwise(out)
    return out


def confirmed_crops(candidates: DataFrame, width: int, height: int) -> DataFrame:
    """candidates with status confirmed, their boxes x0, y0, x1, y1 inside the picture."""
    inside = lambda k, most: F.least(F.greatest(F.col(k), F.lit(0)), F.lit(most)).alias(k)
    boxes = {"x0": width, "x1": width, "y0": height, "y1": height}
    return candidates.where("status = 'confirmed'").select(*[inside(c, boxes[c]) if c in boxes else F.col(c) for c in candidates.columns])


def ledger_key(*sides: Column, px: int = LEDGER_PX) -> Column:
    """A box on a coarse grid: boxes of one row read twice get the same key."""
    return F.struct(*[F.floor(s / px).cast("int").alias(k) for k, s in zip(("x0", "y0", "x1", "y1"), sides, strict=True)])


def reused_rows(boxes: DataFrame, ledger: DataFrame, page: str, crop: str, hits: float = LEDGER_HITS) -> DataFrame:
    """(page, crop, rows, hit, reuse): how many of a crop's boxes(page, crop, x0..y1) the ledger(page, x0..y1, seq, text)
    has read already, and whether that is enough not to read it again; the latest text of a key counts."""
    sides = [F.col(k) for k in ("x0", "y0", "x1", "y1")]
    known = ledger.where(X.trimmed("text") != "").groupBy(page, ledger_key(*sides).alias("key")).agg(F.max_by("text", "seq").alias("known"))
    rows = boxes.select(page, crop, ledger_key(*sides).alias("key")).join(known, [page, "key"], "left")
    return rows.groupBy(page, crop).agg(F.count("*").alias("rows"), F.count("known").alias("hit")).withColumn("reuse", F.col("hit") >= F.col("rows") * hits)


def surest_reader(readings: DataFrame, page: str, most: int = 8) -> DataFrame:
    """(page, reader, conf): of readings(page, reader, x0, y0, x1, y1, conf) the reader with the greatest mean confidence on its `most` largest lines."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    # a page has a few dozen lines
    top = readings.withColumn("n", F.row_number().over(Window.partitionBy(page, "reader").orderBy(area.desc(), "y0", "x0", "conf"))).where(F.col("n") <= most)
    mean = top.groupBy(page, "reader").agg(F.round(F.avg("conf"), 6).alias("conf"))
    return mean.groupBy(page).agg(F.min(F.struct((-F.col("conf")).alias("less"), "reader")).alias("b")).select(page, F.col("b.reader").alias("reader"), (-F.col("b.less")).alias("conf"))


def served_language(verdicts: DataFrame, served: list[str], bootstrap: list[str], margin: float = 0.05) -> DataFrame:
    """verdicts(lang, stage, margin) with `codes` and `resolved`: a language that isn't served and leads by little is left open, unless its script decides."""
    sure = (F.col("stage") == "block") | F.col("lang").isin(served) | (F.col("margin") >= margin)
    sure = F.coalesce(sure, F.lit(False)) & F.col("lang").isNotNull()
    return verdicts.withColumn("resolved", sure).withColumn("codes", F.when(sure, F.array("lang")).otherwise(F.array(*[F.lit(x) for x in bootstrap])))


def index_rows(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """(namespace, rid, doc, text): what goes into the vector log, a row for each value of fields(doc, field, category, value)
    and one for each of docs(doc, text) that says something: its own text, else its fields, cut at 2,000 characters."""
    name = F.when(F.coalesce("field", F.lit("")) != "", F.col("field")).otherwise(F.coalesce("category", F.lit("")))
    said = fields.select("doc", name.alias("field"), X.trimmed("value").alias("value")).where("value <> ''").withColumn("leaf", F.btrim(F.concat(F.replace("field", F.lit("_"), F.lit(" ")), F.lit(" "), "value")))
    leaves = said.select(F.lit("fields").alias("namespace"), F.concat(F.col("doc").cast("string"), F.lit("#"), "field").alias("rid"), "doc", F.col("leaf").alias("text"))
    every = said.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "leaf"))), lambda x: x["leaf"]), " ").alias("all"))
    own = X.trimmed("text")
    whole = docs.join(every, "doc", "left").select(F.lit("docs").alias("namespace"), F.col("doc").cast("string").alias("rid"), "doc", F.substring(F.when(own != "", own).otherwise(F.coalesce("all", F.lit(""))), 1, SUMMARY_CHARS).alias("text"))
    return leaves.unionByName(whole.where("text <> ''"))


def checked_anchors(phrases: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(phrase, vec): the distinct phrases(phrase) with a vector of vectors(phrase, vec) of `dim` numbers, at unit length."""
    named = phrases.select(F.btrim("phrase").alias("phrase")).where("phrase <> ''").distinct()
    rows = named.join(vectors.where(F.size("vec") == dim).dropDuplicates(["phrase"]), "phrase")
    length = F.greatest(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-8))
    return rows.select("phrase", F.transform("vec", lambda x: x.cast("double") / length).alias("vec"))


def page_text(pages: DataFrame, number: int, least_chars: int = 40, least_solid: int = 20) -> DataFrame:
    """(doc, page, text): one page of each document of pages(doc, page, text); its text only where it has a text layer."""
    t = X.trimmed("text")
    layer = (F.length(t) >= least_chars) & (F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) >= least_solid)
    return pages.where(F.col("page") == number).select("doc", "page", F.when(layer, t).alias("text"))
