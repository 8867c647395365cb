"""Greedy competition: suppression, gap bridging, exclusive assignment, patch arenas.

Greedy scans are folds over one document's or page's sorted candidates; their state is an array in the fold's
accumulator, so everything stays in the JVM and a group is one document, not more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled


def _first(test: Column) -> Column:
    """The 1-based place of the first true of an array of tests; 0 if none."""
    return F.array_position(test, True)


def _candidates(rows: DataFrame, group: str | list[str], order: list[Column], columns: list[str]) -> DataFrame:
    keys = [c.alias(f"_k{i}") for i, c in enumerate(order)]
    group = [group] if isinstance(group, str) else group
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*keys, *columns))).alias("c"))


def nms_spans(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, s, e, seq, field, score, absorbed): winners of spans(doc, seq, s, e, field, score) with their grown spans.

    Best score first (then the longer, then the earlier). A candidate that overlaps the grown span of a winner is
    absorbed by the first such winner, which widens; its text and score stay.
    """
    rows = _candidates(spans, doc, [-F.col("score"), F.col("s") - F.col("e"), F.col("s"), F.col("seq")], ["s", "e", "seq", "field", "score"])
    none = F.array().cast("array<struct<s:int,e:int,seq:int,field:string,score:double,absorbed:int>>")

    def step(acc: Column, x: Column) -> Column:
        at = _first(F.transform(acc, lambda w: (w["s"] < x["e"]) & (w["e"] > x["s"])))
        new = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["seq"].alias("seq"), x["field"].alias("field"), x["score"].alias("score"), F.lit(0).alias("absorbed"))

        def grow(w: Column, i: Column) -> Column:
            wide = F.struct(F.least(w["s"], x["s"]).alias("s"), F.greatest(w["e"], x["e"]).alias("e"), w["seq"].alias("seq"), w["field"].alias("field"), w["score"].alias("score"), (w["absorbed"] + 1).alias("absorbed"))
            return F.when(i + 1 == at, wide).otherwise(w)

        return F.when(at == 0, F.array_append(acc, new)).otherwise(F.transform(acc, grow))

    return rows.select(doc, F.explode(F.aggregate("c", none, step)).alias("w")).select(doc, "w.*")


def bridge_gaps(winners: DataFrame, totals: DataFrame, doc: str = "doc") -> DataFrame:
    """winners with gaps filled: the edges go to the outer winners, a gap between two to the higher score (left on a tie).

    totals(doc, n_words). Winners are walked from left to right, and a filled gap moves the left one's end.
    """
    order = Window.partitionBy(doc).orderBy("s", "seq")
    rows = winners.join(totals, doc).withColumns({"rn": F.row_number().over(order), "last": F.count("*").over(Window.partitionBy(doc)), "next_s": F.lead("s").over(order), "next_score": F.lead("score").over(order), "prev_e": F.lag("e").over(order), "prev_score": F.lag("score").over(order)})
    s = F.when(F.col("rn") == 1, F.lit(0)).when((F.col("s") > F.col("prev_e")) & (F.col("score") > F.col("prev_score")), F.col("prev_e")).otherwise(F.col("s"))
    e = F.when(F.col("rn") == F.col("last"), F.greatest("e", "n_words")).when((F.col("next_s") > F.col("e")) & ~(F.col("next_score") > F.col("score")), F.col("next_s")).otherwise(F.col("e"))
    return rows.select(doc, "seq", "field", "score", s.cast("int").alias("s"), e.cast("int").alias("e"))


def coverage(winners: DataFrame, totals: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, coverage): the share of a document's words inside any span."""
    before = Window.partitionBy(doc).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    rows = winners.withColumn("from", F.greatest("s", F.coalesce(F.max("e").over(before), F.lit(0))))
    covered = rows.groupBy(doc).agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.col("from"))).alias("covered"))
    return totals.join(covered, doc, "left").select(doc, F.when(F.col("n_words") > 0, F.coalesce("covered", F.lit(0)) / F.col("n_words")).otherwise(0.0).alias("coverage"))


def exclusive_assign(chunks: DataFrame, doc: str = "doc", least_margin: float = 0.0, many: tuple[str, ...] = ()) -> DataFrame:
    """(doc, seq, field, score, status) of chunks(doc, seq, s, e, field, score, confirmed): one chunk for a field, no two on a span.

    Confirmed chunks come first, in order, and only their field must be free; then the others by score: the field,
    then the span, then the margin (the score itself) decide. Fields in `many` take any number.
    """
    rows = _candidates(chunks, doc, [(~F.col("confirmed")).cast("int"), F.when(F.col("confirmed"), 0.0).otherwise(-F.col("score")), F.when(F.col("confirmed"), F.col("seq")).otherwise(F.col("s")), F.col("seq")], ["seq", "s", "e", "field", "score", "confirmed"])
    none = F.array().cast("array<struct<seq:int,s:int,e:int,field:string,score:double,status:string>>")

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda w: (w["status"] == "assigned") & (w["field"] == x["field"])) & ~x["field"].isin(*many) if many else F.exists(acc, lambda w: (w["status"] == "assigned") & (w["field"] == x["field"]))
        span = F.exists(acc, lambda w: (w["status"] == "assigned") & (w["s"] < x["e"]) & (w["e"] > x["s"]))
        status = F.when(taken, "field-taken").when(x["confirmed"], "assigned").when(span, "span-taken").when(x["score"] < least_margin, "below-margin").otherwise("assigned")
        return F.array_append(acc, F.struct(x["seq"].alias("seq"), x["s"].alias("s"), x["e"].alias("e"), x["field"].alias("field"), x["score"].alias("score"), status.alias("status")))

    return rows.select(doc, F.explode(F.aggregate("c", none, step)).alias("w")).select(doc, "w.seq", "w.field", "w.score", "w.status")


def plinko(scored: DataFrame, totals: DataFrame, doc: str = "doc", longest: int = 6, cliff: float = 0.75, gate: float = 0.0) -> DataFrame:
    """(doc, s, e, field, score): a cursor walks over a document's words and takes the best prefix at each stop.

    scored(doc, s, e, field, score) holds the best field of every window of up to `longest` words, totals(doc,
    n_words). A prefix grows until a score falls under `cliff` times the one before it, if that was over the gate.
    Without a score over the gate the cursor moves on by one word. Windows are dealt by document once; both
    aggregates and the join keep that order.
    """
    grown = scored.where(F.col("e") - F.col("s") <= longest).repartition(doc).groupBy(doc, "s").agg(F.array_sort(F.collect_list(F.struct("e", "field", "score"))).alias("p"))
    start = F.struct(F.lit(False).alias("over"), F.lit(None).cast("double").alias("prev"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("e"), F.lit(None).cast("string").alias("field"))

    def grow(acc: Column, x: Column) -> Column:
        better = acc["best"].isNull() | (x["score"] > acc["best"])
        falls = acc["prev"].isNotNull() & (x["score"] < acc["prev"] * cliff) & (acc["prev"] > gate)
        now = F.struct(falls.alias("over"), x["score"].alias("prev"), F.when(better, x["score"]).otherwise(acc["best"]).alias("best"), F.when(better, x["e"]).otherwise(acc["e"]).alias("e"), F.when(better, x["field"]).otherwise(acc["field"]).alias("field"))
        return F.when(acc["over"], acc).otherwise(now)

    stops = grown.select(doc, "s", F.aggregate("p", start, grow).alias("b")).select(doc, F.struct(F.col("s"), F.col("b.e").alias("e"), F.col("b.field").alias("field"), F.col("b.best").alias("score")).alias("stop"))
    walks = stops.groupBy(doc).agg(F.array_sort(F.collect_list("stop")).alias("stops")).join(totals, doc)
    none = F.array().cast("array<struct<s:int,e:int,field:string,score:double>>")

    def walk(acc: Column, x: Column) -> Column:
        hit = F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"), x["field"].alias("field"), x["score"].alias("score"))
        orphan = F.struct(x["s"].cast("int").alias("s"), (x["s"] + 1).cast("int").alias("e"), F.lit("unclassified").alias("field"), F.lit(0.0).alias("score"))
        taken = F.when(x["score"] > gate, hit).otherwise(orphan)
        moved = F.struct(F.array_append(acc["out"], taken).alias("out"), taken["e"].alias("cursor"))
        return F.when(x["s"] < acc["cursor"], acc).otherwise(moved)

    found = walks.select(doc, F.explode(F.aggregate("stops", F.struct(none.alias("out"), F.lit(0).alias("cursor")), walk)["out"]).alias("r"))
    return found.select(doc, "r.*")


def plinko_override(chunks: DataFrame, results: DataFrame, doc: str = "doc") -> DataFrame:
    """chunks with the field and score of a result on the same span, where that scores higher for another field."""
    hits = results.where("field <> 'unclassified'").select(doc, "s", "e", F.col("field").alias("_f"), F.col("score").alias("_s"))
    rows = chunks.join(hits, [doc, "s", "e"], "left")
    better = F.coalesce(~F.col("confirmed") & (F.col("_f") != F.col("field")) & (F.col("_s") > F.col("score")), F.lit(False))
    return rows.select(*[c for c in chunks.columns if c not in ("field", "score")], F.when(better, F.col("_f")).otherwise(F.col("field")).alias("field"), F.when(better, F.col("_s")).otherwise(F.col("score")).alias("score"), better.alias("replaced"))


def record_of(assigned: DataFrame, fields: list[str], doc: str = "doc") -> DataFrame:
    """(doc, field, n, value): every field of every document with its values in order of score, null if it got none."""
    docs = assigned.select(doc).distinct()
    names = assigned.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    got = assigned.where("status = 'assigned'").groupBy(doc, "field").agg(F.count("*").cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "seq"))), lambda x: x["seq"].cast("string")), "|").alias("value"))
    return docs.crossJoin(F.broadcast(names)).join(got, [doc, "field"], "left").select(doc, "field", F.coalesce("n", F.lit(0)).alias("n"), "value")


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 if they don't meet."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = [F.greatest(F.lit(0), x[2] - x[0]) * F.greatest(F.lit(0), x[3] - x[1]) for x in (a, b)]
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / (area[0] + area[1] - w * h))


def suppress_boxes(boxes: DataFrame, page: str = "page", threshold: float = 0.8) -> DataFrame:
    """(page, seq, x0, y0, x1, y1, score, absorbed): winners, whose boxes become the union with those they suppress."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    rows = _candidates(boxes, page, [-F.col("score"), -area, F.col("seq")], ["seq", "x0", "y0", "x1", "y1", "score"])
    none = F.array().cast("array<struct<seq:int,x0:int,y0:int,x1:int,y1:int,score:double,absorbed:int>>")

    def box(w: Column) -> tuple[Column, Column, Column, Column]:
        return w["x0"], w["y0"], w["x1"], w["y1"]

    def step(acc: Column, x: Column) -> Column:
        at = _first(F.transform(acc, lambda w: iou(box(w), box(x)) >= threshold))
        new = F.struct(x["seq"].alias("seq"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"), x["score"].alias("score"), F.lit(0).alias("absorbed"))

        def grow(w: Column, i: Column) -> Column:
            wide = F.struct(w["seq"].alias("seq"), F.least(w["x0"], x["x0"]).alias("x0"), F.least(w["y0"], x["y0"]).alias("y0"), F.greatest(w["x1"], x["x1"]).alias("x1"), F.greatest(w["y1"], x["y1"]).alias("y1"), w["score"].alias("score"), (w["absorbed"] + 1).alias("absorbed"))
            return F.when(i + 1 == at, wide).otherwise(w)

        return F.when(at == 0, F.array_append(acc, new)).otherwise(F.transform(acc, grow))

    return rows.select(page, F.explode(F.aggregate("c", none, step)).alias("w")).select(page, "w.*")


def region_margins(candidates: DataFrame, page: str = "page") -> DataFrame:
    """candidates with margin and rival: the lead over the second of a region, or how far behind its first."""
    order = Window.partitionBy(page, "region").orderBy(F.col("score").desc(), "seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = candidates.withColumns({"rn": F.row_number().over(order), "next": F.lead("score").over(order), "next_field": F.lead("field").over(order), "top": F.first("score").over(whole), "top_field": F.first("field").over(whole)})
    first = F.col("rn") == 1
    margin = F.when(first, F.col("score") - F.coalesce("next", F.lit(0.0))).otherwise(F.col("score") - F.col("top"))
    return rows.select(*candidates.columns, margin.alias("margin"), F.when(first, F.coalesce("next_field", F.lit(""))).otherwise(F.col("top_field")).alias("rival"))


def assign_regions(candidates: DataFrame, page: str = "page", least: float = 0.28) -> DataFrame:
    """(page, seq, field, region, status) of candidates with margins: one field for a region, one region for a field."""
    rows = _candidates(candidates, page, [-F.col("score"), -F.col("margin"), F.col("seq")], ["seq", "field", "region", "margin"])
    none = F.array().cast("array<struct<seq:int,field:string,region:int,status:string>>")

    def step(acc: Column, x: Column) -> Column:
        field = F.exists(acc, lambda w: (w["status"] == "confirmed") & (w["field"] == x["field"]))
        region = F.exists(acc, lambda w: (w["status"] == "confirmed") & (w["region"] == x["region"]))
        status = F.when(field, "exclusive_blocked").when(region, "region_taken").when(x["margin"] >= least, "confirmed").otherwise("below-margin")
        return F.array_append(acc, F.struct(x["seq"].alias("seq"), x["field"].alias("field"), x["region"].alias("region"), status.alias("status")))

    return rows.select(page, F.explode(F.aggregate("c", none, step)).alias("w")).select(page, "w.*")


def claim_patches(scores: DataFrame, chrome: DataFrame | None = None, margin: float = 0.12, page: list[str] | None = None) -> DataFrame:
    """(*page, idx, winner, score, rival, floor): patches of scores(*page, idx, category, score) whose best category leads by the margin.

    The best score must pass the second one and the chrome score chrome(*page, idx, chrome) of the patch.
    """
    page = page or []
    order = Window.partitionBy(*page, "idx").orderBy(F.col("score").desc(), "category")
    ranked = scores.where("score is not null").withColumns({"rn": F.row_number().over(order), "second": F.lead("score").over(order), "rival": F.lead("category").over(order)}).where("rn = 1")
    ranked = ranked.join(chrome, [*page, "idx"], "left") if chrome is not None else ranked.withColumn("chrome", F.lit(0.0))
    base = F.coalesce("chrome", F.lit(0.0))
    floor = F.greatest(F.coalesce("second", base), base)
    return ranked.withColumn("floor", floor).where(F.col("score") - F.col("floor") >= margin).select(*page, "idx", F.col("category").alias("winner"), "score", F.coalesce("rival", F.lit("")).alias("rival"), "floor")


def arena(scores: DataFrame, chrome: DataFrame | None = None, margin: float = 0.12, least: int = 2, rounds: int = 3, page: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(territories, verdicts): categories with fewer than `least` patches go and the others compete again.

    territories(*page, category, patches, peak, mean_margin, rival, absent). A page stops when no category is weak
    or fewer than two would be left. Rounds over pages are written, so that a plan holds one round; a single page's
    plan is unrolled, `rounds` times at most.
    """
    page = page or []
    scores = settled(scores)  # every round reads it again
    cats = scores.select(*page, "category").distinct()
    alive = scores
    for turn in range(1, rounds + 1):
        verdicts = claim_patches(alive, chrome, margin, page)
        sizes = verdicts.groupBy(*page, F.col("winner").alias("category")).agg(F.count("*").alias("patches"))
        state = alive.select(*page, "category").distinct().join(sizes, [*page, "category"], "left").withColumn("patches", F.coalesce("patches", F.lit(0)))
        if turn == rounds:
            break
        strong = state.where(F.col("patches") >= least)
        # a page goes on only if at least two categories would be left
        left = state.groupBy(*page).agg(F.count_if(F.col("patches") >= least).alias("left"))
        goes_on = settled(left.where("left >= 2").select(*page)) if page else None
        if page:
            kept = alive.join(strong.select(*page, "category"), [*page, "category"], "left_semi").join(goes_on, page, "left_semi")
            rest = alive.join(goes_on, page, "left_anti")
            alive = settled(kept.unionByName(rest))
        else:
            alive = alive.join(F.broadcast(strong.select("category")).crossJoin(F.broadcast(left.where("left >= 2"))), "category", "left_semi").unionByName(alive.crossJoin(F.broadcast(left.where("left < 2").drop("left"))).select(alive.columns))
    gap = F.col("score") - F.col("floor")
    stats = verdicts.groupBy(*page, F.col("winner").alias("category")).agg(F.count("*").alias("patches"), F.max("score").alias("peak"), F.avg(gap).alias("mean_margin"))
    rivals = verdicts.where("rival <> ''").groupBy(*page, F.col("winner").alias("category"), "rival").agg(F.count("*").alias("c"), F.min("idx").alias("first"))
    modal = rivals.groupBy(*page, "category").agg(F.max(F.struct("c", (-F.col("first")).alias("f"), "rival")).alias("m")).select(*page, "category", F.col("m.rival").alias("rival"))
    out = cats.join(stats, [*page, "category"], "left").join(modal, [*page, "category"], "left")
    out = out.withColumns({"patches": F.coalesce("patches", F.lit(0)), "absent": F.coalesce(F.col("patches") < least, F.lit(True))})
    return out, verdicts


def apply_arena(scores: DataFrame, territories: DataFrame, verdicts: DataFrame, page: list[str] | None = None) -> DataFrame:
    """scores of present categories on the patches that they own."""
    page = page or []
    owned = verdicts.select(*page, "idx", F.col("winner").alias("category"))
    return scores.join(owned, [*page, "idx", "category"], "left_semi").join(territories.where("not absent").select(*page, "category"), [*page, "category"], "left_semi")


def territory_scores(verdicts: DataFrame, patches: DataFrame, category: str) -> DataFrame:
    """(idx, score) for every patch: the margin where the category owns it, else null."""
    own = verdicts.where(F.col("winner") == category).select("idx", (F.col("score") - F.col("floor")).alias("score"))
    return patches.select("idx").join(own, "idx", "left")


def present(territories: DataFrame, scores: DataFrame) -> DataFrame:
    """(category) that are not absent and own a patch or have a score anywhere."""
    some = scores.where("score is not null").select("category").distinct().withColumn("some", F.lit(True))
    return territories.join(some, "category", "left").where("not absent and (patches > 0 or some)").select("category")
