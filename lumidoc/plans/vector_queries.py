"""Queries over vectors, grids, spans and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import compete as N
from ..operators import heatmap as H
from ..operators import scoring as S
from ..sources import vectorlog as D
from .registry import Tables, query

COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"


@query(
    f"""
SELECT qid, vec_id, round(sim, 6) AS score, rank::INT AS rank FROM (
  SELECT a.vec_id AS qid, b.vec_id, {COS.format("a.embedding", "b.embedding")} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS.format("a.embedding", "b.embedding")}, 12) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 10"""
)
def vector_topk(t: Tables) -> DataFrame:
    e = t("embeddings").withColumnRenamed("embedding", "vec")
    found = S.top_k(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), e, "qid", "vec_id", 10)
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""
SELECT qid, vec_id, round(sim, 6) AS score, rank::INT AS rank FROM (
  SELECT a.vec_id AS qid, b.vec_id, {COS.format("a.embedding", "b.embedding")} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS.format("a.embedding", "b.embedding")}, 12) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.label < 5) WHERE rank <= 1"""
)
def vector_topk_filtered(t: Tables) -> DataFrame:
    """The payload predicate goes to the scan; k = 0 still gives one hit."""
    e = t("embeddings").withColumnRenamed("embedding", "vec")
    found = S.top_k(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), e.where("label < 5"), "qid", "vec_id", 0)
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


LAST = "SELECT * FROM vlog QUALIFY row_number() OVER (PARTITION BY rid ORDER BY seq DESC) = 1"


@query(f"SELECT rid, seq, label FROM ({LAST}) WHERE live", ("vlog",))
def vlog_latest(t: Tables) -> DataFrame:
    return D.latest(t.fixture("vlog")).select("rid", "seq", "label")


@query(f"SELECT live, dead, live > 0 AND dead >= 64 AND dead >= 0.35 * live AS compact FROM (SELECT count(*) FILTER (live) AS live, (SELECT count(*) FROM vlog) - count(*) FILTER (live) AS dead FROM ({LAST}))", ("vlog",))
def vlog_compaction_stats(t: Tables) -> DataFrame:
    return D.stats(t.fixture("vlog"))


POOL = f"SELECT e.vec_id, b.field, b.kind, max({COS.format('e.embedding', 'b.vec')} * b.weight) AS s FROM embeddings e, bank b GROUP BY ALL"
SURPRISAL = f"""
p AS ({POOL}), w AS (SELECT vec_id, field, max(s) FILTER (kind = 'bias') AS bias, greatest(0, coalesce(max(s) FILTER (kind = 'prejudice'), 0)) AS prejudice FROM p GROUP BY ALL),
g AS (SELECT field, CASE WHEN count(*) <= 1 THEN 0 ELSE sqrt(2 * ln(count(*))) END AS g FROM bank WHERE kind = 'bias' GROUP BY 1),
z AS (SELECT vec_id, field, bias, prejudice, bias - prejudice AS net, (g - avg(g) OVER v) * 0.25 AS penalty, CASE WHEN stddev_pop(bias - prejudice) OVER v < 1e-8 THEN 0 ELSE (bias - prejudice - avg(bias - prejudice) OVER v) / stddev_pop(bias - prejudice) OVER v END AS z
  FROM w JOIN g USING (field) WINDOW v AS (PARTITION BY vec_id)),
s AS (SELECT *, z - penalty AS surprisal, row_number() OVER (PARTITION BY vec_id ORDER BY round(z - penalty, 9) DESC, field) AS rank FROM z)
"""


@query(f"WITH {SURPRISAL} SELECT vec_id, field, round(net, 6) AS net, round(z, 5) AS z, round(penalty, 6) AS penalty, round(surprisal, 5) AS surprisal, rank::INT AS rank FROM s", ("bank",))
def surprisal_scores(t: Tables) -> DataFrame:
    scores = S.surprisal(t("embeddings").select("vec_id", F.col("embedding").alias("vec")), t.fixture("bank"), "vec_id")
    return scores.select("vec_id", "field", F.round("net", 6).alias("net"), F.round("z", 5).alias("z"), F.round("penalty", 6).alias("penalty"), F.round("surprisal", 5).alias("surprisal"), "rank")


@query(
    f"""WITH {SURPRISAL} SELECT vec_id, CASE WHEN count(*) FILTER (surprisal > 1.0) > 0 THEN max(field) FILTER (rank = 1) END AS field, round(max(surprisal) FILTER (rank = 1), 5) AS score,
  round(max(surprisal) FILTER (rank = 1) - max(surprisal) FILTER (rank = 2), 5) AS margin, count(*) FILTER (surprisal > 1.0) AS passed FROM s GROUP BY 1""",
    ("bank",),
)
def surprisal_top(t: Tables) -> DataFrame:
    scores = S.surprisal(t("embeddings").select("vec_id", F.col("embedding").alias("vec")), t.fixture("bank"), "vec_id")
    return S.top_fields(scores, "vec_id", 1.0).select("vec_id", "field", F.round("score", 5).alias("score"), F.round("margin", 5).alias("margin"), "passed")


@query(
    f"""WITH w AS (SELECT e.vec_id, b.field, b.kind, {COS.format("e.embedding", "b.vec")} * b.weight AS s, b.ord FROM embeddings e, bank b)
SELECT vec_id, field, kind, round(s, 6) AS score, ord FROM w QUALIFY row_number() OVER (PARTITION BY vec_id, field, kind ORDER BY s DESC, ord) = 1""",
    ("bank",),
)
def weighted_max_pool(t: Tables) -> DataFrame:
    return S.max_pool(t("embeddings").select("vec_id", F.col("embedding").alias("vec")), t.fixture("bank"), "vec_id", ["field", "kind"]).withColumn("score", F.round("score", 6))


NEUTRAL = f"""
m AS (SELECT p.idx, b.field, max({COS.format("p.vec", "b.vec")}) AS s FROM patches p, bank b WHERE b.kind = 'bias' GROUP BY ALL),
ch AS (SELECT idx, CASE WHEN stddev_pop(s) OVER () < 1e-8 THEN 0 ELSE (s - avg(s) OVER ()) / stddev_pop(s) OVER () END AS z FROM (SELECT p.idx, max({COS.format("p.vec", "b.vec")}) AS s FROM patches p, bank b WHERE b.kind = 'prejudice' GROUP BY 1)),
c AS (SELECT idx, field, s - avg(s) OVER (PARTITION BY field) AS x FROM m), sd AS (SELECT sqrt(avg(x * x)) AS sd FROM c),
d AS (SELECT idx, field, x / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END - greatest(0, coalesce(z, 0)) AS x FROM c CROSS JOIN sd LEFT JOIN ch USING (idx)),
neutral AS (SELECT idx, field, x - avg(x) OVER (PARTITION BY idx) AS neutral FROM d)
"""


def _neutral(t: Tables) -> DataFrame:
    patches, bank = t.fixture("patches").select("idx", "vec"), t.fixture("bank").withColumn("weight", F.lit(1.0))
    pooled = S.max_pool(patches, bank, "idx", ["field", "kind"])
    chrome = pooled.where("kind = 'prejudice'").groupBy("idx").agg(F.max("score").alias("score"))
    chrome = chrome.select("idx", S.z_score(F.col("score"), Window.partitionBy(F.lit(0))).alias("z"))
    return S.bank_neutral(pooled.where("kind = 'bias'").select("idx", "field", "score"), "field", "idx", chrome)


@query(f"WITH {NEUTRAL} SELECT idx, field, round(neutral, 6) AS neutral FROM neutral", ("patches", "bank"))
def bank_neutral_matrix(t: Tables) -> DataFrame:
    return _neutral(t).select("idx", "field", F.round("neutral", 6).alias("neutral"))


@query(
    f"""WITH {NEUTRAL}, r AS (SELECT n.field, max(neutral) AS body, max(neutral) FILTER (p.r < 6) AS title FROM neutral n JOIN patches p USING (idx) GROUP BY 1),
f AS (SELECT field, body + 2 * title AS fused FROM r)
SELECT field, round(fused, 6) AS fused, row_number() OVER (ORDER BY fused DESC, field)::INT AS rank, round(fused - lead(fused) OVER (ORDER BY fused DESC, field), 6) AS margin FROM f""",
    ("patches", "bank"),
)
def doc_code_fusion(t: Tables) -> DataFrame:
    """A code's best patch anywhere and, twice as heavy, in the title band of the first 28 % of 20 rows."""
    rows = _neutral(t).join(F.broadcast(t.fixture("patches").select("idx", "r")), "idx")
    fused = rows.groupBy("field").agg((F.max("neutral") + 2 * F.max(F.when(F.col("r") < max(2, round(0.28 * 20)), F.col("neutral")))).alias("fused"))
    order = Window.orderBy(F.col("fused").desc(), "field")
    return fused.select("field", F.round("fused", 6).alias("fused"), F.row_number().over(order).alias("rank"), F.round(F.col("fused") - F.lead("fused").over(order), 6).alias("margin"))


HEAT = f"""
hp AS (SELECT p.idx, b.field AS category, b.kind, max({COS.format("p.vec", "b.vec")} * b.weight) AS s FROM patches p, bank b GROUP BY ALL),
hn AS (SELECT idx, category, max(s) FILTER (kind = 'bias') - greatest(0, coalesce(max(s) FILTER (kind = 'prejudice'), 0)) AS net FROM hp GROUP BY ALL),
hz AS (SELECT idx, category, net, (net - avg(net) OVER v) / stddev_pop(net) OVER v AS z FROM hn WINDOW v AS (PARTITION BY idx)),
heat AS (SELECT idx, category, net, (z - avg(z) OVER v) / stddev_pop(z) OVER v AS score FROM hz WINDOW v AS (PARTITION BY category))
"""


def _heat(t: Tables) -> DataFrame:
    return H.calibrated(t.fixture("patches").select("idx", "vec"), t.fixture("bank"))


def _placed(t: Tables) -> DataFrame:
    return _heat(t).join(F.broadcast(t.fixture("patches").select("idx", "r", "c")), "idx")


@query(f"WITH {HEAT} SELECT idx, category, round(net, 6) AS net, round(score, 5) AS score FROM heat", ("patches", "bank"))
def heatmap_calibrated(t: Tables) -> DataFrame:
    return _heat(t).select("idx", "category", F.round("net", 6).alias("net"), F.round("score", 5).alias("score"))


@query(f"WITH {HEAT} SELECT idx, category, round(score - CASE WHEN r < 2 AND category NOT IN ('f0', 'f1') THEN 0.5 ELSE 0 END, 5) AS score FROM heat JOIN patches USING (idx)", ("patches", "bank"))
def title_suppressed(t: Tables) -> DataFrame:
    return H.suppress_titles(_placed(t), 20, ["f0", "f1"]).select("idx", "category", F.round("score", 5).alias("score"))


@query(
    f"""WITH {HEAT}, g AS (SELECT idx, r, c, category, score FROM heat JOIN patches USING (idx)), sh AS (SELECT category, count(*) FILTER (score > 0) / count(*) AS share FROM g GROUP BY 1),
mid AS (SELECT list_sort(list(share))[count(*) // 2 + 1] AS mid FROM sh), dev AS (SELECT mid, list_sort(list(abs(share - mid)))[count(*) // 2 + 1] AS dev FROM sh, mid GROUP BY mid),
res AS (SELECT g.*, share >= mid + CASE WHEN dev > 1e-6 THEN dev ELSE 0 END AS diffuse, score - avg(score) OVER (PARTITION BY category, r) - avg(score) OVER (PARTITION BY category, c) + avg(score) OVER (PARTITION BY category) AS x FROM g JOIN sh USING (category), dev)
SELECT idx, category, round(CASE WHEN diffuse THEN x ELSE score END, 5) AS score FROM res""",
    ("patches", "bank"),
)
def spatial_residual(t: Tables) -> DataFrame:
    return H.spatial_residual(_placed(t)).select("idx", "category", F.round("score", 5).alias("score"))


@query(
    f"""WITH {HEAT} SELECT category, round(coalesce(avg(score) FILTER (score > 0), 0), 6) AS mean, round(coalesce(stddev_pop(score) FILTER (score > 0), 0), 6) AS sd, count(*) FILTER (score > 0) AS n,
  round(CASE WHEN count(*) FILTER (score > 0) < 4 THEN 0 ELSE avg(score) FILTER (score > 0) + stddev_pop(score) FILTER (score > 0) END, 6) AS gate FROM heat GROUP BY 1""",
    ("patches", "bank"),
)
def positive_stats(t: Tables) -> DataFrame:
    r = H.positive_stats(_heat(t))
    return r.select("category", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n", F.round("gate", 6).alias("gate"))


def _round(n: int, src: str) -> str:
    return f"""r{n} AS (SELECT idx, category AS winner, score, rival, floor FROM (SELECT *, row_number() OVER w AS rn, lead(category) OVER w AS rival, greatest(coalesce(lead(score) OVER w, 0), 0) AS floor FROM {src} WINDOW w AS (PARTITION BY idx ORDER BY score DESC, category)) WHERE rn = 1 AND score - floor >= 0.3),
t{n} AS (SELECT c.category, count(r.idx) AS patches FROM (SELECT DISTINCT category FROM {src}) c LEFT JOIN r{n} r ON r.winner = c.category GROUP BY 1),
s{n} AS (SELECT * FROM {src} WHERE (SELECT count(*) FROM t{n} WHERE patches >= 20) < 2 OR category IN (SELECT category FROM t{n} WHERE patches >= 20))"""


ARENA = f"{HEAT}, {_round(1, 'heat')}, {_round(2, 's1')}, {_round(3, 's2')}"


@query(f"WITH {HEAT}, {_round(1, 'heat')} SELECT idx, winner, round(score, 5) AS score, coalesce(rival, '') AS rival FROM r1", ("patches", "bank"))
def arena_round1(t: Tables) -> DataFrame:
    return N.claim_patches(_heat(t), None, 0.3).select("idx", "winner", F.round("score", 5).alias("score"), "rival")


@query(
    f"""WITH {ARENA}, m AS (SELECT winner, rival, count(*) AS c, min(idx) AS first FROM r3 WHERE rival IS NOT NULL GROUP BY ALL), top AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY winner ORDER BY c DESC, first) = 1)
SELECT c.category, count(r.idx) AS patches, round(max(r.score), 5) AS peak, round(avg(r.score - r.floor), 5) AS mean_margin, any_value(top.rival) AS rival, count(r.idx) < 20 AS absent
FROM (SELECT DISTINCT category FROM heat) c LEFT JOIN r3 r ON r.winner = c.category LEFT JOIN top ON top.winner = c.category GROUP BY 1""",
    ("patches", "bank"),
)
def arena_final(t: Tables) -> DataFrame:
    out, _ = N.arena(_heat(t), None, 0.3, 20, 3)
    return out.select("category", "patches", F.round("peak", 5).alias("peak"), F.round("mean_margin", 5).alias("mean_margin"), "rival", "absent")


@query(f"WITH {ARENA} SELECT idx, winner AS category, round(score, 5) AS score FROM r3 WHERE winner IN (SELECT winner FROM r3 GROUP BY 1 HAVING count(*) >= 20)", ("patches", "bank"))
def arena_applied(t: Tables) -> DataFrame:
    heat = _heat(t)
    out, verdicts = N.arena(heat, None, 0.3, 20, 3)
    return N.apply_arena(heat, out, verdicts).select("idx", "category", F.round("score", 5).alias("score"))


@query(f"SELECT label, round(CASE WHEN count(*) < 2 THEN 0 ELSE least(1, greatest(0, avg(s))) END, 6)::DOUBLE AS cohesion FROM (SELECT a.label, {COS.format('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) GROUP BY 1")
def cohesion_by_label(t: Tables) -> DataFrame:
    return S.cohesion(t("embeddings"), "label", "vec_id", "embedding").select("label", F.round("cohesion", 6).alias("cohesion"))


@query(
    """WITH r AS (SELECT page, score, row_number() OVER (PARTITION BY page ORDER BY score DESC) AS rn FROM boxes),
a AS (SELECT page, count(*) AS n, max(score) FILTER (rn = 1) - max(score) FILTER (rn = 2) AS m12, stddev_pop(score) FILTER (rn > 1) AS sd FROM r GROUP BY 1)
SELECT page, round(CASE WHEN n < 2 THEN 0 ELSE m12 END, 6)::DOUBLE AS m12, round(CASE WHEN n < 2 OR sd <= 1e-6 THEN 0 ELSE sd END, 6)::DOUBLE AS band, CASE WHEN n < 2 THEN true WHEN sd <= 1e-6 THEN m12 > 0 ELSE round(m12, 9) >= round(sd, 9) END AS decisive FROM a""",
    ("boxes",),
)
def decisive_margin(t: Tables) -> DataFrame:
    r = S.decisive_margin(t.fixture("boxes"), "page")
    return r.select("page", F.round("m12", 6).alias("m12"), F.round("band", 6).alias("band"), "decisive")


@query(
    f"""WITH c AS (SELECT idx AS claim, vec, r // 2 AS r0, r // 2 + 4 AS r1, c // 2 AS c0, c // 2 + 6 AS c1 FROM patches),
s AS (SELECT c.claim, {COS.format("c.vec", "p.vec")} AS sim, p.r BETWEEN r0 AND r1 AND p.c BETWEEN c0 AND c1 AS inside FROM c, patches p),
a AS (SELECT claim, avg(sim) AS m, greatest(stddev_pop(sim), 1e-6) AS sd, max(sim) FILTER (inside) AS i, max(sim) FILTER (NOT inside) AS o, count(*) FILTER (inside) AS ni, count(*) FILTER (NOT inside) AS no FROM s GROUP BY 1),
z AS (SELECT claim, (i - m) / sd - sqrt(2 * ln(ni)) AS s_in, (o - m) / sd - sqrt(2 * ln(no)) AS s_out FROM a)
SELECT claim, round(s_in, 5) AS s_in, round(s_out, 5) AS s_out, s_in >= s_out OR s_out - s_in < 0.5 AS accepted FROM z""",
    ("patches",),
)
def grounding_verdicts(t: Tables) -> DataFrame:
    p = t.fixture("patches").withColumn("page", F.lit(1))
    half = lambda c: F.floor(F.col(c) / 2)
    claims = p.select("page", F.col("idx").alias("claim"), "vec", half("r").alias("r0"), (half("r") + 4).alias("r1"), half("c").alias("c0"), (half("c") + 6).alias("c1"))
    v = H.grounded(claims, p, "page")
    return v.select("claim", F.round("s_in", 5).alias("s_in"), F.round("s_out", 5).alias("s_out"), "accepted")


OTSU = """
v AS (SELECT label, embedding[1]::DOUBLE AS v FROM embeddings), lim AS (SELECT label, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1),
h AS (SELECT label, lo, hi, least(63, floor((v - lo) / ((hi - lo) / 64))) AS bin, count(*) AS n FROM v JOIN lim USING (label) GROUP BY ALL),
x AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 64) AS centre FROM h),
y AS (SELECT *, sum(n) OVER a AS total, sum(n * centre) OVER a AS mass, sum(n) OVER b AS w0, sum(n * centre) OVER b AS m0 FROM x WINDOW a AS (PARTITION BY label), b AS (PARTITION BY label ORDER BY bin)),
z AS (SELECT label, bin, centre, round(CASE WHEN total > w0 THEN w0 * (total - w0) * pow(m0 / w0 - (mass - m0) / (total - w0), 2) ELSE 0 END, 9) AS b FROM y)
"""


@query(f"WITH {OTSU} SELECT label, round(centre, 6) AS gate FROM z QUALIFY row_number() OVER (PARTITION BY label ORDER BY b DESC, bin) = 1")
def otsu_gate(t: Tables) -> DataFrame:
    values = t("embeddings").select("label", F.element_at("embedding", 1).cast("double").alias("value"))
    return S.otsu(values, "value", ["label"]).select("label", F.round("gate", 6).alias("gate"))


@query(
    """WITH x AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, 0::BIGINT AS bad, (SELECT round(quantile_cont(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0.5), 6) FROM embeddings) AS median_norm FROM x"""
)
def describe_vectors(t: Tables) -> DataFrame:
    d = S.describe(t("embeddings"), "embedding")
    return d.select(*[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "sd")], "bad", F.round("median_norm", 6).alias("median_norm"))


@query(
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 448.0 AS scale FROM embeddings)
SELECT vec_id, round(scale, 9) AS scale, round(list_sum(list_transform(v, lambda x: round_even(x / scale / pow(2, greatest(floor(log2(greatest(abs(x / scale), pow(2, -9)))), -6) - 3), 0) * pow(2, greatest(floor(log2(greatest(abs(x / scale), pow(2, -9)))), -6) - 3))), 6) AS total FROM s"""
)
def quantize_fp8(t: Tables) -> DataFrame:
    r = t("embeddings").select("vec_id", S.quantize_fp8(F.col("embedding")).alias("x"))
    return r.select("vec_id", F.round("x.scale", 9).alias("scale"), F.round(F.aggregate("x.q", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


NMS = """
c AS (SELECT doc, seq, s, e, field, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, e - s DESC, s, seq) AS k FROM spans),
step AS (
  SELECT doc, 1 AS k, [{'s': s, 'e': e, 'seq': seq, 'field': field, 'score': score, 'absorbed': 0}] AS w FROM c WHERE k = 1
  UNION ALL
  SELECT x.doc, x.k + 1, CASE WHEN pos IS NULL OR pos = 0 THEN list_append(w, {'s': cs, 'e': ce, 'seq': cseq, 'field': cfield, 'score': cscore, 'absorbed': 0})
    ELSE list_transform(w, lambda y, i: CASE WHEN i = pos THEN {'s': least(y.s, cs), 'e': greatest(y.e, ce), 'seq': y.seq, 'field': y.field, 'score': y.score, 'absorbed': y.absorbed + 1} ELSE y END) END
  FROM (SELECT step.doc, step.k, w, c.s AS cs, c.e AS ce, c.seq AS cseq, c.field AS cfield, c.score AS cscore, list_position(list_transform(w, lambda y: y.s < c.e AND y.e > c.s), true) AS pos FROM step JOIN c ON c.doc = step.doc AND c.k = step.k + 1) x
),
winners AS (SELECT doc, x.s AS s, x.e AS e, x.seq AS seq, x.field AS field, x.score AS score, x.absorbed AS absorbed FROM (SELECT doc, unnest(w) AS x FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY doc ORDER BY k DESC) = 1)))
"""


@query(f"WITH {NMS} SELECT doc, s, e, seq, field, score, absorbed FROM winners", ("spans",))
def nms_spans(t: Tables) -> DataFrame:
    return N.nms_spans(t.fixture("spans"))


def _winners(t: Tables) -> tuple[DataFrame, DataFrame]:
    spans = t.fixture("spans")
    return N.nms_spans(spans), spans.select("doc").distinct().withColumn("n_words", F.lit(50))


@query(
    f"""WITH {NMS}, o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY doc) AS n, lead(s) OVER w AS ns, lead(score) OVER w AS nscore, lag(e) OVER w AS pe, lag(score) OVER w AS pscore FROM winners WINDOW w AS (PARTITION BY doc ORDER BY s, seq))
SELECT doc, seq, field, score, CASE WHEN rn = 1 THEN 0 WHEN s > pe AND score > pscore THEN pe ELSE s END AS s, CASE WHEN rn = n THEN greatest(e, 50) WHEN ns > e AND NOT nscore > score THEN ns ELSE e END AS e FROM o""",
    ("spans",),
)
def gap_bridge(t: Tables) -> DataFrame:
    return N.bridge_gaps(*_winners(t))


@query(f"WITH {NMS}, d AS (SELECT DISTINCT doc, unnest(range(s, e)) AS w FROM winners) SELECT doc, round(count(*) / 50, 6) AS coverage FROM d GROUP BY 1", ("spans",))
def span_coverage(t: Tables) -> DataFrame:
    return N.coverage(*_winners(t)).select("doc", F.round("coverage", 6).alias("coverage"))


ASSIGN = """
c AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN confirmed THEN 0 ELSE 1 END, CASE WHEN confirmed THEN 0 ELSE -score END, CASE WHEN confirmed THEN seq ELSE s END, seq) AS k FROM spans),
step AS (
  SELECT doc, 0 AS k, [{'seq': 0, 's': 0, 'e': 0, 'field': '', 'score': 0::DOUBLE, 'status': 'none'}] AS w FROM (SELECT DISTINCT doc FROM c)
  UNION ALL
  SELECT step.doc, step.k + 1, list_append(w, {'seq': c.seq, 's': c.s, 'e': c.e, 'field': c.field, 'score': c.score, 'status':
    CASE WHEN len(list_filter(w, lambda y: y.status = 'assigned' AND y.field = c.field)) > 0 THEN 'field-taken' WHEN c.confirmed THEN 'assigned'
      WHEN len(list_filter(w, lambda y: y.status = 'assigned' AND y.s < c.e AND y.e > c.s)) > 0 THEN 'span-taken' WHEN c.score < 0.28 THEN 'below-margin' ELSE 'assigned' END})
  FROM step JOIN c ON c.doc = step.doc AND c.k = step.k + 1
),
assigned AS (SELECT doc, x.seq AS seq, x.field AS field, x.score AS score, x.status AS status FROM (SELECT doc, unnest(w) AS x FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY doc ORDER BY k DESC) = 1)) WHERE x.status <> 'none')
"""


@query(f"WITH {ASSIGN} SELECT * FROM assigned", ("spans",))
def exclusive_assign(t: Tables) -> DataFrame:
    return N.exclusive_assign(t.fixture("spans"), "doc", 0.28)


@query(
    f"""WITH {ASSIGN}, f(field) AS (VALUES ('f0'), ('f1'), ('f2'), ('f3'), ('f4'))
SELECT d.doc, f.field, count(a.seq)::INT AS n, string_agg(a.seq::VARCHAR, '|' ORDER BY a.score DESC, a.seq) AS value FROM (SELECT DISTINCT doc FROM assigned) d CROSS JOIN f LEFT JOIN assigned a ON a.doc = d.doc AND a.field = f.field AND a.status = 'assigned' GROUP BY ALL""",
    ("spans",),
)
def assigned_record(t: Tables) -> DataFrame:
    return N.record_of(N.exclusive_assign(t.fixture("spans"), "doc", 0.28), ["f0", "f1", "f2", "f3", "f4"])


BIOU = "greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0))"


def _iou(a: str, b: str) -> str:
    i = BIOU.format(a=a, b=b)
    return f"({i})::DOUBLE / (({a}x1 - {a}x0) * ({a}y1 - {a}y0) + ({b}x1 - {b}x0) * ({b}y1 - {b}y0) - ({i}))"


@query(
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, (x1 - x0) * (y1 - y0) DESC, seq) AS k FROM boxes),
step AS (
  SELECT page, 1 AS k, [{{'seq': seq, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': score, 'absorbed': 0}}] AS w FROM c WHERE k = 1
  UNION ALL
  SELECT q.page, q.k + 1, CASE WHEN pos IS NULL OR pos = 0 THEN list_append(w, {{'seq': b.seq, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1, 'score': b.score, 'absorbed': 0}})
    ELSE list_transform(w, lambda y, i: CASE WHEN i = pos THEN {{'seq': y.seq, 'x0': least(y.x0, b.x0), 'y0': least(y.y0, b.y0), 'x1': greatest(y.x1, b.x1), 'y1': greatest(y.y1, b.y1), 'score': y.score, 'absorbed': y.absorbed + 1}} ELSE y END) END
  FROM (SELECT step.page, step.k, w, c AS b, list_position(list_transform(w, lambda y: {_iou("y.", "c.")} >= 0.3), true) AS pos FROM step JOIN c ON c.page = step.page AND c.k = step.k + 1) q
)
SELECT page, x.seq AS seq, x.x0 AS x0, x.y0 AS y0, x.x1 AS x1, x.y1 AS y1, x.score AS score, x.absorbed AS absorbed FROM (SELECT page, unnest(w) AS x FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1))""",
    ("boxes",),
)
def nms_iou(t: Tables) -> DataFrame:
    return N.suppress_boxes(t.fixture("boxes"), "page", 0.3)


MARGINS = """
m AS (SELECT *, CASE WHEN rn = 1 THEN score - coalesce(ns, 0) ELSE score - top END AS margin, CASE WHEN rn = 1 THEN coalesce(nf, '') ELSE tf END AS rival FROM (
  SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS ns, lead(field) OVER w AS nf, first(score) OVER w AS top, first(field) OVER w AS tf FROM boxes WINDOW w AS (PARTITION BY page, region ORDER BY score DESC, seq)))
"""


@query(f"WITH {MARGINS} SELECT page, seq, region, round(margin, 6) AS margin, rival FROM m", ("boxes",))
def region_margins(t: Tables) -> DataFrame:
    return N.region_margins(t.fixture("boxes")).select("page", "seq", "region", F.round("margin", 6).alias("margin"), "rival")


@query(
    f"""WITH {MARGINS}, c AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, margin DESC, seq) AS k FROM m),
step AS (
  SELECT page, 0 AS k, [{{'seq': 0, 'field': '', 'region': 0, 'status': 'none'}}] AS w FROM (SELECT DISTINCT page FROM c)
  UNION ALL
  SELECT step.page, step.k + 1, list_append(w, {{'seq': c.seq, 'field': c.field, 'region': c.region, 'status': CASE WHEN len(list_filter(w, lambda y: y.status = 'confirmed' AND y.field = c.field)) > 0 THEN 'exclusive_blocked'
    WHEN len(list_filter(w, lambda y: y.status = 'confirmed' AND y.region = c.region)) > 0 THEN 'region_taken' WHEN c.margin >= 0.28 THEN 'confirmed' ELSE 'below-margin' END}})
  FROM step JOIN c ON c.page = step.page AND c.k = step.k + 1
)
SELECT page, x.seq AS seq, x.field AS field, x.region AS region, x.status AS status FROM (SELECT page, unnest(w) AS x FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1)) WHERE x.status <> 'none'""",
    ("boxes",),
)
def exclusive_regions(t: Tables) -> DataFrame:
    return N.assign_regions(N.region_margins(t.fixture("boxes")))


@query(
    """WITH cells AS (SELECT 'a' AS category, r, c FROM patches WHERE (idx * 7919 + 13) % 100 < 58), n AS (SELECT *, r * 100000 + c AS id FROM cells),
walk AS (SELECT category, r, c, id AS root FROM n UNION SELECT n.category, n.r, n.c, w.root FROM walk w JOIN n ON abs(n.r - w.r) + abs(n.c - w.c) = 1)
SELECT category, r, c, min(root) AS comp FROM walk GROUP BY ALL""",
    ("patches",),
)
def grid_components(t: Tables) -> DataFrame:
    cells = t.fixture("patches").where("(idx * 7919 + 13) % 100 < 58").select(F.lit("a").alias("category"), "r", "c")
    return H.grid_components(cells)


@query(
    """WITH rows AS (SELECT r, count(*) FILTER ((idx * 31 + r * 17) % 10 < r % 7) AS n FROM patches GROUP BY 1), act AS (SELECT n::DOUBLE AS v FROM rows WHERE n > 0), lim AS (SELECT min(v) AS lo, max(v) AS hi FROM act),
h AS (SELECT lo, hi, least(63, floor((v - lo) / ((hi - lo) / 64))) AS bin, count(*) AS n FROM act, lim GROUP BY ALL), x AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 64) AS centre FROM h),
y AS (SELECT *, sum(n) OVER () AS total, sum(n * centre) OVER () AS mass, sum(n) OVER b AS w0, sum(n * centre) OVER b AS m0 FROM x WINDOW b AS (ORDER BY bin)),
g AS (SELECT centre AS gate FROM (SELECT bin, centre, round(CASE WHEN total > w0 THEN w0 * (total - w0) * pow(m0 / w0 - (mass - m0) / (total - w0), 2) ELSE 0 END, 9) AS b FROM y) ORDER BY b DESC, bin LIMIT 1),
d AS (SELECT r, r - row_number() OVER (ORDER BY r) AS i FROM rows, g WHERE n >= greatest(gate, (SELECT quantile_cont(v, 0.5) FROM act)))
SELECT min(r) AS r0, max(r) AS r1, count(*) AS span FROM d GROUP BY i HAVING count(*) >= 1 ORDER BY span DESC, r0 LIMIT 1""",
    ("patches",),
)
def table_band(t: Tables) -> DataFrame:
    rows = t.fixture("patches").groupBy("r").agg(F.count_if((F.col("idx") * 31 + F.col("r") * 17) % 10 < F.col("r") % 7).alias("n"))
    return H.dense_band(rows, 1)


WINDOWS = "SELECT a.doc, a.s, (a.s + k)::INT AS e, 'f' || ((a.s + k * 3) % 4)::VARCHAR AS field, round(((a.s * 7 + k * 13 + a.doc) % 19) / 10.0 - 0.4, 4)::DOUBLE AS score FROM (SELECT o_orderkey AS doc, unnest(range(0, 20))::INT AS s FROM orders) a, range(1, 7) t(k) WHERE a.s + k <= 20"


@query(
    f"""WITH RECURSIVE win AS ({WINDOWS}), p AS (
  SELECT doc, s, e, score AS prev, score AS best, e AS be, field AS bf, false AS over FROM win WHERE e = s + 1
  UNION ALL
  SELECT w.doc, w.s, w.e, w.score, CASE WHEN w.score > p.best THEN w.score ELSE p.best END, CASE WHEN w.score > p.best THEN w.e ELSE p.be END, CASE WHEN w.score > p.best THEN w.field ELSE p.bf END, w.score < p.prev * 0.75 AND p.prev > 0
  FROM p JOIN win w ON w.doc = p.doc AND w.s = p.s AND w.e = p.e + 1 WHERE NOT p.over),
b AS (SELECT doc, s, best, be, bf FROM p QUALIFY row_number() OVER (PARTITION BY doc, s ORDER BY e DESC) = 1),
g AS (SELECT doc, s, CASE WHEN best > 0 THEN be ELSE s + 1 END AS e, CASE WHEN best > 0 THEN bf ELSE 'unclassified' END AS field, CASE WHEN best > 0 THEN best ELSE 0 END::DOUBLE AS score FROM b),
walk AS (SELECT * FROM g WHERE s = 0 UNION ALL SELECT g.* FROM walk JOIN g ON g.doc = walk.doc AND g.s = walk.e)
SELECT doc, s, e, field, score FROM walk"""
)
def plinko(t: Tables) -> DataFrame:
    docs = t("orders").select(F.col("o_orderkey").alias("doc"))
    a = docs.select("doc", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("s")).select("doc", "s", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k")).where("s + k <= 20")
    win = a.select("doc", "s", (F.col("s") + F.col("k")).alias("e"), F.concat(F.lit("f"), ((F.col("s") + F.col("k") * 3) % 4).cast("string")).alias("field"), F.round(((F.col("s") * 7 + F.col("k") * 13 + F.col("doc")) % 19) / 10.0 - 0.4, 4).alias("score"))
    return N.plinko(win, docs.withColumn("n_words", F.lit(20)))
