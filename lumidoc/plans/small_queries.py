"""Queries over the smaller operators: legacy scores, diagnostics, gates, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bank as B
from ..operators import compete as N
from ..operators import scoring as S
from .record_queries import INDEX, SURFACES, _label_scores
from .registry import Tables, query
from .text_queries import COMPACT
from .vector_queries import ARENA, COS, POOL, SURPRISAL, _heat


@query(f"WITH p AS ({POOL.replace(' * b.weight', '')}) SELECT vec_id, field, round(max(s) FILTER (kind = 'bias') - max(s) FILTER (kind = 'prejudice'), 6) AS net FROM p GROUP BY ALL", ("bank",))
def legacy_scores(t: Tables) -> DataFrame:
    return S.net_scores(t("embeddings").select("vec_id", F.col("embedding").alias("vec")), t.fixture("bank"), "vec_id").withColumn("net", F.round("net", 6))


@query(
    f"""WITH p AS (SELECT a.label = b.label AS same, {COS.format("a.embedding", "b.embedding")} AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT avg(c) FILTER (same) AS g, avg(c) FILTER (NOT same) AS b FROM p) SELECT round(g, 6) AS good, round(b, 6) AS bad, round(g - b, 6) AS gap, CASE WHEN g - b >= 0.1 THEN 'good' WHEN g - b > 0.02 THEN 'weak' ELSE 'collapsed' END AS verdict FROM m"""
)
def space_quality(t: Tables) -> DataFrame:
    e = t("embeddings").select("vec_id", "label", F.col("embedding").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l2"), F.col("a").alias("b")), "vec_id").select((F.col("label") == F.col("l2")).alias("same"), "a", "b")
    q = S.space_quality(pairs)
    return q.select(*[F.round(c, 6).alias(c) for c in ("good", "bad", "gap")], "verdict")


@query("SELECT p_partkey AS id, 2 * (p_partkey % 40 + 1) * 2 * 256 * 2 * 4096 AS bytes FROM part")
def kv_plan(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), S.kv_bytes(F.col("p_partkey") % 40 + 1, F.lit(2), F.lit(256), F.lit(4096)).alias("bytes"))


@query(f"WITH {SURPRISAL} SELECT vec_id, " + ", ".join(f"round(max(surprisal) FILTER (field = 'f{k}'), 5) AS f{k}" for k in range(10)) + " FROM s GROUP BY 1", ("bank",))
def score_matrix(t: Tables) -> DataFrame:
    scores = S.surprisal(t("embeddings").select("vec_id", F.col("embedding").alias("vec")), t.fixture("bank"), "vec_id")
    m = S.score_matrix(scores, "vec_id", [f"f{k}" for k in range(10)])
    return m.select("vec_id", *[F.round(f"f{k}", 5).alias(f"f{k}") for k in range(10)])


@query(f"WITH {ARENA} SELECT p.idx, round(r.score - r.floor, 5) AS score FROM patches p LEFT JOIN r3 r ON r.idx = p.idx AND r.winner = 'f3'", ("patches", "bank"))
def territory_scores(t: Tables) -> DataFrame:
    _, verdicts = N.arena(_heat(t), None, 0.3, 20, 3)
    return N.territory_scores(verdicts, t.fixture("patches"), "f3").withColumn("score", F.round("score", 5))


@query(f"WITH {ARENA} SELECT winner AS category FROM r3 GROUP BY 1 HAVING count(*) >= 20", ("patches", "bank"))
def presence_gate(t: Tables) -> DataFrame:
    heat = _heat(t)
    territories, _ = N.arena(heat, None, 0.3, 20, 3)
    return N.present(territories, heat)


@query(f"WITH {INDEX}, b AS (SELECT id, max(score) AS best FROM scores GROUP BY 1) SELECT s.id % 40 AS page, CASE WHEN count(*) >= 6 AND round(avg(coalesce((best >= 0.42)::INT, 0)), 9) < 0.22 THEN 'prose' ELSE 'form' END AS mode, round(avg(coalesce((best >= 0.42)::INT, 0)), 9) AS density FROM samples s LEFT JOIN b USING (id) GROUP BY 1", ("samples",))
def read_mode(t: Tables) -> DataFrame:
    labels, scores = _label_scores(t)
    return B.read_mode(labels.select("id", (F.col("id") % 40).alias("page")), scores, "page", "id")


SCHEMA = [("doc_type", ""), ("doc_number", "number of the commercial invoice"), ("reference_bl", "bill of lading"), ("reference_invoice", "number of the commercial invoice it belongs to"), ("reference_cinv", "the invoice"), ("amount", "total")]


@query("SELECT * FROM (VALUES ('doc_type'), ('reference_cinv'), ('reference_invoice')) t(field)")
def self_references(t: Tables) -> DataFrame:
    return B.self_references(t.spark.createDataFrame(SCHEMA, "field string, semantic string"), "CINV")


LANGS = [("amount", "ko", "금액"), ("amount", "en", "amount"), ("date", "ko", "날짜"), ("buyer", "de", "Käufer"), ("buyer", "fr", "acheteur")]


@query("SELECT * FROM (VALUES ('amount', 'en', 'amount'), ('date', 'ko', '날짜'), ('buyer', 'de', 'Käufer')) t(field, lang, text)")
def first_language(t: Tables) -> DataFrame:
    return B.first_language(t.spark.createDataFrame(LANGS, "field string, lang string, text string"), ["de", "en", "ko"])


SURF = "(VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c, _ in SURFACES) + ") t(field, ord, label)"


@query(
    f"""WITH l AS (SELECT id, {COMPACT.format("v")} AS l FROM samples), n AS (SELECT field, ord, {COMPACT.format("label")} AS b FROM {SURF})
SELECT id, field FROM l JOIN n ON l <> '' AND b <> '' AND (contains(l, b) OR contains(b, l)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY (l <> b)::INT, CASE WHEN l = b THEN 0 ELSE -length(b) END, ord, field) = 1""",
    ("samples",),
)
def field_by_label(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(a, b, c) for a, b, c, _ in SURFACES], "field string, ord int, label string")
    return B.field_by_label(t.fixture("samples").withColumnRenamed("v", "label"), names)
