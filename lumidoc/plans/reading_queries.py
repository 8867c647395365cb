"""Queries over reading steps: bands, prose, crops, ledgers, recognisers, index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reading as RD
from .registry import Tables, query
from .text_queries import LABEL, TRIM
from .vector_queries import COS  # noqa: F401

PROFILE = "SELECT l_orderkey % 50 AS page, l_partkey % 97 AS y, max(round(l_discount * 100 + CASE WHEN l_partkey % 97 BETWEEN 20 AND 55 THEN 8 ELSE 0 END, 2)) AS v FROM lineitem GROUP BY ALL"


@query(
    f"""WITH p AS ({PROFILE}), g AS (SELECT page, quantile_cont(v, 0.12) AS base, max(v) AS peak FROM p GROUP BY 1), h AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS island FROM p JOIN g USING (page) WHERE peak - base >= 3 AND v > base + 0.22 * (peak - base))
SELECT page, min(y) AS y0, max(y) + 1 AS y1 FROM h GROUP BY page, island HAVING max(y) + 1 - min(y) >= 3"""
)
def line_bands(t: Tables) -> DataFrame:
    y = F.col("l_partkey") % 97
    v = F.round(F.col("l_discount") * 100 + F.when(y.between(20, 55), 8).otherwise(0), 2)
    profile = t("lineitem").groupBy((F.col("l_orderkey") % 50).alias("page"), y.alias("y")).agg(F.max(v).alias("v"))
    return RD.profile_bands(profile, "page", least=3)


@query(
    """WITH o AS (SELECT page, y0, y1, row_number() OVER (PARTITION BY page ORDER BY y0, y1) AS k FROM (SELECT page, y0 * 2 AS y0, y0 * 2 + 6 + seq % 17 AS y1 FROM boxes)),
one AS (SELECT page, 0 AS k, [{'y0': 0, 'y1': 0}][1:0] AS w FROM (SELECT DISTINCT page FROM o) UNION ALL
  SELECT page, k + 1, CASE WHEN len(w) = 0 THEN [{'y0': y0, 'y1': y1}] WHEN y0 >= w[-1].y1 THEN list_append(w, {'y0': y0, 'y1': y1}) WHEN span <= 0 THEN w
    WHEN w[-1].y1 - y0 >= span * 0.7 THEN list_append(w[1:-2], {'y0': least(w[-1].y0, y0), 'y1': greatest(w[-1].y1, y1)})
    WHEN y1 - cut >= 8 THEN list_concat(w[1:-2], [{'y0': w[-1].y0, 'y1': CASE WHEN cut - w[-1].y0 >= 8 THEN cut ELSE w[-1].y1 END}, {'y0': cut, 'y1': y1}])
    ELSE list_append(w[1:-2], {'y0': w[-1].y0, 'y1': greatest(y1, CASE WHEN cut - w[-1].y0 >= 8 THEN cut ELSE w[-1].y1 END)}) END
  FROM (SELECT s.page, s.k, s.w, o.y0, o.y1, least(w[-1].y1 - w[-1].y0, o.y1 - o.y0) AS span, (floor((w[-1].y1 + o.y0) / 2))::BIGINT AS cut FROM one s JOIN o ON o.page = s.page AND o.k = s.k + 1)),
b AS (SELECT page, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1)),
two AS (SELECT page, 0 AS k, [{'y0': 0, 'y1': 0}][1:0] AS w FROM (SELECT DISTINCT page FROM b) UNION ALL
  SELECT s.page, s.k + 1, CASE WHEN len(w) > 0 AND b.x.y0 - w[-1].y1 <= 2 AND b.x.y1 - w[-1].y0 <= (b.x.y1 - b.x.y0) * 1.6 THEN list_append(w[1:-2], {'y0': w[-1].y0, 'y1': b.x.y1}) ELSE list_append(w, {'y0': b.x.y0, 'y1': b.x.y1}) END
  FROM two s JOIN b ON b.page = s.page AND b.k = s.k + 1)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY k) - 1)::INT AS n, x.y0::INT AS y0, x.y1::INT AS y1 FROM (SELECT page, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1)) WHERE x.y1 - x.y0 >= 8""",
    ("boxes",),
)
def resolved_bands(t: Tables) -> DataFrame:
    bands = t.fixture("boxes").select("page", (F.col("y0") * 2).alias("y0"), (F.col("y0") * 2 + 6 + F.col("seq") % 17).alias("y1"))
    return RD.resolved_bands(bands, "page")


@query(
    rf"""WITH l AS (SELECT id, n, {TRIM.format("x")} AS v FROM (SELECT id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM (SELECT id, v || chr(10) || 'paid in full' || chr(10) || 'x' AS text FROM samples))),
s AS (SELECT id, n, v, regexp_replace(v, '^[:： ]+|[:： ]+$', '', 'g') AS t, length(regexp_replace(v, '\s', '', 'g')) AS solid, len(regexp_extract_all(v, '[\p{{L}}\p{{N}}]')) AS alnum FROM l WHERE v <> ''),
e AS (SELECT *, {LABEL} false END AS label FROM s), k AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM e WHERE label) AND length(v) <= 120 AND (length(v) >= 2 OR regexp_matches(v, '^[0-9]$')) AND alnum / greatest(solid, 1)::DOUBLE >= 0.55
  AND NOT (length(v) <= 4 AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')) AND solid >= 3)
SELECT id, count(*)::INT AS n, string_agg(v, ' ' ORDER BY n) AS value FROM k GROUP BY 1""",
    ("samples",),
)
def prose_lines(t: Tables) -> DataFrame:
    texts = t.fixture("samples").select("id", F.concat("v", F.lit("\npaid in full\nx")).alias("text"))
    return RD.prose_lines(texts, "id").select("id", F.size("lines").alias("n"), "value")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'v' || o_orderkey WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'own' ELSE o_orderpriority END AS value FROM orders"""
)
def field_values(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    refined = F.when(k % 3 == 0, F.create_map(F.lit("value"), F.concat(F.lit(" v"), k.cast("string")), F.lit("text"), F.lit("not this"))).when(
        (k % 3 == 1) & (k % 2 == 0), F.create_map(F.lit("value"), F.lit("  "), F.lit("buyer"), F.lit("own"))
    )
    return t("orders").select(k.alias("id"), RD.field_value(refined, F.lit("buyer"), F.col("o_orderpriority")).alias("value"))


@query(
    "SELECT page, seq, field, 'confirmed' AS status, least(greatest(x0 - 5, 0), 50) AS x0, least(greatest(y0 - 5, 0), 30) AS y0, least(greatest(x1, 0), 50) AS x1, least(greatest(y1, 0), 30) AS y1, score FROM boxes WHERE region = 0", ("boxes",)
)
def confirmed_crops(t: Tables) -> DataFrame:
    status = F.when(F.col("region") == 0, "confirmed").otherwise("below-margin")
    rows = t.fixture("boxes").select("page", "seq", "field", status.alias("status"), (F.col("x0") - 5).alias("x0"), (F.col("y0") - 5).alias("y0"), "x1", "y1", "score")
    return RD.confirmed_crops(rows, 50, 30)


@query(
    """WITH k AS (SELECT *, x0 // 6 AS a, y0 // 6 AS b, x1 // 6 AS c, y1 // 6 AS d FROM ocr_rows), l AS (SELECT page, a, b, c, d, max_by(text, seq) AS text FROM k WHERE seq % 2 = 0 GROUP BY ALL)
SELECT k.page, k.x0 AS crop, count(*) AS rows, count(l.text) AS hit, count(l.text) >= count(*) * 0.6 AS reuse FROM k LEFT JOIN l ON (k.page, k.a, k.b, k.c, k.d) = (l.page, l.a, l.b, l.c, l.d) GROUP BY ALL""",
    ("ocr_rows",),
)
def reused_rows(t: Tables) -> DataFrame:
    rows = t.fixture("ocr_rows")
    return RD.reused_rows(rows.withColumn("crop", F.col("x0")), rows.where("seq % 2 = 0"), "page", "crop")


@query(
    """WITH r AS (SELECT *, 'r' || seq % 3 AS reader FROM ocr_rows), n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page, reader ORDER BY (x1 - x0) * (y1 - y0) DESC, y0, x0, conf) <= 2), m AS (SELECT page, reader, round(avg(conf), 6) AS conf FROM n GROUP BY ALL)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page ORDER BY conf DESC, reader) = 1""",
    ("ocr_rows",),
)
def surest_reader(t: Tables) -> DataFrame:
    rows = t.fixture("ocr_rows").withColumn("reader", F.concat(F.lit("r"), (F.col("seq") % 3).cast("string")))
    # means that are equal but for rounding count as equal
    return RD.surest_reader(rows, "page", 2)


@query(
    """WITH v AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'ko' WHEN 2 THEN 'sw' WHEN 3 THEN 'km' END AS lang, CASE WHEN event_id % 3 = 0 THEN 'block' ELSE 'text' END AS stage, (event_id % 11)::DOUBLE / 100 AS margin FROM events),
s AS (SELECT *, lang IS NOT NULL AND (stage = 'block' OR lang IN ('en', 'ko') OR margin >= 0.05) AS resolved FROM v) SELECT id, lang, resolved, CASE WHEN resolved THEN lang ELSE 'en,ko,ja' END AS codes FROM s"""
)
def served_language(t: Tables) -> DataFrame:
    k = F.col("event_id")
    lang = F.when(k % 5 == 0, "en").when(k % 5 == 1, "ko").when(k % 5 == 2, "sw").when(k % 5 == 3, "km")
    rows = t("events").select(k.alias("id"), lang.alias("lang"), F.when(k % 3 == 0, "block").otherwise("text").alias("stage"), ((k % 11).cast("double") / 100).alias("margin"))
    return RD.served_language(rows, ["en", "ko"], ["en", "ko", "ja"]).select("id", "lang", "resolved", F.array_join("codes", ",").alias("codes"))


@query(
    """WITH f AS (SELECT doc, field, trim(value) AS value, trim(replace(field, '_', ' ') || ' ' || trim(value)) AS leaf FROM record_fields WHERE trim(value) <> ''), d AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN repeat(o_orderpriority || ' ', 300) ELSE ' ' END AS text FROM orders),
a AS (SELECT doc, string_agg(leaf, ' ' ORDER BY field, leaf) AS every FROM f GROUP BY 1)
SELECT 'fields' AS namespace, doc || '#' || field AS rid, doc, leaf AS text FROM f UNION ALL SELECT 'docs', doc::VARCHAR, doc, substr(CASE WHEN trim(text) <> '' THEN trim(text) ELSE every END, 1, 2000) FROM d LEFT JOIN a USING (doc) WHERE trim(text) <> '' OR every <> ''""",
    ("record_fields",),
)
def index_rows(t: Tables) -> DataFrame:
    docs = t("orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 3 == 0, F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(300))).otherwise(" ").alias("text"))
    return RD.index_rows(t.fixture("record_fields"), docs)


@query(
    """WITH p AS (SELECT DISTINCT 'p' || vec_id % 300 AS phrase FROM embeddings), v AS (SELECT 'p' || vec_id AS phrase, embedding AS vec FROM embeddings WHERE vec_id % 5 <> 0)
SELECT phrase, round(vec[1]::DOUBLE / sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 6) AS first FROM p JOIN v USING (phrase)"""
)
def checked_anchors(t: Tables) -> DataFrame:
    e = t("embeddings")
    name = lambda k: F.concat(F.lit("p"), k.cast("string")).alias("phrase")
    dim = len(e.first()["embedding"])
    vectors = e.select(name(F.col("vec_id")), F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vec"))
    out = RD.checked_anchors(e.select(name(F.col("vec_id") % 300)), vectors, dim)
    return out.select("phrase", F.round(F.element_at("vec", 1), 6).alias("first"))


@query(
    """WITH p AS (SELECT o_custkey AS doc, (o_orderkey % 3)::INT AS page, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN ' ' || repeat('ab ', 20) ELSE repeat('. ', 40) END AS text FROM orders)
SELECT doc, page, k, CASE WHEN k % 2 = 0 THEN trim(text) END AS text FROM p WHERE page = 1"""
)
def selected_page(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    pages = t("orders").select(F.concat_ws("/", "o_custkey", "o_orderkey").alias("doc"), (k % 3).cast("int").alias("page"), F.when(k % 2 == 0, F.concat(F.lit(" "), F.repeat(F.lit("ab "), F.lit(20)))).otherwise(F.repeat(F.lit(". "), F.lit(40))).alias("text"))
    out = RD.page_text(pages, 1)
    return out.select(F.split_part("doc", F.lit("/"), F.lit(1)).cast("bigint").alias("doc"), "page", F.split_part("doc", F.lit("/"), F.lit(2)).cast("bigint").alias("k"), "text")


@query(
    """WITH p AS (SELECT l_orderkey AS line, l_partkey % 60 AS x, max(l_quantity / 10)::DOUBLE AS v FROM lineitem GROUP BY ALL), g AS (SELECT line, quantile_cont(v, 0.12) AS base, max(v) AS peak FROM p GROUP BY 1),
e AS (SELECT line, base, peak, min(x) FILTER (v > base + (peak - base) * 0.3) AS a, max(x) FILTER (v > base + (peak - base) * 0.3) AS b FROM p JOIN g USING (line) GROUP BY ALL)
SELECT line, CASE WHEN peak - base < 2 OR a IS NULL THEN 0 ELSE a END::INT AS x0, CASE WHEN peak - base < 2 OR a IS NULL THEN 60 ELSE b + 1 END::INT AS x1 FROM e"""
)
def trimmed_columns(t: Tables) -> DataFrame:
    profile = t("lineitem").groupBy(F.col("l_orderkey").alias("line"), (F.col("l_partkey") % 60).alias("x")).agg(F.max((F.col("l_quantity") / 10).cast("double")).alias("v"))
    return RD.trimmed_columns(profile, ["line"], 60)


@query(
    """WITH o AS (SELECT page, x0, y0, x1, y1, row_number() OVER (PARTITION BY page ORDER BY y0, x0, x1, y1) AS k FROM boxes WHERE x1 - x0 >= 4 AND y1 - y0 >= 8 AND NOT (x1 - x0 >= 110 * 0.95 AND y1 - y0 >= 80 * 0.8)),
step AS (SELECT page, 0 AS k, [{'x0': 0, 'y0': 0, 'x1': 0, 'y1': 0}][1:0] AS w FROM (SELECT DISTINCT page FROM o)
  UNION ALL SELECT s.page, s.k + 1, CASE WHEN len(hit) = 0 THEN list_append(w, {'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1})
    ELSE list_transform(w, lambda a, i: CASE WHEN i = hit[1] THEN {'x0': least(a.x0, o.x0), 'y0': least(a.y0, o.y0), 'x1': greatest(a.x1, o.x1), 'y1': greatest(a.y1, o.y1)} ELSE a END) END
  FROM (SELECT s.*, list_filter(range(1, len(w) + 1), lambda i: least(w[i].y1, o.y1) > greatest(w[i].y0, o.y0) AND least(w[i].y1, o.y1) - greatest(w[i].y0, o.y0) >= least(w[i].y1 - w[i].y0, o.y1 - o.y0) * 0.7 AND least(w[i].x1, o.x1) > greatest(w[i].x0, o.x0)) AS hit
    FROM step s JOIN o ON o.page = s.page AND o.k = s.k + 1) s JOIN o ON o.page = s.page AND o.k = s.k + 1)
SELECT page, (n - 1)::INT AS n, greatest(0, m.x0 - 4) AS x0, greatest(0, m.y0 - 3) AS y0, least(110, m.x1 + 4) AS x1, least(80, m.y1 + 3) AS y1 FROM (SELECT page, unnest(w) AS m, generate_subscripts(w, 1) AS n FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1)) WHERE n <= 40""",
    ("boxes",),
)
def box_lines(t: Tables) -> DataFrame:
    return RD.box_lines(t.fixture("boxes"), "page", 110, 80)


@query(None)
def tall_bands(t: Tables) -> DataFrame:
    """Bands of a profile, the tall ones parted; the tests hold them against a definition."""
    y = F.col("l_partkey") % 97
    profile = t("lineitem").groupBy((F.col("l_orderkey") % 50).alias("page"), y.alias("y")).agg(F.max(F.col("l_discount") * 100).cast("double").alias("v"))
    return RD.split_tall(RD.profile_bands(profile, "page"), profile, "page")
