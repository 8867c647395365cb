"""Queries over guards, grids, providers and language evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import compete as N
from ..operators import grid as G
from ..operators import heatmap as H
from ..operators import language as LG
from ..operators import providers as PR
from ..operators import scoring as S
from .registry import Tables, query
from .text_queries import COMPACT, TRIM, q

LOW = """regexp_replace(lower(t), '^[ .:"''`]+|[ .:"''`]+$', '', 'g')"""


@query(
    rf"""WITH s AS (SELECT id, v, {TRIM.format("v")} AS t, CASE id % 2 WHEN 0 THEN 'ship_to' ELSE 'order_priority' END AS f FROM samples)
SELECT id, t = '' OR {LOW} IN ({", ".join(q(x) for x in P.SCHEMA_ECHO)}) OR regexp_matches(t, {q(P.TYPE_MARKER)}) OR regexp_matches({LOW}, {q(P.FIELD_ECHO)}) OR {LOW} IN (f, replace(f, '_', ' ')) AS echo FROM s""",
    ("samples",),
)
def schema_echo(t: Tables) -> DataFrame:
    field = F.when(F.col("id") % 2 == 0, "ship_to").otherwise("order_priority")
    return t.fixture("samples").select("id", X.is_schema_echo("v", field).alias("echo"))


WSET = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2))"


@query(
    f"""WITH p AS (SELECT a.id, a.v, b.v AS s FROM samples a JOIN samples b ON b.id = a.id + 18), c AS (SELECT id, {COMPACT.format("v")} AS a, {COMPACT.format("s")} AS b, {WSET.format("v")} AS x, {WSET.format("s")} AS y FROM p)
SELECT id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR (len(x) >= 2 AND len(y) >= 2 AND len(list_intersect(x, y)) / greatest(len(y), 1)::DOUBLE >= 0.6)) AS echo FROM c""",
    ("samples",),
)
def spec_echo(t: Tables) -> DataFrame:
    s = t.fixture("samples")
    return s.join(s.select((F.col("id") - 18).alias("id"), F.col("v").alias("w")), "id").select("id", X.echoes_spec("v", "w").alias("echo"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Let me see. ' || text WHEN 1 THEN '<think> </think>' || text WHEN 2 THEN '<think>x</think>' || text WHEN 3 THEN text || ' Do Not  Translate' ELSE text END AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(lower(s), '<think>') THEN regexp_replace(regexp_extract(lower(s), '(?s)<think>(.*?)(</think>|$)', 1), '\\s+', '', 'g') <> '' ELSE {" OR ".join(f"starts_with(lower(ltrim(s)), {q(o)})" for o in P.REASONING)} END AS reasoning,
  {" OR ".join(f"contains(regexp_replace(lower(s), '\\s+', '', 'g'), {q(m.replace(' ', ''))})" for m in P.PROMPT_ECHO)} AS prompt FROM c"""
)
def prompt_guards(t: Tables) -> DataFrame:
    k = F.col("turn") % 5
    s = F.when(k == 0, F.concat(F.lit("Let me see. "), "text")).when(k == 1, F.concat(F.lit("<think> </think>"), "text")).when(k == 2, F.concat(F.lit("<think>x</think>"), "text")).when(k == 3, F.concat("text", F.lit(" Do Not  Translate"))).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", X.looks_reasoning(s).alias("reasoning"), X.looks_prompt_echo(s).alias("prompt"))


HANGUL = P.BLOCKS[0][2]


@query(
    f"""WITH m AS (SELECT id, v || CASE id % 3 WHEN 0 THEN ' 한글 문서 본문' ELSE '' END AS s FROM samples),
n AS (SELECT id, len(regexp_extract_all(s, '[{HANGUL}]'))::DOUBLE AS h, len(regexp_extract_all(s, {q(P.LATIN_LETTERS)}))::DOUBLE AS l FROM m)
SELECT id, round(CASE WHEN h + l > 0 THEN h / (h + l) END, 6) AS share, coalesce(h + l >= 4 AND l / (h + l) >= 0.55, false) AS romanized, CASE WHEN h + l > 0 THEN h / (h + l) >= 0.25 ELSE true END AS fits FROM n""",
    ("samples",),
)
def script_shares(t: Tables) -> DataFrame:
    s = F.concat("v", F.when(F.col("id") % 3 == 0, " 한글 문서 본문").otherwise(""))
    return t.fixture("samples").select("id", F.round(X.script_share(s, F.lit("Hangul")), 6).alias("share"), F.coalesce(X.looks_romanized(s, F.lit("kor")), F.lit(False)).alias("romanized"), X.draft_matches_language(s, F.lit("kor")).alias("fits"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'eng' WHEN 1 THEN 'fra' WHEN 2 THEN 'kor' WHEN 3 THEN 'deu' WHEN 4 THEN 'xyz' ELSE 'eng' END AS code FROM orders")
def lang_codes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    c = F.when(k == 0, "EN-us").when(k == 1, "fra").when(k == 2, " ko ").when(k == 3, "DE_at").when(k == 4, "xyz")
    return t("orders").select(F.col("o_orderkey").alias("id"), X.normalize_lang(c).alias("code"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'issue_date' WHEN 1 THEN 'amount' WHEN 2 THEN 'buyer_name' ELSE '' END AS field, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 12 ELSE 0 END AS idx FROM orders")
def repair_keys(t: Tables) -> DataFrame:
    """Keys as a model writes them: numbered, misspelt, joined; `priority` is near none."""
    k = F.col("o_orderkey") % 4
    key = F.when(k == 0, "issue_date_3").when(k == 1, "ammount").when(k == 2, "buyername 12").otherwise("xyzzy")
    fixed = X.repair_key(key, ["amount", "issue_date", "buyer_name"])
    return t("orders").select(F.col("o_orderkey").alias("id"), fixed["field"].alias("field"), fixed["idx"].alias("idx"))


@query(r"""SELECT event_id, regexp_extract(props, '"k": ?(-?[0-9]+)', 1) AS k, event_type AS kind, 2 AS n FROM events""")
def salvaged_json(t: Tables) -> DataFrame:
    """Pairs out of an object that breaks off in its last value."""
    s = F.concat(F.lit('noise {"kind": "'), "event_type", F.lit('", '), F.expr("substr(props, 2, length(props) - 2)"), F.lit(', "cut": "br'))
    m = X.salvage_object(s)
    return t("events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.try_element_at(m, F.lit("kind")).alias("kind"), F.size(m).alias("n"))


@query(
    f"""WITH s AS (SELECT id, {COMPACT.format("v")} AS k FROM samples), p AS (SELECT a.id, a.k AS a, b.k AS b FROM s a JOIN s b ON b.id = a.id + 18),
g AS (SELECT id, 'a' AS side, a AS k FROM p UNION ALL SELECT id, 'b', b FROM p), n AS (SELECT id, side, substr(k, i, z) AS gram, count(*)::DOUBLE AS n FROM (SELECT id, side, k, z, unnest(range(1, length(k) - z + 2)) AS i FROM g, (VALUES (2), (3)) t(z)) GROUP BY ALL UNION ALL SELECT id, side, k, 1 FROM g WHERE length(k) = 1),
sq AS (SELECT id, side, sqrt(sum(n * n)) AS q FROM n GROUP BY ALL), d AS (SELECT x.id, sum(x.n * y.n) AS d FROM n x JOIN n y ON x.id = y.id AND x.gram = y.gram AND x.side = 'a' AND y.side = 'b' GROUP BY 1)
SELECT p.id, round(coalesce(d / (a.q * b.q), 0), 6)::DOUBLE AS cosine FROM p LEFT JOIN sq a ON a.id = p.id AND a.side = 'a' LEFT JOIN sq b ON b.id = p.id AND b.side = 'b' LEFT JOIN d ON d.id = p.id""",
    ("samples",),
)
def gram_cosine(t: Tables) -> DataFrame:
    s = t.fixture("samples")
    pairs = s.join(s.select((F.col("id") - 18).alias("id"), F.col("v").alias("w")), "id")
    return pairs.select("id", F.round(X.grams_cosine("v", "w"), 6).alias("cosine"))


@query(None)
def lcs_similarity(t: Tables) -> DataFrame:
    """Longest common subsequences (no such function in the oracle's engine): the tests hold it against the definition."""
    s = t.fixture("samples")
    return s.join(s.select((F.col("id") - 18).alias("id"), F.col("v").alias("w")), "id").select("id", F.round(X.lcs_similarity("v", "w"), 6).alias("similarity"))


@query(
    """WITH b AS (SELECT idx, r, c, greatest(0, least(floor(c * 1000.0 / 25)::INT, 999)) AS x0, greatest(0, least(floor(r * 777.0 / 20)::INT, 776)) AS y0, floor((c + 1) * 1000.0 / 25)::INT AS a, floor((r + 1) * 777.0 / 20)::INT AS d FROM patches)
SELECT idx, x0, y0, least(greatest(a, x0 + 1), 1000) AS x1, least(greatest(d, y0 + 1), 777) AS y1 FROM b""",
    ("patches",),
)
def patch_boxes(t: Tables) -> DataFrame:
    return t.fixture("patches").select("idx", G.patch_box(F.col("r"), F.col("c"), 20, 25, 1000, 777).alias("b")).select("idx", "b.*")


@query(
    """WITH e AS (SELECT r * 5 // 20 AS r, c * 5 // 25 AS c, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM patches), m AS (SELECT r, c, i, avg(x) AS x FROM e GROUP BY ALL)
SELECT r::INT AS r, c::INT AS c, list(round(x, 6) ORDER BY i) AS vec FROM m GROUP BY r, c""",
    ("patches",),
)
def pooled_grid(t: Tables) -> DataFrame:
    p = G.pool_grid(t.fixture("patches"), 20, 25, 5, 5)
    size = lambda x: F.round(F.abs(x) * 1e6) / 1e6  # noqa: E731  # the double product decides ties, as in SQL; F.round(x, 6) takes the printed decimals
    signed = lambda x: F.when(x < 0, -size(x)).otherwise(size(x))  # noqa: E731  # a small negative mean is -0, as in SQL
    return p.select("r", "c", F.transform("vec", signed).alias("vec"))


@query(
    """WITH px AS (SELECT l_orderkey % 300 AS y, l_quantity * (1 + (l_orderkey % 300) // 50 % 2 * 3) AS ink FROM lineitem), g AS (SELECT avg(ink) + 0.25 * stddev_pop(ink) AS gate FROM px),
p AS (SELECT least(29, floor((y + 1) * 30 / 300.0 - 1e-9))::INT AS k, avg((ink > gate)::INT::DOUBLE) AS ratio FROM px, g GROUP BY 1), s AS (SELECT avg(ratio) FILTER (ratio > 0.02) AS mean, count(*) AS n FROM p)
SELECT k FROM p, s WHERE ratio <= greatest(0.02, mean * 0.9) QUALIFY row_number() OVER (ORDER BY ratio, k) <= floor(n * 0.45)"""
)
def gutter_bands(t: Tables) -> DataFrame:
    y = F.col("l_orderkey") % 300
    pixels = t("lineitem").select(y.alias("y"), (F.col("l_quantity") * (1 + F.floor(y / 50) % 2 * 3)).alias("ink"))
    return G.gutters(G.ink_profile(pixels, "y", 30, 300), 0.9)


@query(
    """WITH comps AS (SELECT vec_id AS comp, vec_id % 17 AS r0, vec_id % 17 + 2 AS r1, 8 + vec_id % 7 AS c0, 10 + vec_id % 7 AS c1 FROM embeddings), cont AS (SELECT r, c FROM patches WHERE (idx * 7919 + 13) % 100 < 45),
good AS (SELECT DISTINCT comp, c0, c1, c FROM comps JOIN cont ON r BETWEEN r0 AND r1 WHERE c NOT IN (5, 20)),
walk AS (SELECT comp, c0, c1, c1 - c0 + 1 AS w, 'l' AS side FROM comps UNION ALL
  SELECT w.comp, CASE WHEN w.side = 'l' AND gl.c IS NOT NULL AND w.w < 9 THEN w.c0 - 1 ELSE w.c0 END, CASE WHEN w.side = 'r' THEN w.c1 + 1 ELSE w.c1 END, CASE WHEN (w.side = 'l' AND gl.c IS NOT NULL AND w.w < 9) OR w.side = 'r' THEN w.w + 1 ELSE w.w END, CASE WHEN w.side = 'l' AND gl.c IS NOT NULL AND w.w < 9 THEN 'l' ELSE 'r' END
  FROM walk w LEFT JOIN good gl ON gl.comp = w.comp AND gl.c = w.c0 - 1 LEFT JOIN good gr ON gr.comp = w.comp AND gr.c = w.c1 + 1
  WHERE w.side = 'l' OR (w.side = 'r' AND gr.c IS NOT NULL AND w.w < 9))
SELECT comp, min(c0) AS c0, max(c1) AS c1 FROM walk GROUP BY 1""",
    ("patches",),
)
def band_growth(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    comps = t("embeddings").select(v.alias("comp"), (v % 17).alias("r0"), (v % 17 + 2).alias("r1"), (8 + v % 7).alias("c0"), (10 + v % 7).alias("c1"))
    content = t.fixture("patches").where("(idx * 7919 + 13) % 100 < 45").select("r", "c")
    return G.row_bands(comps, content, [5, 20], 25, 9)


@query(
    """WITH b AS (SELECT (l_partkey % 6) * 120 AS x0, (l_partkey % 6) * 120 + 50 + l_linenumber AS x1 FROM lineitem)
SELECT c FROM (SELECT unnest(range(1, 20)) AS c) WHERE NOT EXISTS (SELECT 1 FROM b WHERE c > floor(x0 / 40.0) AND c < ceil(x1 / 40.0))"""
)
def free_columns(t: Tables) -> DataFrame:
    x = F.col("l_partkey") % 6 * 120
    return G.free_columns(t("lineitem").select(x.alias("x0"), (x + 50 + F.col("l_linenumber")).alias("x1")), 20, 40)


@query(
    """WITH b AS (SELECT p_partkey AS id, (p_partkey % 500)::INT AS x0, (p_partkey % 300)::INT AS y0, (p_partkey % 500 + p_partkey % 37)::INT AS x1, (p_partkey % 300 + p_partkey % 23)::INT AS y1 FROM part),
a AS (SELECT *, 20 - (x1 - x0) AS nx, 16 - (y1 - y0) AS ny FROM b),
h AS (SELECT *, greatest(0, x0 - floor(nx / 2.0)::INT) AS lx, least(510, x1 + nx - floor(nx / 2.0)::INT) AS hx, greatest(0, y0 - floor(ny / 2.0)::INT) AS ly, least(310, y1 + ny - floor(ny / 2.0)::INT) AS hy FROM a)
SELECT id, CASE WHEN nx > 0 THEN CASE WHEN hx - lx < 20 THEN greatest(0, hx - 20) ELSE lx END ELSE x0 END AS x0, CASE WHEN ny > 0 THEN CASE WHEN hy - ly < 16 THEN greatest(0, hy - 16) ELSE ly END ELSE y0 END AS y0,
  least(510, CASE WHEN nx > 0 THEN hx ELSE x1 END) AS x1, least(310, CASE WHEN ny > 0 THEN hy ELSE y1 END) AS y1,
  round(least(4, greatest(1, 28 / greatest(y1 - y0, 1)::DOUBLE)), 6)::DOUBLE AS factor, greatest(1, floor((x1 + 900) * least(1, 1024 / greatest(x1 + 900, y1 + 700)::DOUBLE, sqrt(640000 / ((x1 + 900) * (y1 + 700))::DOUBLE)))::INT) AS w FROM h"""
)
def crop_boxes(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    b = t("part").select(p.alias("id"), (p % 500).cast("int").alias("x0"), (p % 300).cast("int").alias("y0"), (p % 500 + p % 37).cast("int").alias("x1"), (p % 300 + p % 23).cast("int").alias("y1"))
    m = G.min_size(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 510, 310, 20, 16)
    return b.select("id", m.alias("m"), F.round(G.upscale_factor((F.col("y1") - F.col("y0")).cast("double")), 6).alias("factor"), G.fit_size((F.col("x1") + 900).cast("double"), (F.col("y1") + 700).cast("double"))["w"].alias("w")).select("id", "m.*", "factor", "w")


@query(
    """WITH r AS (SELECT p_partkey AS region, (p_partkey % 100)::INT AS y0, (p_partkey % 100 + 200 + p_partkey % 400)::INT AS y1, (1 + p_partkey % 4)::INT AS n FROM part), h AS (SELECT *, (y1 - y0) / n::DOUBLE AS h, unnest(range(0, n)) AS k FROM r)
SELECT region, k::INT AS k, greatest(y0, floor(y0 + k * h - h * 0.15)::INT) AS ty0, least(y1, ceil(y0 + (k + 1) * h + h * 0.15)::INT) AS ty1 FROM h"""
)
def overlap_tiles(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    r = t("part").select(p.alias("region"), (p % 100).cast("int").alias("y0"), (p % 100 + 200 + p % 400).cast("int").alias("y1"), (1 + p % 4).cast("int").alias("tiles"))
    return G.tiles(r)


@query("SELECT 18 * 0.6::DOUBLE AS height")
def text_height(t: Tables) -> DataFrame:
    """Rows of text every 18 pixels, 7 of them dark."""
    return G.text_height(t.spark.range(200).select(F.col("id").alias("y"), F.when(F.col("id") % 18 < 7, 1.0).otherwise(0.0).alias("x")))


@query(
    """WITH c AS (SELECT idx, r, c, abs(vec[1])::DOUBLE AS ink, abs(vec[2])::DOUBLE AS sharp FROM patches), s AS (SELECT CASE WHEN ink < 0.05 THEN 'blank' WHEN sharp < 0.08 THEN 'illegible' ELSE 'legible' END AS state FROM c)
SELECT state, count(*) AS n FROM s GROUP BY 1""",
    ("patches",),
)
def legibility_counts(t: Tables) -> DataFrame:
    cells = t.fixture("patches").select("r", "c", F.abs(F.element_at("vec", 1)).cast("double").alias("ink"), F.abs(F.element_at("vec", 2)).cast("double").alias("sharp"))
    return G.legibility(cells, 0.05, 0.08).groupBy("state").agg(F.count("*").alias("n"))


def _hashed(src: str, keys: str) -> str:
    """Counts of hashed 3-grams by bucket, as rows."""
    return f"""SELECT {keys}, b, count(*)::DOUBLE AS n FROM (SELECT {keys}, ('0x' || substr(md5(substr(s, i, 3)), 1, 4))::INT % 64 AS b FROM (SELECT {keys}, s, unnest(range(1, greatest(1, length(s) - 2) + 1)) AS i FROM {src})) GROUP BY ALL"""


DOCS = "ds AS (SELECT doc_id, ' ' || lower(coalesce(text, '')) || ' ' AS s FROM documents), dv AS (" + _hashed("ds", "doc_id") + "), dn AS (SELECT doc_id, sqrt(sum(n * n)) AS n FROM dv GROUP BY 1)"


@query(f"WITH {DOCS} SELECT doc_id, round(any_value(dn.n), 6) AS norm, round(coalesce(max(dv.n) FILTER (b = 0), 0) / any_value(dn.n), 6)::DOUBLE AS first, round(max(dv.n) / any_value(dn.n), 6) AS top FROM dv JOIN dn USING (doc_id) GROUP BY 1")
def hash_embeddings(t: Tables) -> DataFrame:
    vectors = PR.hash_vectors(t("documents"), "doc_id", "text").select("doc_id", "vec", "norm")
    return vectors.select("doc_id", F.round("norm", 6).alias("norm"), F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.array_max("vec"), 6).alias("top"))


ANCHORS = ", ".join(f"('{c}', {k}, '{x.format(name=n)}')" for c, n in P.LANGUAGE_NAMES.items() for k, x in enumerate(P.LANGUAGE_TEMPLATES)) + ", " + ", ".join(f"('noise', {k}, '{x}')" for k, x in enumerate(P.NOISE_SENTENCES))
PROFILE = f"""
{DOCS}, bs AS (SELECT code, template, ' ' || lower(x) || ' ' AS s FROM (VALUES {ANCHORS}) t(code, template, x)), bv AS ({_hashed("bs", "code, template")}), bn AS (SELECT code, template, sqrt(sum(n * n)) AS n FROM bv GROUP BY ALL),
dots AS (SELECT doc_id, code, template, sum(dv.n * bv.n) AS dot FROM dv JOIN bv USING (b) GROUP BY ALL),
s AS (SELECT dn.doc_id, bn.code, bn.template, coalesce(dot, 0) / (dn.n * bn.n) AS s FROM dn CROSS JOIN bn LEFT JOIN dots ON dots.doc_id = dn.doc_id AND dots.code = bn.code AND dots.template = bn.template),
c AS (SELECT *, s - avg(s) OVER (PARTITION BY doc_id, template) AS n FROM s WHERE code <> 'noise'),
prof AS (SELECT doc_id, code, max(s) AS absolute, max(n) AS neutral FROM c GROUP BY ALL), noise AS (SELECT doc_id, max(s) AS noise FROM s WHERE code = 'noise' GROUP BY 1)
"""


def _profiles(t: Tables) -> DataFrame:
    docs = PR.hash_vectors(t("documents"), "doc_id", "text")
    return LG.profile(docs, LG.anchors(t.spark, PR.hash_embedding), "doc_id")


@query(f"WITH {PROFILE} SELECT doc_id, code, round(absolute, 6) AS absolute, round(neutral, 6) AS neutral, round(noise, 6) AS noise FROM prof JOIN noise USING (doc_id)")
def language_profile(t: Tables) -> DataFrame:
    return _profiles(t).select("doc_id", "code", F.round("absolute", 6).alias("absolute"), F.round("neutral", 6).alias("neutral"), F.round("noise", 6).alias("noise"))


@query(
    f"""WITH {PROFILE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(neutral, 9) DESC, code) AS rn, CASE code {" ".join(f"WHEN '{c}' THEN {p}" for c, p in P.LATIN_PRIORS.items())} END AS prior, (code IN ('eng', 'deu', 'fra'))::INT AS served FROM prof),
o AS (SELECT doc_id, max(code) FILTER (rn = 1) AS best, max(neutral) FILTER (rn = 1) AS n1, max(neutral) FILTER (rn = 2) AS n2, max(neutral) FILTER (code = 'eng') AS ref, max(absolute) AS ab, stddev_pop(neutral) AS spread, round(stddev_pop(neutral) FILTER (rn > 1), 9) AS band,
  arg_max(code, served * 1000 + prior * 100 + neutral) AS anyc, arg_max(code, served * 1000 + prior * 100 + neutral) FILTER (rn <= 3 OR code = 'eng') AS topc, arg_min(code, rn) FILTER (served = 1) AS alt, arg_min(neutral, rn) FILTER (served = 1) AS altn FROM r GROUP BY 1),
x AS (SELECT *, round(n1 - n2, 9) AS m12, CASE WHEN band <= 1e-6 THEN round(n1 - n2, 9) >= 0.010 AND n1 - ref >= 0.020 ELSE round(n1 - n2, 9) >= band END AS dec, round(noise, 9) > round(ab * 1.5, 9) AS noisy, round(ab - noise, 9) <= round(spread, 9) AS flat FROM o JOIN noise USING (doc_id))
SELECT doc_id, CASE WHEN noisy THEN 'eng' WHEN flat THEN anyc WHEN best = 'eng' THEN 'eng' WHEN dec AND best NOT IN ('eng', 'deu', 'fra') AND n1 - altn < band * 2 THEN alt WHEN dec THEN best ELSE topc END AS language,
  CASE WHEN noisy THEN 'noise-fallback' WHEN flat THEN 'script-prior' WHEN best = 'eng' THEN 'reference-locked' WHEN dec AND best NOT IN ('eng', 'deu', 'fra') AND n1 - altn < band * 2 THEN 'served-swap' WHEN dec THEN 'cosine-decided' ELSE 'script-prior' END AS stage, round(m12, 6) AS margin FROM x"""
)
def language_fusion(t: Tables) -> DataFrame:
    f = LG.fused(_profiles(t), "doc_id", ["eng", "deu", "fra"])
    return f.select("doc_id", "language", "stage", F.round("margin", 6).alias("margin"))


@query(
    f"""WITH l AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn % 4 = 2 THEN 'каталог товаров' ELSE text END AS s FROM conversations),
n AS (SELECT conv_id, turn, len(regexp_extract_all(s, {q(P.LATIN_LETTERS)})) AS l, len(regexp_extract_all(s, '[{P.BLOCKS[3][2]}]')) AS c FROM l),
r AS (SELECT *, coalesce(sum(l) OVER w, 0) AS sl, coalesce(sum(c) OVER w, 0) AS sc FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, coalesce(CASE WHEN l + c > 0 THEN CASE WHEN sl + sc >= 12 AND greatest(sl, sc) >= (sl + sc) * 0.7 THEN (CASE WHEN sl > sc THEN 'Latin' ELSE 'Cyrillic' END) <> (CASE WHEN l >= c THEN 'Latin' ELSE 'Cyrillic' END) END END, false) AS conflict FROM r"""
)
def script_conflicts(t: Tables) -> DataFrame:
    s = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") % 4 == 2), "каталог товаров").otherwise(F.col("text"))
    rows = t("conversations").select("conv_id", "turn", s.alias("text"))
    return LG.script_conflicts(rows, "conv_id", "turn", "text").select("conv_id", "turn", "conflict")


@query(
    """WITH s AS (SELECT page, seq, score, (region / 4.0)::DOUBLE AS cohesion FROM boxes) SELECT page, seq, score <= 0 OR 0.4::DOUBLE * (seq % 5) > score * (1 + greatest(0, least(0.5, cohesion))) AS dominated FROM s""",
    ("boxes",),
)
def prejudice_dominates(t: Tables) -> DataFrame:
    b = t.fixture("boxes")
    return b.select("page", "seq", S.prejudice_dominates(F.col("score"), 0.4 * (F.col("seq") % 5), F.col("region") / 4.0).alias("dominated"))


@query(
    f"""WITH v AS (SELECT idx AS claim, vec, r // 2 AS r0, r // 2 + 1 AS r1, c // 2 AS c0, c // 2 + 1 AS c1, idx % 7 AS doc, 'f' || (idx % 3)::VARCHAR AS field FROM patches),
s AS (SELECT v.claim, list_cosine_similarity(v.vec::DOUBLE[], p.vec::DOUBLE[]) AS sim, p.r BETWEEN r0 AND r1 AND p.c BETWEEN c0 AND c1 AS inside FROM v, patches p),
a AS (SELECT claim, avg(sim) AS m, greatest(stddev_pop(sim), 1e-6) AS sd, max(sim) FILTER (inside) AS i, max(sim) FILTER (NOT inside) AS o, count(*) FILTER (inside) AS ni, count(*) FILTER (NOT inside) AS no FROM s GROUP BY 1),
z AS (SELECT claim, (i - m) / sd - sqrt(2 * ln(ni)) AS si, (o - m) / sd - sqrt(2 * ln(no)) AS so FROM a)
SELECT doc, field FROM v JOIN z USING (claim) GROUP BY doc, field HAVING NOT bool_or(si >= so OR so - si < 0.5)""",
    ("patches",),
)
def ungrounded_fields(t: Tables) -> DataFrame:
    p = t.fixture("patches").withColumn("page", F.lit(1))
    half = lambda c: F.floor(F.col(c) / 2)
    claims = p.select("page", F.col("idx").alias("claim"), "vec", half("r").alias("r0"), (half("r") + 1).alias("r1"), half("c").alias("c0"), (half("c") + 1).alias("c1"))
    verdicts = H.grounded(claims, p, "page").join(p.select(F.col("idx").alias("claim"), (F.col("idx") % 7).alias("doc"), F.concat(F.lit("f"), (F.col("idx") % 3).cast("string")).alias("field")), "claim")
    return H.dropped_fields(verdicts, "doc", "field")


@query(
    """WITH c AS (SELECT doc, seq, s, e, field, score, confirmed FROM spans), r AS (SELECT DISTINCT doc, s, e, 'f9' AS f, 0.5::DOUBLE AS sc FROM spans WHERE seq % 2 = 0)
SELECT doc, seq, s, e, confirmed, CASE WHEN r.f IS NOT NULL AND NOT confirmed AND r.f <> field AND sc > score THEN r.f ELSE field END AS field, CASE WHEN r.f IS NOT NULL AND NOT confirmed AND r.f <> field AND sc > score THEN sc ELSE score END AS score,
  coalesce(NOT confirmed AND r.f <> field AND sc > score, false) AS replaced FROM c LEFT JOIN r USING (doc, s, e)""",
    ("spans",),
)
def plinko_override(t: Tables) -> DataFrame:
    spans = t.fixture("spans")
    results = spans.where("seq % 2 = 0").select("doc", "s", "e").distinct().withColumns({"field": F.lit("f9"), "score": F.lit(0.5)})
    return N.plinko_override(spans, results)


@query(
    """WITH w AS (SELECT DISTINCT upos, dep FROM (VALUES ('NOUN', 'nsubj:pass'), ('DET', 'det'), ('PROPN', 'flat:name'), ('VERB', 'root'), ('SYM', 'punct')) t(upos, dep)), l AS (SELECT conv_id, turn, (turn % 5)::INT AS k, (turn % 10) / 20.0 AS ratio FROM conversations),
v AS (SELECT *, k IN (0, 2) AS entity FROM l), g AS (SELECT *, entity OR ratio >= 0.2 AS good, bool_or(entity OR ratio >= 0.2) OVER (PARTITION BY conv_id) AS any_good FROM v)
SELECT conv_id, turn, entity FROM g WHERE good OR NOT any_good"""
)
def entity_lines(t: Tables) -> DataFrame:
    """A fake analyser gives every line one word; verbs, determiners and signs without a fitting relation aren't entities."""
    k = (F.col("turn") % 5).cast("int")
    upos = F.element_at(F.array(*[F.lit(x) for x in ("NOUN", "DET", "PROPN", "VERB", "SYM")]), k + 1)
    dep = F.element_at(F.array(*[F.lit(x) for x in ("nsubj:pass", "det", "flat:name", "root", "punct")]), k + 1)
    rows = t("conversations").select("conv_id", "turn", PR.entity_verdict(F.array(upos), F.array(dep)).alias("entity"), ((F.col("turn") % 10) / 20.0).alias("ratio"))
    return PR.keep_entity_lines(rows, "conv_id").select("conv_id", "turn", "entity")
