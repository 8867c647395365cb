"""Queries over schemas, label indexes, lines, records and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import bank as B
from ..operators import lines as L
from ..operators import records as R
from ..sources import documents as SRC
from ..streaming import events as E
from .registry import Tables, query
from .text_queries import COMPACT, IDENT, q

TRIPLES = [
    ("base", "", "header", "doc_number", "{String} invoice number, document number", 0), ("base", "", "header", "issue_date", "{String} date of issue", 1), ("base", "", "financials", "amount", "{Number} total amount due", 2),
    ("base", "", "items", "quantity", "{Number} quantity of goods; units", 3), ("base", "", "parties", "recipient_name", "{String} name of the recipient", 4), ("overlay", "CINV", "financials", "amount", "{Number} invoice amount payable", 0),
    ("overlay", "CINV", "header", "issue_date", "  ", 1), ("overlay", "CINV", "logistics", "reference_bl", "{String} bill of lading number", 2), ("overlay", "PL", "packing_details", "carton_count", "{Number} number of cartons", 0),
]
TRIPLES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', '{e}', {f})" for a, b, c, d, e, f in TRIPLES) + ") t(part, doc_type, category, field, description, ord)"


def _triples(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(TRIPLES, "part string, doc_type string, category string, field string, description string, ord int")


SCHEMA = f"""
tr AS (SELECT * FROM {TRIPLES_SQL}), b AS (SELECT * FROM tr WHERE part = 'base'), o AS (SELECT * FROM tr WHERE part = 'overlay' AND doc_type = 'CINV'),
sf AS (SELECT coalesce(b.category, o.category) AS category, coalesce(b.field, o.field) AS field, coalesce(nullif(trim(o.description), ''), b.description, o.description, '') AS description, coalesce(b.ord, o.ord + 1000000) AS ord
  FROM b FULL JOIN o ON b.category = o.category AND b.field = o.field)
"""


@query(
    f"""WITH {SCHEMA} SELECT category, field, ord::INT AS ord, regexp_replace(regexp_replace(regexp_replace(description, '\\{{(String|Number|Boolean|Array)\\}}', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS semantic,
  CASE WHEN contains(description, '{{Number}}') THEN 'numeric' ELSE '' END AS format, category IN ('items', 'containers', 'charges', 'packing_details') AS "array", category IN ('items', 'containers') AS "table" FROM sf"""
)
def schema_definitions(t: Tables) -> DataFrame:
    return B.field_definitions(B.schema_fields(_triples(t), "CINV"))


DEFS = [
    ("amount", 0, "label", "Amount Due, Total^1.5"), ("amount", 0, "semantic", "amount to be paid"), ("amount", 0, "bias", "grand total, balance, !"), ("amount", 0, "value", "12.50"), ("amount", 0, "prejudice", "tax rate; Total"),
    ("date", 1, "label", "Issue Date|Date"), ("date", 1, "semantic", "date of issue"), ("date", 1, "bias", "Date, day"), ("buyer", 2, "label", "Buyer"), ("buyer", 2, "semantic", "name of the buyer"), ("buyer", 2, "bias", "purchaser, Grand Total"),
]
DEFS_SQL = "(VALUES " + ", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in DEFS) + ") t(field, ford, kind, text)"
WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {P.WEIGHTS[k]}" for k in ("label", "semantic", "bias", "value", "prejudice")) + " END"


@query(
    f"""WITH d AS (SELECT field, ford, kind, trim(p) AS p, i AS ord FROM (SELECT field, ford, kind, unnest(x) AS p, generate_subscripts(x, 1) - 1 AS i FROM (SELECT *, regexp_split_to_array(text, '[,;|\\n]+') AS x FROM {DEFS_SQL}))),
s AS (SELECT field, ford, kind, CASE WHEN contains(p, '^') THEN split_part(p, '^', 1) ELSE p END AS phrase, (CASE WHEN contains(p, '^') THEN split_part(p, '^', 2)::DOUBLE ELSE {WEIGHT} END)::DOUBLE AS weight, ord FROM d WHERE regexp_matches(p, '[\\p{{L}}\\p{{N}}]')),
lab AS (SELECT field, 'label' AS kind, phrase, weight, 0 AS prio, 0 AS a, ford, ord AS o FROM s WHERE kind = 'label'),
bias AS (SELECT field, phrase, weight, CASE kind WHEN 'semantic' THEN 0 WHEN 'bias' THEN 1 ELSE 2 END AS prio, ford, ord, kind FROM s WHERE kind IN ('semantic', 'bias', 'value') QUALIFY row_number() OVER (PARTITION BY field, lower(phrase) ORDER BY prio, ord) = 1),
n AS (SELECT DISTINCT field FROM s),
pre AS (SELECT field, phrase, weight, 0 AS prio, 0 AS a, ord AS o FROM s WHERE kind = 'prejudice' UNION ALL SELECT n.field, phrase, 0.9, 1, ford, o FROM n, lab
  UNION ALL SELECT n.field, phrase, least(weight, 0.85), 2, ford, prio * 1000 + ord FROM n JOIN bias ON n.field <> bias.field AND bias.kind IN ('semantic', 'bias')
  UNION ALL SELECT n.field, c.phrase, 1.0, 3, 0, c.o FROM n, (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(P.CHROME))}) c(phrase, o)),
ag AS (SELECT * FROM pre WHERE NOT EXISTS (SELECT 1 FROM bias WHERE bias.field = pre.field AND lower(bias.phrase) = lower(pre.phrase)) QUALIFY row_number() OVER (PARTITION BY field, lower(phrase) ORDER BY prio, a, o) = 1),
al AS (SELECT field, 'prejudice' AS kind, phrase, weight::DOUBLE AS weight, prio, a, o FROM ag UNION ALL SELECT field, 'bias', phrase, weight, prio, 0, ord FROM bias UNION ALL SELECT field, kind, phrase, weight, prio, 0, o FROM lab)
SELECT field, kind, phrase, weight, (row_number() OVER (PARTITION BY field, kind ORDER BY prio, a, o) - 1)::INT AS ord FROM al"""
)
def bank_build(t: Tables) -> DataFrame:
    return B.field_bank(t.spark.createDataFrame(DEFS, "field string, ford int, kind string, text string"))


SURFACES = [("amount", 0, "amount", "name"), ("amount", 1, "Total Amount Due", "label"), ("amount", 2, "invoice total", "semantic"), ("date", 3, "issue date", "label"), ("date", 4, "date", "name"), ("buyer", 5, "buyer name", "label"), ("number", 6, "Invoice Number", "label"), ("number", 7, "document no", "semantic"), ("ship", 8, "ship to", "label"), ("ship", 9, "xy", "value"), ("priority", 10, "order priority 5-LOW", "bias")]
SURF_SQL = "(VALUES " + ", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in SURFACES) + ") t(field, ord, surface, source)"


def _grams(src: str, keep: str) -> str:
    return f"""SELECT {keep}, substr(key, i, s) AS gram, count(*) AS tf FROM (SELECT {keep}, key, s, unnest(range(1, length(key) - s + 2)) AS i FROM {src}, (VALUES (2), (3)) z(s)) GROUP BY ALL"""


INDEX = f"""
su AS (SELECT *, {COMPACT.format("surface")} AS key, CASE source WHEN 'label' THEN 1.3 WHEN 'name' THEN 1.15 WHEN 'semantic' THEN 1.1 WHEN 'bias' THEN 1.0 ELSE 0.7 END AS w FROM {SURF_SQL}), sk AS (SELECT * FROM su WHERE length(key) >= 3),
stf AS ({_grams("sk", "ord, field, w")}), idf AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM sk)) / (1 + count(DISTINCT ord))) + 1 AS idf FROM stf GROUP BY 1),
post AS (SELECT ord, field, w, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY ord)) AS x FROM stf JOIN idf USING (gram)),
lk AS (SELECT id, v AS label, {COMPACT.format("v")} AS key FROM samples), lk3 AS (SELECT * FROM lk WHERE length(key) >= 3),
ex AS (SELECT key, arg_min(field, ord) AS field FROM sk GROUP BY 1), sure AS (SELECT id, ex.field, 1.0::DOUBLE AS score FROM lk3 JOIN ex USING (key)), rest AS (SELECT * FROM lk3 WHERE key NOT IN (SELECT key FROM ex)),
qtf AS ({_grams("rest", "id")}), qv AS (SELECT id, gram, tf * coalesce(idf, 1.0) AS q FROM qtf LEFT JOIN idf USING (gram)), qn AS (SELECT id, sqrt(sum(q * q)) AS n FROM qv GROUP BY 1),
raw AS (SELECT id, ord, field, w, sum(q * x) AS dot FROM qv JOIN post USING (gram) GROUP BY ALL),
scores AS (SELECT * FROM sure UNION ALL SELECT id, field, max(least(0.999, dot / n * w)) FROM raw JOIN qn USING (id) GROUP BY ALL)
"""


def _label_scores(t: Tables) -> tuple[DataFrame, DataFrame]:
    index = B.label_index(t.spark.createDataFrame(SURFACES, "field string, ord int, surface string, source string"))
    labels = t.fixture("samples").withColumnRenamed("v", "label")
    return labels, B.label_scores(labels, index)


@query(f"WITH {INDEX} SELECT id, field, round(score, 6) AS score FROM scores", ("samples",))
def label_index_scores(t: Tables) -> DataFrame:
    return _label_scores(t)[1].withColumn("score", F.round("score", 6))


@query(
    f"""WITH {INDEX}, r AS (SELECT *, row_number() OVER w AS rn, lead(field) OVER w AS rival, lead(score) OVER w AS rs FROM scores WINDOW w AS (PARTITION BY id ORDER BY round(score, 9) DESC, field)),
f AS (SELECT r.*, length(key) AS n FROM r JOIN lk USING (id) WHERE rn = 1)
SELECT id, CASE WHEN score >= 1 OR (score >= CASE WHEN n <= 3 THEN 0.8 WHEN n >= 9 THEN 0.42 ELSE 0.8 - 0.38 * (n - 3) / 6.0 END AND (rival IS NULL OR score - rs >= 0.05)) THEN field ELSE '' END AS field,
  round(score, 6) AS score, coalesce(rival, '') AS rival, round(coalesce(rs, 0), 6)::DOUBLE AS rival_score FROM f""",
    ("samples",),
)
def label_match(t: Tables) -> DataFrame:
    labels, scores = _label_scores(t)
    m = B.matched_labels(labels, scores)
    return m.select("id", "field", F.round("score", 6).alias("score"), "rival", F.round("rival_score", 6).alias("rival_score"))


@query("SELECT id % 50 AS field, list_sort(list(n))[count(*) // 2 + 1]::INT AS typical, list_sort(list(n))[least(count(*) - 1, floor(count(*) * 0.9))::INT + 1]::INT AS capacity FROM (SELECT id, length(regexp_replace(v, '\\s+', '', 'g')) AS n FROM samples) WHERE n > 0 GROUP BY 1", ("samples",))
def value_lengths(t: Tables) -> DataFrame:
    return B.value_lengths(t.fixture("samples").select((F.col("id") % 50).alias("field"), F.col("v").alias("text")))


@query(
    """WITH n AS (SELECT conv_id, count(*) * 3 AS n FROM conversations GROUP BY 1), p AS (SELECT conv_id, n, greatest(1, least(6, greatest(1, round_even(n / 12.0, 0)::INT + 1))) AS g FROM n),
s AS (SELECT conv_id, n, CASE WHEN n > 12 AND g > 1 THEN g ELSE 1 END AS stride, CASE WHEN n > 12 AND g > 1 THEN g ELSE 2 END AS width FROM p)
SELECT conv_id, (k * stride)::INT AS "start", least(n, k * stride + width) AS "end" FROM (SELECT *, unnest(range(0, greatest(0, ceil((n - width) / stride::DOUBLE))::INT + 1)) AS k FROM s)"""
)
def line_windows(t: Tables) -> DataFrame:
    pages = t("conversations").groupBy("conv_id").agg((F.count("*") * 3).alias("n"))
    return L.read_windows(pages, "conv_id", "n")


VOTES = """
f AS (SELECT page, line, seq, text, regexp_replace(text, '[\\s\\x{00A0}]+', '', 'g') AS form, CASE WHEN source = 'ocr' THEN CASE WHEN conf < 0.6 THEN least(0.3, greatest(0.3, 2.6 * conf)) ELSE greatest(0.3, 2.6 * conf) END ELSE 1.0 END::DOUBLE AS w FROM votes),
tally AS (SELECT page, line, form, sum(w) AS weight, arg_min(text, struct_pack(a := -w, b := seq, c := text)) AS best FROM f GROUP BY ALL)
"""


@query(
    f"""WITH {VOTES}, r AS (SELECT *, row_number() OVER o AS rn, lead(weight) OVER o AS second FROM tally WINDOW o AS (PARTITION BY page, line ORDER BY round(weight, 9) DESC, form))
SELECT page, line, best AS text, round(weight, 6) AS weight, round(weight - coalesce(second, 0), 6) AS margin, second IS NOT NULL AND round(weight - coalesce(second, 0), 9) < 0.8 AS contested FROM r WHERE rn = 1""",
    ("votes",),
)
def line_votes(t: Tables) -> DataFrame:
    v = L.vote_lines(t.fixture("votes"), ["page", "line"])
    return v.select("page", "line", "text", F.round("weight", 6).alias("weight"), F.round("margin", 6).alias("margin"), "contested")


@query(
    f"""WITH {VOTES}, tl AS (SELECT page, line, length(form) AS n, round(sum(w), 9) AS w FROM f GROUP BY ALL), target AS (SELECT page, line, n FROM tl QUALIFY row_number() OVER (PARTITION BY page, line ORDER BY w DESC, n DESC) = 1),
ch AS (SELECT page, line, unnest(string_split(form, '')) AS ch, generate_subscripts(string_split(form, ''), 1) AS p, w, seq FROM f JOIN target USING (page, line) WHERE length(form) = n),
s AS (SELECT page, line, p, ch, round(sum(w), 9) AS w, min(seq) AS first FROM ch GROUP BY ALL), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page, line, p ORDER BY w DESC, first) = 1)
SELECT page, line, string_agg(ch, '' ORDER BY p) AS body FROM b GROUP BY ALL""",
    ("votes",),
)
def char_consensus(t: Tables) -> DataFrame:
    return L.char_consensus(t.fixture("votes"), ["page", "line"])


@query("SELECT o_orderkey AS page, 'hello world ' || o_orderkey::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN ' again' ELSE chr(10) || 'apart' END AS text FROM orders")
def stitch(t: Tables) -> DataFrame:
    """Three windows of every order: the second begins with the end of the first, the third goes on or stands apart."""
    o = t("orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderkey").cast("string").alias("k"))
    parts = F.array(F.struct(F.lit(0).alias("seq"), F.lit("hello wor").alias("text")), F.struct(F.lit(1).alias("seq"), F.concat(F.lit(" world "), "k").alias("text")), F.struct(F.lit(2).alias("seq"), F.when(F.col("page") % 2 == 0, F.concat(F.lit("ld "), "k", F.lit(" again"))).otherwise("apart").alias("text")))
    return L.stitched(o.select("page", F.explode(parts).alias("p")).select("page", "p.seq", "p.text"), ["page"])


@query(
    """WITH f AS (SELECT l_orderkey AS line, l_linenumber AS t, l_partkey % 4 AS k, l_discount AS prob FROM lineitem), b AS (SELECT line, t, k, prob FROM f QUALIFY row_number() OVER (PARTITION BY line, t ORDER BY prob DESC, k) = 1),
x AS (SELECT *, lag(k) OVER (PARTITION BY line ORDER BY t) AS p FROM b)
SELECT line, list(k ORDER BY t) AS ks, round(avg(prob), 6) AS conf FROM x WHERE k <> 0 AND (p IS NULL OR p <> k) GROUP BY 1"""
)
def ctc_decode(t: Tables) -> DataFrame:
    frames = t("lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("t"), (F.col("l_partkey") % 4).alias("k"), F.col("l_discount").alias("prob"))
    return L.ctc(frames, ["line"]).withColumn("conf", F.round("conf", 6))


UNIT = "u AS (SELECT page, greatest(8, list_sort(list((y1 - y0)::DOUBLE))[count(*) // 2 + 1]) AS unit FROM ocr_rows GROUP BY 1)"


@query(
    f"""WITH {UNIT}, l AS (SELECT r.*, unit, lag(y1) OVER w AS py1, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1 FROM ocr_rows r JOIN u USING (page) WINDOW w AS (PARTITION BY page ORDER BY y0, x0, seq))
SELECT page, seq, sum(CASE WHEN (y0 - py1) / unit > 0.9 OR least(px1, x1) - greatest(px0, x0) <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, x0, seq)::BIGINT AS block FROM l""",
    ("ocr_rows",),
)
def prose_blocks(t: Tables) -> DataFrame:
    return L.prose_blocks(t.fixture("ocr_rows"), "page")


GEO = f"""
{UNIT}, a AS (SELECT * FROM ocr_rows WHERE starts_with(text, 'LABEL')), b AS (SELECT * FROM ocr_rows WHERE NOT starts_with(text, 'LABEL')),
p AS (SELECT a.page, a.seq AS ls, b.seq AS vs, (b.y0 - a.y1) / unit AS gy, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS ov, a.x1 - a.x0 AS lw, b.x1 - b.x0 AS vw, abs((b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2) AS dx,
  (b.x0 - a.x1) / unit AS gx, abs((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) / unit AS vert FROM a JOIN b USING (page) JOIN u USING (page)),
c AS (SELECT page, ls, vs, round(CASE WHEN gy BETWEEN -0.2 AND 2.2 AND ov > 0 THEN abs(gy) + dx / greatest(1, lw) + (1 - least(1, ov / greatest(1, least(lw, vw)))) * 1.6 END, 9) AS un, round(CASE WHEN gx BETWEEN 0 AND 1.2 AND vert <= 0.6 THEN gx + vert * 0.5 END, 9) AS bs FROM p),
o AS (SELECT page, ls, vs, least(un, bs) AS cost, CASE WHEN bs IS NOT NULL AND (un IS NULL OR bs < un) THEN 'right' ELSE 'below' END AS mode FROM c WHERE un IS NOT NULL OR bs IS NOT NULL),
lab AS (SELECT page, ls, list({{'cost': cost, 'vs': vs, 'mode': mode}} ORDER BY cost, vs) AS opts, row_number() OVER (PARTITION BY page ORDER BY ls) AS k FROM o GROUP BY page, ls),
step AS (SELECT page, 0 AS k, [{{'ls': 0, 'vs': -1, 'mode': ''}}] AS w FROM (SELECT DISTINCT page FROM lab)
  UNION ALL SELECT s.page, s.k + 1, CASE WHEN len(free) > 0 THEN list_append(w, {{'ls': ls, 'vs': free[1].vs, 'mode': free[1].mode}}) ELSE w END
  FROM (SELECT step.page, step.k, w, lab.ls, list_filter(opts, lambda x: NOT list_contains(list_transform(w, lambda y: y.vs), x.vs)) AS free FROM step JOIN lab ON lab.page = step.page AND lab.k = step.k + 1) s)
"""


@query(f"WITH {GEO} SELECT page, x.ls AS label_seq, x.vs AS value_seq, x.mode AS mode FROM (SELECT page, unnest(w) AS x FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1)) WHERE x.vs >= 0", ("ocr_rows",))
def geometry_pairs(t: Tables) -> DataFrame:
    return L.geometry_pairs(t.fixture("ocr_rows"), "page")


@query(
    f"""WITH {UNIT}, c AS (SELECT r.*, unit, row_number() OVER (PARTITION BY page ORDER BY conf DESC, y0, x0, seq) AS n FROM ocr_rows r JOIN u USING (page)),
step AS (SELECT page, 0 AS n, [{{'seq': -1, 'text': '', 'x0': -9999, 'y0': -9999, 'x1': -9998, 'y1': -9998}}] AS w FROM (SELECT DISTINCT page FROM c)
  UNION ALL SELECT step.page, step.n + 1, CASE WHEN len(list_filter(w, lambda y: (greatest(0, least(y.x1, c.x1) - greatest(y.x0, c.x0)) * greatest(0, least(y.y1, c.y1) - greatest(y.y0, c.y0)))::DOUBLE
      / ((y.x1 - y.x0) * (y.y1 - y.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - greatest(0, least(y.x1, c.x1) - greatest(y.x0, c.x0)) * greatest(0, least(y.y1, c.y1) - greatest(y.y0, c.y0))) >= 0.35
      OR ((abs((y.x0 + y.x1) - (c.x0 + c.x1)) + abs((y.y0 + y.y1) - (c.y0 + c.y1))) / 2.0 <= c.unit * 0.75 AND 1 - levenshtein(y.text, c.text) / greatest(length(y.text), length(c.text), 1)::DOUBLE >= 0.95))) > 0 THEN w
    ELSE list_append(w, {{'seq': c.seq, 'text': c.text, 'x0': c.x0, 'y0': c.y0, 'x1': c.x1, 'y1': c.y1}}) END FROM step JOIN c ON c.page = step.page AND c.n = step.n + 1)
SELECT page, x.seq AS seq FROM (SELECT page, unnest(w) AS x FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC) = 1)) WHERE x.seq >= 0""",
    ("ocr_rows",),
)
def dedup_rows(t: Tables) -> DataFrame:
    return L.dedup_rows(t.fixture("ocr_rows"), "page")


@query(
    f"""WITH c AS (SELECT doc, seq, field, 'value ' || (seq % 7)::VARCHAR AS value, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, seq) AS n FROM spans),
step AS (SELECT doc, 0 AS n, [{{'field': '', 'key': '-', 'value': '', 'score': 0::DOUBLE}}] AS w FROM (SELECT DISTINCT doc FROM c)
  UNION ALL SELECT step.doc, step.n + 1, CASE WHEN len(list_filter(w, lambda y: y.field = c.field OR y.key = {COMPACT.format("c.value")})) > 0 THEN w ELSE list_append(w, {{'field': c.field, 'key': {COMPACT.format("c.value")}, 'value': c.value, 'score': c.score}}) END
  FROM step JOIN c ON c.doc = step.doc AND c.n = step.n + 1)
SELECT doc, x.field AS field, x.value AS value, x.score AS score FROM (SELECT doc, unnest(w) AS x FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC) = 1)) WHERE x.field <> ''""",
    ("spans",),
)
def reconcile_claims(t: Tables) -> DataFrame:
    p = t.fixture("spans").withColumn("value", F.concat(F.lit("value "), (F.col("seq") % 7).cast("string")))
    return L.reconcile(p, "doc")


REGIONS = "(VALUES (0, 0, 0, 40, 40), (1, 20, 10, 70, 50), (2, 60, 30, 130, 90)) r(region, rx0, ry0, rx1, ry1)"


@query(
    f"""WITH m AS (SELECT b.page, r.region, b.* EXCLUDE (page, region) FROM boxes b JOIN {REGIONS} ON (x0 + x1) / 2 BETWEEN rx0 AND rx1 AND (y0 + y1) / 2 BETWEEN ry0 AND ry1)
SELECT page, region, greatest(0, min(x0) - 4) AS x0, greatest(0, min(y0) - 4) AS y0, max(x1) + 4 AS x1, max(y1) + 4 AS y1 FROM m GROUP BY ALL""",
    ("boxes",),
)
def boxes_in_regions(t: Tables) -> DataFrame:
    boxes = t.fixture("boxes").drop("region")
    three = t.spark.createDataFrame([(0, 0, 0, 40, 40), (1, 20, 10, 70, 50), (2, 60, 30, 130, 90)], "region int, rx0 int, ry0 int, rx1 int, ry1 int")
    regions = boxes.select("page").distinct().crossJoin(F.broadcast(three))
    return L.tightened(L.boxes_inside(boxes, regions, "page"), "page")


ADDR = "CASE WHEN {n} = '' THEN '" + P.ZERO_ADDRESS + "' ELSE '0x' || sha1('{k}' || chr(31) || {n}) END"


def _ident(x: str) -> str:
    return IDENT.replace("coalesce(v, '')", x)


RECORD = f"""
g AS (SELECT doc, max(value) FILTER (field = 'doc_number') AS identity, max(value) FILTER (field = 'recipient_name') AS recipient, max(value) FILTER (field = 'reference_bl') AS bl,
  '0x' || sha1('digest' || chr(31) || lower(trim(regexp_replace(string_agg(field || '=' || value, '|' ORDER BY field) || '|~doc_type=CINV|~identity=' || max(value) FILTER (field = 'doc_number'), '\\s+', ' ', 'g')))) AS digest FROM record_fields GROUP BY 1)
"""


def _records(t: Tables) -> DataFrame:
    return R.envelope(R.grouped(t.fixture("record_fields"), "doc"), "doc", "CINV")


@query(
    f"""WITH {RECORD} SELECT doc, identity, digest, '0x' || sha1('id' || chr(31) || digest) AS id, {ADDR.format(n=_ident("'trading/CINV/' || identity"), k="cc")} AS cc, {ADDR.format(n=_ident("'trading/' || identity"), k="ref")} AS ref,
  {ADDR.format(n=_ident("'shipping/CINV/' || digest"), k="bcc")} AS bcc, {ADDR.format(n=_ident("coalesce(recipient, identity)"), k="to")} AS "to" FROM g""",
    ("record_fields",),
)
def record_envelope(t: Tables) -> DataFrame:
    return _records(t).select("doc", "identity", "digest", "id", "cc", "ref", "bcc", "to")


@query(
    f"""WITH {RECORD} SELECT doc, 'BL' AS target, 'transport' AS role, 'doc_number' AS key, bl AS value FROM g WHERE bl IS NOT NULL
UNION ALL SELECT doc, x, 'reference_invoice', 'reference_invoice', identity FROM g, (VALUES {", ".join(f"('{x}')" for x in P.RELAY_TARGETS if x != "CINV")}) v(x)""",
    ("record_fields",),
)
def relay_edges(t: Tables) -> DataFrame:
    return R.relay_edges(R.grouped(t.fixture("record_fields"), "doc"), "doc", "CINV")


@query(
    """WITH c AS (SELECT doc, category, 'Regarding ' || trim(replace(category, '_', ' ')) || ', ' || string_agg('Its ' || trim(replace(field, '_', ' ')) || ' is ' || value || '.', ' ' ORDER BY field) AS part FROM record_fields GROUP BY doc, category)
SELECT doc, string_agg(part, ' ' ORDER BY category) AS text FROM c GROUP BY 1""",
    ("record_fields",),
)
def record_sentences(t: Tables) -> DataFrame:
    return R.sentences(t.fixture("record_fields"), "doc")


@query(None)
def relay_index(t: Tables) -> DataFrame:
    """CRC-32 of identities (not in the oracle's engine): the tests hold it against zlib."""
    return _records(t).select("doc", "identity", "index")


@query("SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(t: Tables) -> DataFrame:
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.windowed(e).select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY user_id, s"""
)
def event_sessions(t: Tables) -> DataFrame:
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = E.sessions(e)
    return s.select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("finish").cast("timestamp_ntz").alias("finish"), "n")


@query(
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents)
SELECT doc_id, len(list_filter(pages, lambda p: length(trim(p)) >= 40 AND len(regexp_extract_all(p, '[\\p{L}\\p{N}]')) >= 20)) * 2 >= len(pages) AS layer, length(array_to_string(list_filter(list_transform(pages, lambda p: trim(p)), lambda p: p <> ''), chr(10) || chr(10)))::INT AS chars FROM p"""
)
def text_layer(t: Tables) -> DataFrame:
    pages = t("documents").select("doc_id", F.split("text", "\n").alias("pages"))
    return pages.select("doc_id", SRC.has_text_layer(F.col("pages")).alias("layer"), F.length(SRC.merged_text(F.col("pages"))).alias("chars"))


@query(
    """SELECT p_partkey AS id, CASE lower(regexp_extract(path, '\\.([^./]*)$', 1)) WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'csv' THEN 'text' WHEN 'json' THEN 'text' WHEN 'pdf' THEN 'pdf' ELSE 'image' END AS mode,
  greatest(72, least(300, floor(4000 / (greatest(w, h) / 72.0))))::INT AS dpi, least(512, greatest(1, p_partkey % 700))::BIGINT AS pages
FROM (SELECT p_partkey, '/data/d.' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.png' WHEN 3 THEN '.json' ELSE '' END AS path, (p_partkey % 900 + 100)::DOUBLE AS w, (p_partkey % 1300 + 100)::DOUBLE AS h FROM part)"""
)
def source_routing(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    tail = F.when(k % 5 == 0, ".TXT").when(k % 5 == 1, ".pdf").when(k % 5 == 2, ".png").when(k % 5 == 3, ".json").otherwise("")
    path = F.concat(F.lit("/data/d."), k.cast("string"), tail)
    return t("part").select(k.alias("id"), SRC.route(SRC.extension(path)).alias("mode"), SRC.fit_dpi((k % 900 + 100).cast("double"), (k % 1300 + 100).cast("double"), F.lit(300)).alias("dpi"), SRC.page_budget(k % 700).alias("pages"))


@query(
    f"""SELECT id, CASE WHEN id % 2 = 0 AND regexp_matches(lower(v), 'invoice') THEN '' ELSE v END AS v, regexp_matches(v, {q(P.UPPER_LABEL)}) AS upper FROM samples WHERE regexp_matches(v, '[0-9]') QUALIFY row_number() OVER (PARTITION BY lower(v) ORDER BY id) = 1""",
    ("samples",),
)
def distinct_phrases(t: Tables) -> DataFrame:
    """The first of texts that are equal but for case: what an encoder has to see once."""
    rows = t.fixture("samples").where(F.col("v").rlike("[0-9]"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(F.lower("v")).orderBy("id"))).where("n = 1")
    return first.select("id", F.when((F.col("id") % 2 == 0) & F.lower("v").rlike("invoice"), "").otherwise(F.col("v")).alias("v"), F.col("v").rlike(P.UPPER_LABEL).alias("upper"))


@query(None)
def repaired_json(t: Tables) -> DataFrame:
    """Cut-off dictionaries up to their last whole entry; the tests hold it against the whole ones."""
    rows = t("events").select("event_id", F.concat(F.lit('{"a": {"x": 1}, "props": '), "props", F.lit(', "cut": {"y": [1, ')).alias("s"))
    return rows.select("event_id", SRC.repair_json("s").alias("fixed"), F.get_json_object(SRC.repair_json("s"), "$.props").alias("props"), X.compact("s").alias("compact"))
