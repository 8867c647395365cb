"""Queries over schemas, formats and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import gate as GT
from ..operators import schema as SC
from .registry import Tables, query
from .text_queries import COMPACT, LABEL, PROBE, TRIM, q
from .vector_queries import COS

JUNK = r"(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]')) = 0 OR (len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]')) = 1 AND NOT regexp_matches({0}, '[^\x00-\x7F]')))"


@query(
    f"""WITH t AS (SELECT *, bool_or(lang = 'en') OVER (PARTITION BY field, key) AS has FROM schema_texts WHERE key <> 'prejudice'),
k AS (SELECT field, CASE key WHEN 'semantic' THEN 0 WHEN 'label' THEN 1 WHEN 'bias' THEN 2 ELSE 3 END AS k, CASE WHEN has AND lang = '*' THEN 1 ELSE 0 END AS place, ord, trim(text) AS phrase,
  CASE key WHEN 'semantic' THEN 1.45 WHEN 'label' THEN 1.3 WHEN 'bias' THEN 0.85 ELSE 0.7 END::DOUBLE AS weight FROM t WHERE NOT has OR lang IN ('en', '*')),
f AS (SELECT * FROM k WHERE phrase <> '' AND NOT {JUNK.format("phrase")} QUALIFY row_number() OVER (PARTITION BY field, lower(phrase) ORDER BY k, place, ord) = 1)
SELECT field, phrase, weight, row_number() OVER (PARTITION BY field ORDER BY k, place, ord)::INT AS ord FROM f""",
    ("schema_texts",),
)
def heat_phrases(t: Tables) -> DataFrame:
    return SC.heat_phrases(t.fixture("schema_texts"), "en")


@query(
    f"""WITH f AS (SELECT doc_type, field, min(ord) AS k0 FROM schema_texts GROUP BY ALL), h AS (SELECT *, bool_or(lang = 'ko') OVER (PARTITION BY doc_type, field, key) AS has FROM schema_texts WHERE key IN ('semantic', 'label')),
u AS (SELECT doc_type, field, trim(text) AS t FROM h WHERE (NOT has OR lang IN ('ko', '*')) AND trim(text) <> '' AND NOT {JUNK.format("trim(text)")}
  QUALIFY row_number() OVER (PARTITION BY doc_type, field ORDER BY key <> 'semantic', CASE WHEN has AND lang = '*' THEN 1 ELSE 0 END, ord) = 1),
p AS (SELECT f.doc_type, k0, coalesce(t, trim(replace(f.field, '_', ' '))) AS phrase FROM f LEFT JOIN u USING (doc_type, field)),
d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_type, lower(phrase) ORDER BY k0) = 1)
SELECT doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY k0)::INT AS n, phrase AS anchor FROM d QUALIFY n <= 12""",
    ("schema_texts",),
)
def field_anchors(t: Tables) -> DataFrame:
    return SC.field_anchors(t.fixture("schema_texts"), "ko")


@query(
    r"""WITH d AS (SELECT 'T_' || p_size AS doc_type, p_partkey AS ord, trim(regexp_replace(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN '{String} ' || p_type ELSE p_type END, '\{(String|Number|Boolean|Array)\}', ' ', 'g'), '\s+', ' ', 'g')) AS phrase FROM part),
o AS (SELECT * FROM d WHERE phrase <> '' QUALIFY row_number() OVER (PARTITION BY doc_type, lower(phrase) ORDER BY ord) = 1),
ty AS (SELECT DISTINCT doc_type FROM d UNION SELECT 'kind_' || n_name FROM nation)
SELECT doc_type, coalesce(row_number() OVER (PARTITION BY doc_type ORDER BY ord), 1)::INT AS n, coalesce(phrase, 'a ' || replace(doc_type, '_', ' ') || ' trade document') AS anchor FROM ty LEFT JOIN o USING (doc_type)"""
)
def doc_anchors(t: Tables) -> DataFrame:
    part = t("part").select(F.concat(F.lit("T_"), "p_size").alias("doc_type"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("{String} "), "p_type")).otherwise(F.col("p_type")).alias("description"))
    types = part.select("doc_type").union(t("nation").select(F.concat(F.lit("kind_"), "n_name")))
    return SC.doc_anchors(part, types)


@query(
    """WITH r AS (SELECT 'f' || p_size % 7 AS field, 0 AS part, p_partkey % 2 AS k, p_partkey AS ord, p_type AS phrase FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'f' || p_size % 9, 1, p_partkey % 2, p_partkey, upper(p_name) FROM part UNION ALL SELECT 'f' || p_size % 9, 1, p_partkey % 2, p_partkey + 1000000000, p_type FROM part),
d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY field, lower(phrase) ORDER BY part, ord, k) = 1)
SELECT field, row_number() OVER (PARTITION BY field ORDER BY part, ord, k)::INT AS n, phrase FROM d"""
)
def bridge_phrases(t: Tables) -> DataFrame:
    part, key = t("part"), F.when(F.col("p_partkey") % 2 == 0, "semantic").otherwise("bias")
    node = F.when(F.col("p_partkey") % 3 == 0, "other.f").otherwise("trade.f")
    valued = part.select(F.concat(node, F.col("p_size") % 7).alias("target"), key.alias("key"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("phrase"))
    target = F.concat(F.lit("x.y.f"), F.col("p_size") % 9).alias("target")
    abstract = part.select(target, key.alias("key"), F.col("p_partkey").alias("ord"), F.upper("p_name").alias("phrase")).union(part.select(target, key, F.col("p_partkey") + 1_000_000_000, "p_type"))
    return SC.bridge_phrases(valued, abstract, "trade")


@query("SELECT row_number() OVER (ORDER BY doc_type)::INT AS n, doc_type FROM (SELECT DISTINCT doc_type FROM schema_texts)", ("schema_texts",))
def doc_codes(t: Tables) -> DataFrame:
    return SC.doc_codes(t.fixture("schema_texts"))


@query(
    """SELECT field, count(*) FILTER (key = 'semantic') AS semantic, count(*) FILTER (key = 'label') AS label, count(*) FILTER (key = 'bias') AS bias, count(*) FILTER (key = 'value') AS value, count(*) FILTER (key = 'prejudice') AS prejudice, count(*) AS total FROM schema_texts GROUP BY 1""",
    ("schema_texts",),
)
def bank_stats(t: Tables) -> DataFrame:
    return SC.bank_stats(t.fixture("schema_texts").withColumnRenamed("key", "kind"))


@query(
    """SELECT field, coalesce(string_agg(text, '|' ORDER BY key <> 'semantic', ord) FILTER (key IN ('semantic', 'bias')), '') AS bias, coalesce(string_agg(text, '|' ORDER BY ord) FILTER (key = 'prejudice'), '') AS prejudice FROM schema_texts GROUP BY 1""",
    ("schema_texts",),
)
def legacy_phrases(t: Tables) -> DataFrame:
    return SC.legacy_phrases(t.fixture("schema_texts")).select("field", F.array_join("bias", "|").alias("bias"), F.array_join("prejudice", "|").alias("prejudice"))


@query(
    """WITH r AS (SELECT field, CASE WHEN category = '' THEN 'misc' ELSE category END AS category, nullif(lower(trim(format)), '') AS format, is_array OR is_table AS is_array FROM schema_fields)
SELECT *, bool_or(is_array) OVER (PARTITION BY category) AS array_category FROM r""",
    ("schema_fields",),
)
def field_lookups(t: Tables) -> DataFrame:
    return SC.field_lookups(t.fixture("schema_fields"))


@query("SELECT DISTINCT CASE WHEN category = '' THEN 'misc' ELSE category END AS category FROM schema_fields WHERE top_region OR field IN ('f_5', 'f_50')", ("schema_fields",))
def identity_categories(t: Tables) -> DataFrame:
    return SC.identity_categories(t.fixture("schema_fields"), ["f_5", "f_50"])


@query(
    """WITH ty AS (SELECT DISTINCT 'g' || p_size % 5 AS domain, 'T_' || p_size AS doc_type FROM part), a AS (SELECT doc_type, min(ord) AS n, anchor FROM (SELECT 'T_' || p_size AS doc_type, p_partkey AS ord, p_brand AS anchor FROM part) GROUP BY ALL)
SELECT domain, doc_type, replace(doc_type, '_', ' ') || coalesce((SELECT string_agg('|' || anchor, '' ORDER BY n) FROM a WHERE a.doc_type = ty.doc_type), '') AS anchors FROM ty"""
)
def type_specs(t: Tables) -> DataFrame:
    part = t("part").select(F.concat(F.lit("g"), F.col("p_size") % 5).alias("domain"), F.concat(F.lit("T_"), "p_size").alias("doc_type"), F.col("p_partkey").alias("n"), F.col("p_brand").alias("anchor"))
    types = part.select("domain", "doc_type", F.lit(None).cast("string").alias("name")).distinct()
    return SC.type_specs(part, types).withColumn("anchors", F.array_join("anchors", "|"))


@query("SELECT field, kind, ord, kind = 'bias' AS concept FROM bank WHERE ord <> 2", ("bank",))
def concept_vectors(t: Tables) -> DataFrame:
    bank = t.fixture("bank").withColumn("vec", F.when(F.col("ord") != 2, F.col("vec")))
    return SC.with_vectors(bank).select("field", "kind", "ord", "concept")


@query(
    """SELECT o_orderkey AS id, '{b:[' || o_orderstatus || ',x y],k' || o_custkey % 3 || ':[' || o_orderkey || ']}' AS shown, len(string_split('k' || o_custkey % 3, ' ')) + 2 AS n, o_orderstatus || '|x y|' || o_orderkey AS flat FROM orders"""
)
def nested_texts(t: Tables) -> DataFrame:
    o = t("orders")
    value = F.create_map(F.lit("b"), F.array("o_orderstatus", F.lit("x y")), F.concat(F.lit("k"), (F.col("o_custkey") % 3).cast("string")), F.array(F.col("o_orderkey").cast("string")))
    rows = o.select(F.col("o_orderkey").alias("id"), value.alias("value"))
    kind = rows.schema["value"].dataType
    flat = SC.flattened(F.col("value"), kind)
    return rows.select("id", SC.stringified(F.col("value"), kind).alias("shown"), F.size(flat).cast("bigint").alias("n"), F.array_join(flat, "|").alias("flat"))


ANCHORS = "SELECT 'f' || label AS format, 0 AS ord, embedding AS vec FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1"


def _anchors(t: Tables) -> DataFrame:
    return t.fixture("bank").where("ord = 1").select(F.col("field").alias("format"), "ord", "vec")


@query(
    f"""WITH a AS ({ANCHORS}), s AS (SELECT vec_id AS field, format, {COS.format("embedding", "vec")} AS s FROM embeddings, a),
r AS (SELECT *, lead(s) OVER w AS second, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY field ORDER BY s DESC, format)) SELECT field, format FROM r WHERE n = 1 AND s - second >= 0.015"""
)
def anchored_formats(t: Tables) -> DataFrame:
    return GT.anchored_format(t("embeddings").select(F.col("vec_id").alias("field"), F.col("embedding").alias("vec")), _anchors(t))


SAMPLES = "SELECT 'f_' || CAST(id % 40 AS VARCHAR) AS field, CASE id % 3 WHEN 0 THEN 'value' WHEN 1 THEN 'bias' ELSE 'examples' END AS key, id AS ord, v AS value FROM samples WHERE id % 40 > 3"
DETECTED = rf"""f AS (SELECT 'f_' || k AS field, CASE k % 6 WHEN 0 THEN 'Numeric' WHEN 2 THEN ' date ' WHEN 3 THEN 'odd' END AS format FROM range(40) r(k)),
t AS (SELECT field, key, ord, {TRIM.format("value")} AS v FROM ({SAMPLES})), p AS (SELECT *, {PROBE} AS fmt FROM t WHERE v <> ''),
n AS (SELECT field, key, count(*) AS n, avg(length(v)) AS chars FROM p GROUP BY ALL), c AS (SELECT field, key, fmt, count(*) AS c, min(ord) AS first FROM p WHERE fmt IS NOT NULL GROUP BY ALL),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY field, key ORDER BY c DESC, first) = 1),
i AS (SELECT n.field, n.key, CASE WHEN b.fmt IS NULL THEN CASE WHEN chars >= 40 THEN 'synthesis' END WHEN c * 2 >= n THEN b.fmt END AS fmt FROM n LEFT JOIN b USING (field, key)),
j AS (SELECT * FROM i WHERE fmt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field ORDER BY CASE key WHEN 'value' THEN 0 WHEN 'bias' THEN 1 ELSE 2 END) = 1),
det AS (SELECT f.field, coalesce(CASE WHEN lower(trim(f.format)) IN ({", ".join(f"'{x}'" for x in P.FORMATS)}) THEN lower(trim(f.format)) END, j.fmt, 'text') AS format FROM f LEFT JOIN j USING (field))"""


def _detected(t: Tables) -> DataFrame:
    k = F.col("id")
    fields = t.spark.range(40).select(F.concat(F.lit("f_"), k.cast("string")).alias("field"), F.when(k % 6 == 0, "Numeric").when(k % 6 == 2, " date ").when(k % 6 == 3, "odd").alias("format"))
    key = F.when(k % 3 == 0, "value").when(k % 3 == 1, "bias").otherwise("examples")
    samples = t.fixture("samples").where("id % 40 > 3").select(F.concat(F.lit("f_"), (k % 40).cast("string")).alias("field"), key.alias("key"), k.alias("ord"), F.col("v").alias("value"))
    return GT.detected_formats(fields, samples)


@query(f"WITH {DETECTED} SELECT * FROM det", ("samples",))
def detected_formats(t: Tables) -> DataFrame:
    return _detected(t)


@query(
    rf"""WITH {DETECTED}, g AS (SELECT c.*, coalesce(property, '') NOT IN ('', 'unclassified') AS named, format FROM chunks c LEFT JOIN det ON det.field = c.property),
v AS (SELECT *, {TRIM.format("CASE WHEN coalesce(value_part, '') <> '' THEN value_part ELSE text END")} AS v FROM g), num AS (SELECT *, len(regexp_extract_all(v, '\p{{Nd}}')) AS n FROM v),
m AS (SELECT *, CASE WHEN v = '' THEN false ELSE CASE format WHEN 'numeric' THEN regexp_matches(v, '\p{{Nd}}') WHEN 'date' THEN regexp_matches(v, {q(P.DATE_LITERAL)}) OR n >= 4 WHEN 'phone' THEN n >= 7
  WHEN 'link' THEN regexp_matches(v, {q(P.LINK)}) OR regexp_matches(v, {q(P.EMAIL)}) WHEN 'tracking_code' THEN regexp_matches(v, {q(P.TRACKING)}) OR n >= 6 WHEN 'identifier' THEN regexp_matches(v, {q(P.CODE_TOKEN)}) OR n >= 3
  WHEN 'synthesis' THEN length(v) >= 4 AND regexp_matches(v, '\p{{L}}') ELSE regexp_matches(v, '\p{{L}}') END END AS ok FROM num),
d AS (SELECT *, CASE WHEN NOT named THEN NULL WHEN confirmed THEN 'confirmed-bypass' WHEN ok THEN 'pass' ELSE 'reject' END AS verdict FROM m)
SELECT id, CASE WHEN verdict = 'reject' THEN 'unclassified' ELSE property END AS property, CASE WHEN verdict = 'reject' THEN 'format-rejected' ELSE status END AS status, CASE WHEN named THEN format END AS format, verdict FROM d""",
    ("samples", "chunks"),
)
def format_gate(t: Tables) -> DataFrame:
    return GT.format_gate(t.fixture("chunks"), _detected(t)).select("id", "property", "status", "format", "verdict")


@query(
    rf"""WITH s AS (SELECT *, regexp_replace({TRIM.format("text")}, '^[:： ]+|[:： ]+$', '', 'g') AS t FROM chunks), e AS (SELECT *, NOT confirmed AND {LABEL} {COMPACT.format("t")} IN ('invoicenumber', 'shipto') END AS echo FROM s)
SELECT id, CASE WHEN echo THEN 'unclassified' ELSE property END AS property, CASE WHEN echo THEN 'label-echo' ELSE status END AS status FROM e""",
    ("chunks",),
)
def label_echo(t: Tables) -> DataFrame:
    return GT.label_echo(t.fixture("chunks"), F.array(F.lit("invoicenumber"), F.lit("shipto"))).select("id", "property", "status")


@query(f"WITH b AS (SELECT * FROM bank WHERE kind = 'bias') SELECT e.vec_id AS doc, b.field AS code, round(max({COS.format('e.embedding', 'b.vec')}), 6) AS score FROM embeddings e, b GROUP BY ALL", ("bank",))
def text_axis(t: Tables) -> DataFrame:
    anchors = t.fixture("bank").where("kind = 'bias'").select(F.col("field").alias("code"), "ord", "vec")
    return GT.text_axis(t("embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec")), anchors).withColumn("score", F.round("score", 6))


@query(
    f"WITH p AS (SELECT b.field, max({COS.format('e.embedding', 'b.vec')}) AS peak FROM embeddings e, bank b WHERE b.ord = 4 GROUP BY 1) SELECT count(*) AS anchors, round(avg(peak), 6) AS mean, round(stddev_pop(peak), 6) AS spread, stddev_pop(peak) >= 0.01 AS tells_apart FROM p",
    ("bank",),
)
def joint_space(t: Tables) -> DataFrame:
    anchors = t.fixture("bank").where("ord = 4").select(F.col("field").alias("name"), "vec")
    out = GT.joint_space(t("embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec")), anchors)
    return out.select("anchors", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "tells_apart")


@query(
    f"""WITH s AS (SELECT e.vec_id AS idx, b.field, max(CASE WHEN ord = 1 THEN {COS.format('e.embedding', 'b.vec')} END) AS bias, max(CASE WHEN ord = 4 THEN {COS.format('e.embedding', 'b.vec')} END) AS prejudice FROM embeddings e, bank b WHERE ord IN (1, 4) GROUP BY ALL)
SELECT idx, field, round(bias, 6) AS bias, round(prejudice, 6) AS prejudice FROM s WHERE prejudice <= bias""",
    ("bank",),
)
def unprejudiced(t: Tables) -> DataFrame:
    out = GT.unprejudiced(t("embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec")), t.fixture("bank"))
    return out.select("idx", "field", F.round("bias", 6).alias("bias"), F.round("prejudice", 6).alias("prejudice"))


@query(
    r"""WITH a AS (SELECT d AS domain, 'f' || f AS field, l AS lang FROM (VALUES ('d0'), ('d1')) t(d), range(9) r(f), (VALUES (''), (' KOR'), ('en')) u(l)), nodes AS (SELECT * FROM (VALUES ('d0', 'n0', 0), ('d1', 'n2', 0), ('d1', 'n1', 1)) t(domain, node, k)),
al AS (SELECT * FROM (VALUES ('d0', 'f0', 'f3', 0), ('d0', 'f0', 'f4', 1), ('d1', 'f8', 'f1', 0)) t(domain, field, source, s)), lg AS (SELECT * FROM (VALUES ('', 'ko', 0), ('', 'en', 1), (' KOR', 'ko', 0), ('en', 'en', 0)) t(lang, own, l)),
m AS (SELECT a.domain, a.field, a.lang, l, k, coalesce(s, 0) AS s, own, node, coalesce(source, a.field) AS source FROM a JOIN nodes USING (domain) JOIN lg USING (lang) LEFT JOIN al ON al.domain = a.domain AND al.field = a.field),
p AS (SELECT lang AS own, node, source, CASE kind WHEN 'bias' THEN 0 WHEN 'semantic' THEN 1 ELSE 2 END AS turn, generate_subscripts(x, 1) AS p, trim(unnest(x)) AS phrase FROM (SELECT *, regexp_split_to_array(text, '[,;|\n]+') AS x FROM dictionary WHERE kind <> 'note')),
f AS (SELECT *, CASE WHEN turn = 2 THEN 'prejudice' ELSE 'bias' END AS side FROM m JOIN p USING (own, node, source) WHERE length(phrase) > 1 QUALIFY row_number() OVER (PARTITION BY domain, field, lang, side, lower(phrase) ORDER BY l, k, s, turn, p) = 1)
SELECT domain, field, lang, side, (row_number() OVER (PARTITION BY domain, field, lang, side ORDER BY l, k, s, turn, p) - 1)::INT AS n, phrase FROM f""",
    ("dictionary",),
)
def node_phrases(t: Tables) -> DataFrame:
    make = t.spark.createDataFrame
    asked = make([(d, f"f{f}", lang) for d in ("d0", "d1") for f in range(9) for lang in ("", " KOR", "en")], "domain string, field string, lang string")
    nodes = make([("d0", "n0", 0), ("d1", "n2", 0), ("d1", "n1", 1)], "domain string, node string, ord int")
    aliases = make([("d0", "f0", "f3", 0), ("d0", "f0", "f4", 1), ("d1", "f8", "f1", 0)], "domain string, field string, source string, ord int")
    return SC.node_phrases(asked, t.fixture("dictionary"), nodes, aliases)


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN ['a', o_orderpriority] WHEN 1 THEN ['-', 'it''s', o_orderstatus] WHEN 2 THEN [] ELSE ['[x]', '"'] END AS items FROM orders"""
)
def listed_characters(t: Tables) -> DataFrame:
    k, low = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    flow = F.concat(F.lit("a: 1\ncharacter_dict: ['a', "), low, F.lit(", ]\nb: 2"))
    block = F.concat(F.lit("p:\r\n  character_dict:\n\n    - '-'\n    - 'it''s'\n    - "), "o_orderstatus", F.lit("\n  - no\n    - no"))
    other = F.lit('character_dict :\n  - [x]\n  - "\\""\nnext: 1\n  - y')
    text = F.when(k == 0, flow).when(k == 1, block).when(k == 2, F.lit("characters:\n  - a")).otherwise(other)
    return t("orders").select(F.col("o_orderkey").alias("id"), SC.listed_characters(text).alias("items"))
