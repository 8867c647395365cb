"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, linededup, media, pieces, quality, simhash, urlfilter, warc


#: Verdict and pattern of the production rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), urlfilter.rule_table(spark, URL_RULES))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = pieces.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.length("text").alias("n_chars_decoded"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.with_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    read = media.read_media(stored)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return read.select(*names, F.concat_ws(":", F.concat_ws("x", "width", "height"), F.col("images").cast("string"), "thumb_hash").alias("feature"), "width", "height", "thumb_hash", "error")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.where("kind in ('response', 'revisit')").select(
        warc.page_of(F.col("record_id")).alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    return licenses.scan(docs, "doc_id", path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_sentencepiece, op3_media_columns, op4_line_dedup, op5_quality_classifier, op6_decontamination, op7_simhash_near_dedup, op8_warc, op9_language_id, op10_license_scans)}


_OP1 = """
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), rules(verdict, host, path) AS (VALUES {rules})
SELECT s.page_id, s.host, s.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM split s LEFT JOIN LATERAL (
  SELECT r.host || r.path AS rule, r.verdict FROM rules r
  WHERE (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  ORDER BY length(r.host || r.path) DESC, length(r.host) DESC LIMIT 1
) best ON true
""".format(rules=", ".join(f"('{v}', '{p.split('/', 1)[0]}', '/{p.split('/', 1)[1]}')" for v, p in URL_RULES))

_OP8 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_bytes >= 1000 AND f.payload_digest = p.payload_digest
"""

_WORDS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-/:-@\[-`{{-\x7f]+'), lambda w: w <> '')"
_OP10 = r"""
WITH files AS (
  SELECT doc_id, concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), coalesce(doc_id::VARCHAR, '_')) AS path, coalesce(text, '') AS text FROM documents
), templates(template, license, text) AS (VALUES {templates}),
tw AS (SELECT template, license, word, count(*) AS times FROM (SELECT template, license, unnest({words}) AS word FROM templates) GROUP BY ALL),
seen AS (SELECT DISTINCT path, word FROM (SELECT path, unnest({words}) AS word FROM files) WHERE word IN (SELECT word FROM tw)),
total AS (SELECT count(*)::DOUBLE AS n FROM files),
idf AS (SELECT v.word, ln((1 + (SELECT n FROM total)) / (1 + coalesce(c.n, 0))) + 1 AS idf
  FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN (SELECT word, count(*) AS n FROM seen GROUP BY 1) c USING (word)),
tn AS (SELECT template, sqrt(sum((times * idf) * (times * idf))) AS norm FROM tw JOIN idf USING (word) GROUP BY 1),
vec AS (SELECT template, license, word, times * idf / norm AS weight FROM tw JOIN idf USING (word) JOIN tn USING (template)),
parts AS (
  SELECT path, -1 AS seg, text FROM files WHERE regexp_matches(text, '(?i)licen|rights|permi|software|source|redistr|mozilla|commons|work|cc')
  UNION ALL
  SELECT path, seg, text FROM (SELECT path, generate_subscripts(l, 1) - 1 AS seg, unnest(l) AS text FROM (SELECT path, string_split(text, chr(10)) AS l FROM files))
  UNION ALL
  SELECT path, seg, text FROM (SELECT path, generate_subscripts(l, 1) - 1 + {paragraphs} AS seg, unnest(l) AS text FROM (SELECT path, regexp_split_to_array(text, '\n[ \t\r]*\n') AS l FROM files)) WHERE contains(text, chr(10))
),
tf AS (SELECT path, seg, word, count(*) AS times FROM (SELECT path, seg, unnest({words}) AS word FROM parts) GROUP BY ALL),
wx AS (SELECT path, seg, word, idf.idf IS NOT NULL AS known, times * coalesce(idf.idf, ln(1 + (SELECT n FROM total)) + 1) AS x FROM tf LEFT JOIN idf USING (word)),
norms AS (SELECT path, seg, sqrt(sum(x * x)) AS norm FROM wx GROUP BY ALL),
cosines AS (SELECT path, seg, license, round(sum(x * weight) / any_value(norm), 6) AS cosine FROM wx JOIN vec USING (word) JOIN norms USING (path, seg) GROUP BY path, seg, template, license),
best AS (SELECT path, seg, cosine, license FROM cosines WHERE cosine >= {least} QUALIFY row_number() OVER (PARTITION BY path, seg ORDER BY cosine DESC, license) = 1),
own AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, seg, license) = 1),
holders AS (SELECT regexp_extract(path, '^(.*)/', 1) AS dir, license FROM best WHERE seg < 0 QUALIFY row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY cosine DESC, path) = 1),
given AS (
  SELECT f.path, h.dir AS from_dir, h.license, len(string_split(regexp_extract(f.path, '^(.*)/', 1), '/')) - len(string_split(h.dir, '/')) AS distance
  FROM files f JOIN holders h ON starts_with(f.path, h.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(h.dir) DESC) = 1
)
SELECT f.doc_id, f.path, coalesce(o.license, g.license) AS license,
  CASE WHEN o.seg < 0 THEN 'file' WHEN o.seg >= 0 THEN 'header' WHEN g.license IS NOT NULL THEN 'inherited' END AS how, o.cosine,
  CASE WHEN o.license IS NULL THEN g.from_dir END AS from_dir, CASE WHEN o.license IS NULL THEN g.distance END::INT AS distance
FROM files f LEFT JOIN own o USING (path) LEFT JOIN given g USING (path)
""".format(
    words=_WORDS.format("text"), least=licenses.LEAST, paragraphs=licenses.PARAGRAPHS,
    templates=", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licenses.TEMPLATES)),
)

ORACLE_SQL: dict[str, str] = {"op1_url_filters": _OP1, "op8_warc": _OP8, "op10_license_scans": _OP10}
