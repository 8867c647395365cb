"""Relations derived from the input tables by arithmetic that Spark SQL and DuckDB share: (SQL, tables it reads)."""

FIXTURES: dict[str, tuple[str, tuple[str, ...]]] = {
    # values of many shapes
    "samples": (
        """
SELECT o_orderkey AS id, CASE o_orderkey % 18
  WHEN 0 THEN 'INV-' || lpad(CAST(o_orderkey AS STRING), 6, '0')
  WHEN 1 THEN CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) || '.50'
  WHEN 2 THEN substr(CAST(o_orderdate AS STRING), 1, 10)
  WHEN 3 THEN '+82 10-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')
  WHEN 4 THEN 'https://example.com/o/' || CAST(o_orderkey AS STRING)
  WHEN 5 THEN 'user' || CAST(o_custkey AS STRING) || '@example.org'
  WHEN 6 THEN 'ZZ' || lpad(CAST(o_orderkey AS STRING), 9, '0')
  WHEN 7 THEN o_orderpriority
  WHEN 8 THEN 'N/A'
  WHEN 9 THEN 'SHIP TO'
  WHEN 10 THEN 'Invoice Number: INV-' || CAST(o_orderkey AS STRING)
  WHEN 11 THEN 'a'
  WHEN 12 THEN ' '
  WHEN 13 THEN 'aB3'
  WHEN 14 THEN '12 March 20' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')
  WHEN 15 THEN '{{String}} ' || o_orderpriority
  WHEN 16 THEN '--- *** ' || CAST(o_orderkey % 7 AS STRING)
  ELSE 'The shipment number ' || CAST(o_orderkey AS STRING) || ' was delivered to the final address without delay' END AS v
FROM {orders}""",
        ("orders",),
    ),
    # label and value lines
    "kv_text": (
        """
SELECT o_orderkey AS id, 'Invoice Number: INV-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || chr(10)
  || 'ORDER STATUS' || chr(10) || 'status ' || o_orderstatus || ' for client ' || CAST(o_custkey AS STRING) || chr(10)
  || CASE WHEN o_orderkey % 3 = 0 THEN 'SHIP TO' || chr(10) || 'PORT OF LOADING' || chr(10) || 'Busan 7' ELSE 'Remarks: none at all 12' END || chr(10)
  || 'Tax Number: VAT-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') AS text
FROM {orders}""",
        ("orders",),
    ),
    # vectors as image patches on a grid
    "patches": ("SELECT vec_id AS idx, CAST(floor(vec_id / 25) AS BIGINT) AS r, vec_id % 25 AS c, embedding AS vec, label FROM {embeddings}", ("embeddings",)),
    # phrases of ten fields: the first three vectors of a label for it, the next two against it
    "bank": (
        """
SELECT 'f' || CAST(label AS STRING) AS field, CASE WHEN rn <= 3 THEN 'bias' ELSE 'prejudice' END AS kind, CAST(rn AS INT) AS ord,
  CAST(CASE WHEN rn = 1 THEN 1.1 WHEN rn = 2 THEN 1.0 WHEN rn = 3 THEN 0.7 WHEN rn = 4 THEN 1.0 ELSE 0.85 END AS DOUBLE) AS weight, vec
FROM (SELECT label, embedding AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM {embeddings}) t WHERE rn <= 5""",
        ("embeddings",),
    ),
    # boxes with scores, by page
    "boxes": (
        """
SELECT l_orderkey AS page, CAST(l_linenumber * 1000000 + l_partkey % 1000000 AS INT) AS seq, 'f' || CAST(l_partkey % 5 AS STRING) AS field, CAST(l_partkey % 60 AS INT) AS x0, CAST(l_suppkey % 40 AS INT) AS y0,
  CAST(l_partkey % 60 + 10 + l_quantity AS INT) AS x1, CAST(l_suppkey % 40 + 8 + l_linenumber * 4 AS INT) AS y1, round(l_discount * 100 + l_tax * 10, 4) AS score, CAST(l_partkey % 3 AS INT) AS region
FROM {lineitem}""",
        ("lineitem",),
    ),
    # word spans with scores, by document
    "spans": (
        """
SELECT l_orderkey AS doc, CAST(l_linenumber * 1000000 + l_partkey % 1000000 AS INT) AS seq, CAST(l_partkey % 40 AS INT) AS s, CAST(l_partkey % 40 + 1 + l_linenumber % 6 AS INT) AS e,
  'f' || CAST(l_suppkey % 4 AS STRING) AS field, round(l_discount * 10 + l_tax, 4) AS score, l_returnflag = 'R' AS confirmed
FROM {lineitem}""",
        ("lineitem",),
    ),
    # readings of lines, by page
    "votes": (
        """
SELECT l_orderkey AS page, CAST(l_linenumber % 3 AS INT) AS line, CAST(l_linenumber * 1000000 + l_partkey % 1000000 AS INT) AS seq, CASE WHEN l_partkey % 4 = 0 THEN 'total amount due' WHEN l_partkey % 4 = 1 THEN 'total amount duo' WHEN l_partkey % 4 = 2 THEN 'Total  amount due' ELSE 'tota1 amount' END AS text,
  CASE WHEN l_suppkey % 2 = 0 THEN 'ocr' ELSE 'reader' END AS source, round(1 - l_discount * 5, 4) AS conf
FROM {lineitem}""",
        ("lineitem",),
    ),
    # a keyed vector log: everything is written, the even ones are written again, every seventh is deleted
    "vlog": (
        """
SELECT 'r' || CAST(vec_id AS STRING) AS rid, vec_id AS seq, true AS live, embedding AS vec, label FROM {embeddings}
UNION ALL SELECT 'r' || CAST(vec_id AS STRING), vec_id + 100000, true, embedding, label + 100 FROM {embeddings} WHERE vec_id % 2 = 0
UNION ALL SELECT 'r' || CAST(vec_id AS STRING), vec_id + 200000, false, embedding, label FROM {embeddings} WHERE vec_id % 7 = 0""",
        ("embeddings",),
    ),
    # rows read by OCR with boxes, by page
    "ocr_rows": (
        """
SELECT l_orderkey AS page, CAST(l_linenumber * 1000000 + l_partkey % 1000000 AS INT) AS seq, CASE WHEN l_linenumber % 2 = 1 THEN 'LABEL ' || substr('ABCDEFGH', CAST(l_linenumber AS INT), 1) ELSE 'value ' || CAST(l_partkey AS STRING) END AS text, round(1 - l_discount, 4) AS conf,
  CAST(10 + (l_suppkey % 3) * 60 AS INT) AS x0, CAST(l_linenumber * 12 + l_partkey % 5 AS INT) AS y0, CAST(60 + (l_suppkey % 3) * 60 AS INT) AS x1, CAST(l_linenumber * 12 + l_partkey % 5 + 10 AS INT) AS y1
FROM {lineitem}""",
        ("lineitem",),
    ),
    # scalar fields of records
    "record_fields": (
        """
SELECT o_orderkey AS doc, 'header' AS category, 'doc_number' AS field, 'INV-' || lpad(CAST(o_orderkey AS STRING), 6, '0') AS value FROM {orders}
UNION ALL SELECT o_orderkey, 'header', 'status', o_orderstatus FROM {orders}
UNION ALL SELECT o_orderkey, 'parties', 'recipient_name', 'Customer ' || CAST(o_custkey AS STRING) FROM {orders} WHERE o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, 'logistics', 'reference_bl', 'BL-' || CAST(o_custkey AS STRING) FROM {orders} WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'conditions', 'priority', o_orderpriority FROM {orders}""",
        ("orders",),
    ),
    # texts of schema fields by key and language
    "schema_texts": (
        """
SELECT 'd' || CAST(o_custkey % 4 AS STRING) AS doc_type, 'f_' || CAST(o_custkey % 40 AS STRING) AS field, o_orderkey AS ord,
  CASE o_orderkey % 5 WHEN 0 THEN 'semantic' WHEN 1 THEN 'label' WHEN 2 THEN 'bias' WHEN 3 THEN 'value' ELSE 'prejudice' END AS key,
  CASE o_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ko' ELSE '*' END AS lang,
  CASE WHEN o_orderkey % 17 = 0 THEN '-' WHEN o_orderkey % 19 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) || ' ' || CAST(o_orderkey % 13 AS STRING) ELSE ' ' || o_orderpriority || ' ' || CAST(o_orderkey % 13 AS STRING) END AS text
FROM {orders}""",
        ("orders",),
    ),
    # schema fields
    "schema_fields": (
        """
SELECT 'f_' || CAST(c_custkey AS STRING) AS field, c_custkey AS ord, CASE WHEN c_nationkey = 3 THEN '' ELSE 'c' || CAST(c_nationkey AS STRING) END AS category,
  CASE c_custkey % 6 WHEN 0 THEN 'Numeric' WHEN 1 THEN '' WHEN 2 THEN ' date ' WHEN 3 THEN 'odd' ELSE NULL END AS format,
  c_custkey % 97 = 0 AS is_array, c_custkey % 89 = 0 AS is_table, c_custkey % 83 = 0 AS top_region
FROM {customer}""",
        ("customer",),
    ),
    # chunks with a field each
    "chunks": (
        """
SELECT id, v AS text, CASE WHEN id % 5 = 0 THEN 'unclassified' WHEN id % 7 = 0 THEN NULL ELSE 'f_' || CAST(id % 40 AS STRING) END AS property,
  CASE WHEN id % 4 = 0 THEN substr(v, 3) WHEN id % 4 = 1 THEN '' ELSE NULL END AS value_part, id % 9 = 0 AS confirmed, 'alive' AS status
FROM {samples}""",
        ("samples",),
    ),
    # values with digits and blanks of other scripts
    "wide_samples": (
        """
SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN '٣٤٥' WHEN 1 THEN '1 234,50' WHEN 2 THEN '０１０　１２３４５６７' WHEN 3 THEN '２０２４-０１-０２' WHEN 4 THEN '3 March 2021'
  WHEN 5 THEN 'AB ٣٤٥' WHEN 6 THEN '١٬٢٣٤٫٥' WHEN 7 THEN ' 　' WHEN 8 THEN 'x /path' ELSE 'nothing here' END AS v
FROM {part}""",
        ("part",),
    ),
    # a dictionary of phrases by language, node, source and kind
    "dictionary": (
        """
SELECT CASE o_custkey % 2 WHEN 0 THEN 'ko' ELSE 'en' END AS lang, 'n' || CAST(o_custkey % 3 AS STRING) AS node, 'f' || CAST(o_custkey % 7 AS STRING) AS source, CASE o_custkey % 5 WHEN 0 THEN 'bias' WHEN 1 THEN 'semantic' WHEN 2 THEN 'prejudice' WHEN 3 THEN 'bias' ELSE 'note' END AS kind,
  max(o_orderpriority || ', ' || lower(o_orderpriority) || '; x | ' || CAST(o_custkey % 11 AS STRING) || ' |p ' || CAST(o_custkey % 13 AS STRING)) AS text
FROM {orders} GROUP BY 1, 2, 3, 4""",
        ("orders",),
    ),
}
