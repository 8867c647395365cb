"""Records from fields: envelopes, digests, addresses and relay edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def hashed(prefix: str, payload: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha1(F.concat(F.lit(prefix), F.lit("\x1f"), payload)))


def address(kind: str, value: Column) -> Column:
    """The address of an identifier; empty ones share the zero address."""
    n = X.normalize_identifier(value)
    return F.when(n == "", P.ZERO_ADDRESS).otherwise(hashed(kind, n))


def relay_index(key: Column) -> Column:
    n = X.normalize_homoglyphs(key)
    return F.when(n == "", F.lit(0).cast("bigint")).otherwise(F.crc32(n.cast("binary")))


def digest(fields: Column) -> Column:
    """Of a map: its non-empty entries in key order as `k=v`, joined by bars, blanks squeezed, lower-cased, hashed."""
    kept = F.filter(F.array_sort(F.map_entries(fields)), lambda e: e["value"].isNotNull() & (e["value"] != "") & ~F.startswith(e["key"], F.lit("__")))
    body = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return hashed("digest", F.lower(X.trimmed(F.regexp_replace(body, r"\s+", " "))))


def grouped(fields: DataFrame, doc: str) -> DataFrame:
    """(doc, fields MAP, identity, fallback) of fields(doc, category, field, value): one row for each document."""
    rows = fields.where("value is not null and value <> ''").groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    wanted = [F.when(X.plausible_identity(F.try_element_at("fields", F.lit(k))), F.trim(F.try_element_at("fields", F.lit(k)))) for k in ("doc_number", "no", "reference_number")]
    found = F.coalesce(*wanted)
    task = F.concat(F.lit("task_"), F.lpad(F.crc32(X.normalize_identifier(F.col(doc).cast("string")).cast("binary")).cast("string"), 10, "0"))
    return rows.select(doc, "fields", F.coalesce(found, task).alias("identity"), found.isNull().alias("fallback"))


def envelope(records: DataFrame, doc: str, doc_type: str, mode: str = "shipping", lang: str = "") -> DataFrame:
    """records with digest, id, cc, ref, bcc, to and index."""
    whole = F.map_concat("fields", F.create_map(F.lit("~doc_type"), F.lit(doc_type), F.lit("~identity"), F.col("identity"), F.lit("~lang"), F.lit(lang)))
    rows = records.withColumn("digest", digest(whole))
    host = "trading"
    return rows.withColumns({
        "id": hashed("id", F.col("digest")), "cc": address("cc", F.concat(F.lit(f"{host}/{doc_type}/"), "identity")), "ref": address("ref", F.concat(F.lit(f"{host}/"), "identity")),
        "bcc": address("bcc", F.concat(F.lit(f"{mode}/{doc_type}/"), "digest")), "to": address("to", F.coalesce(F.try_element_at("fields", F.lit("recipient_name")), F.col("identity"))), "index": relay_index(F.col("identity")),
    })


def relay_edges(records: DataFrame, doc: str, doc_type: str) -> DataFrame:
    """(doc, target, role, key, value): a transport edge for a bill of lading, and one to every other form; none from a makeshift identity."""
    bl = F.trim(F.coalesce(F.try_element_at("fields", F.lit("reference_bl")), F.lit("")))
    transport = F.when(bl != "", F.array(F.struct(F.lit("BL").alias("target"), F.lit("transport").alias("role"), F.lit("doc_number").alias("key"), bl.alias("value"))))
    others = [F.struct(F.lit(x).alias("target"), F.lit("reference_invoice").alias("role"), F.lit("reference_invoice").alias("key"), F.col("identity").alias("value")) for x in P.RELAY_TARGETS if x != doc_type]
    invoices = F.when(~F.startswith("identity", F.lit("task_")), F.array(*others))
    none = F.array().cast("array<struct<target:string,role:string,key:string,value:string>>")
    edges = records.where("not fallback").select(doc, F.explode(F.concat(F.coalesce(transport, none), F.coalesce(invoices, none))).alias("e"))
    return edges.select(doc, "e.target", "e.role", "e.key", "e.value")


def sentences(fields: DataFrame, doc: str) -> DataFrame:
    """(doc, text): one sentence for every field, category by category, in alphabetical order."""
    def human(c: str) -> Column:
        return F.trim(F.replace(F.col(c), F.lit("_"), F.lit(" ")))

    lines = fields.where("value is not null and value <> ''").select(doc, "category", "field", F.concat(F.lit("Its "), human("field"), F.lit(" is "), "value", F.lit(".")).alias("line"))
    cats = lines.groupBy(doc, "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "line"))), lambda x: x["line"]), " ").alias("body"))
    cats = cats.withColumn("part", F.concat(F.lit("Regarding "), human("category"), F.lit(", "), "body"))
    return cats.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "part"))), lambda x: x["part"]), " ").alias("text"))
