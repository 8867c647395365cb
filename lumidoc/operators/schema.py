"""Schemas as rows: texts of fields by key and language, phrases for heat maps, anchors of document types, lookups.

Definitions are tables texts(field, ord, key, lang, text) and fields(field, ord, category, format, is_array, is_table, top_region).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Weights of heat-map phrases by key, in the order in which they are taken.
HEAT_WEIGHTS = {"semantic": 1.45, "label": 1.30, "bias": 0.85, "value": 0.70}
ANY_LANGUAGE = "*"
FIELD_ANCHORS = 12


def flattened(value: Column, kind: T.DataType) -> Column:
    """All texts in a nested value, in order; null has none. The expression follows the type, so nothing leaves the JVM."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: flattened(x, kind.elementType))), F.array().cast("array<string>"))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(value), lambda x: flattened(x, kind.valueType))), F.array().cast("array<string>"))
    if isinstance(kind, T.StructType):
        return F.coalesce(F.concat(*[flattened(value[f.name], f.dataType) for f in kind]), F.array().cast("array<string>"))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def stringified(value: Column, kind: T.DataType) -> Column:
    """A nested value as text: {key:value} with sorted keys, [value,value], scalars as they print; null is None."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: stringified(x, kind.elementType)), ","), F.lit("]")), F.lit("None"))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(k.cast("string"), F.lit(":"), stringified(F.element_at(value, k), kind.valueType)))
        return F.coalesce(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")), F.lit("None"))
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}:"), stringified(value[f.name], f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(value.isNull(), "None").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    if isinstance(kind, T.BooleanType):
        return F.when(value.isNull(), "None").when(value, "True").otherwise("False")
    return F.coalesce(value.cast("string"), F.lit("None"))


def picked(texts: DataFrame, lang: str = "", by: tuple[str, ...] = ("field", "key")) -> DataFrame:
    """texts in a language: where a key has it, that language's and then those for any; else all."""
    if not lang:
        return texts.withColumn("place", F.lit(0))
    has = F.max((F.col("lang") == lang).cast("int")).over(Window.partitionBy(*by))
    rows = texts.withColumn("has", has).where((F.col("has") == 0) | F.col("lang").isin(lang, ANY_LANGUAGE))
    return rows.withColumn("place", F.when((F.col("has") == 1) & (F.col("lang") == ANY_LANGUAGE), 1).otherwise(0)).drop("has")


def _firsts(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group and lower-cased phrase, by an order of the columns."""
    rest = [c for c in rows.columns if c not in group]
    one = rows.groupBy(*group, F.lower("phrase").alias("low")).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r"))
    return one.select(*group, *[F.col(f"r.{c}").alias(c) for c in rest])


def heat_phrases(texts: DataFrame, lang: str = "") -> DataFrame:
    """(field, phrase, weight, ord): the phrases of a field for its heat map, each once under its first key; ord from 1."""
    keys = F.create_map(*[F.lit(x) for k, (name, _) in enumerate(HEAT_WEIGHTS.items()) for x in (name, k)])
    weights = F.create_map(*[F.lit(x) for pair in HEAT_WEIGHTS.items() for x in pair])
    rows = picked(texts.where(F.col("key").isin(list(HEAT_WEIGHTS))), lang)
    rows = rows.select("field", keys[F.col("key")].alias("k"), "place", "ord", F.btrim("text").alias("phrase"), weights[F.col("key")].alias("weight"))
    one = _firsts(rows.where((F.col("phrase") != "") & ~X.is_junk_phrase("phrase")), ["field"], ["k", "place", "ord"])
    # a field has a few dozen phrases
    return one.select("field", "phrase", "weight", F.row_number().over(Window.partitionBy("field").orderBy("k", "place", "ord")).alias("ord"))


def field_anchors(texts: DataFrame, lang: str = "", most: int = FIELD_ANCHORS, doc: str = "doc_type") -> DataFrame:
    """(doc, n, anchor) of texts(doc, field, ord, key, lang, text): one text of each field, distinct, the first `most` in order of fields.

    A field gives its first usable semantic text, else its first label, else its own name.
    """
    first = texts.groupBy(doc, "field").agg(F.min("ord").alias("at"))
    usable = picked(texts.where(F.col("key").isin("semantic", "label")), lang, (doc, "field", "key")).withColumn("t", F.btrim("text")).where((F.col("t") != "") & ~X.is_junk_phrase("t"))
    own = usable.groupBy(doc, "field").agg(F.min(F.struct((F.col("key") != "semantic").alias("k"), "place", "ord", "t")).alias("u"))
    rows = first.join(own, [doc, "field"], "left").select(doc, "at", F.coalesce("u.t", F.btrim(F.replace("field", F.lit("_"), F.lit(" ")))).alias("phrase")).where("phrase <> ''")
    one = _firsts(rows, [doc], ["at"])
    return one.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy("at"))).where(F.col("n") <= most).select(doc, "n", F.col("phrase").alias("anchor"))


def doc_anchors(descriptions: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_type, n, anchor) for every row of types(doc_type): the distinct anchors of its descriptions(doc_type, ord, description), else a sentence."""
    rows = descriptions.select("doc_type", "ord", X.desc_anchor("description").alias("phrase")).where("phrase <> ''")
    one = _firsts(rows, ["doc_type"], ["ord"]).withColumn("n", F.row_number().over(Window.partitionBy("doc_type").orderBy("ord"))).select("doc_type", "n", F.col("phrase").alias("anchor"))
    sentence = F.concat(F.lit("a "), F.replace("doc_type", F.lit("_"), F.lit(" ")), F.lit(" trade document"))
    return types.select("doc_type").distinct().join(one, "doc_type", "left").select("doc_type", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("anchor", sentence).alias("anchor"))


def bridge_phrases(valued: DataFrame, abstract: DataFrame, node: str) -> DataFrame:
    """(field, n, phrase): phrases of valued(target, key, ord, phrase) under `node.field`, then those of abstract whose target ends with the field."""
    a = valued.where(F.startswith("target", F.lit(f"{node}."))).select(F.substr("target", F.lit(len(node) + 2)).alias("field"), F.lit(0).alias("part"), "key", "ord", "phrase")
    b = abstract.select(F.substring_index("target", ".", -1).alias("field"), F.lit(1).alias("part"), "key", "ord", "phrase")
    rows = a.unionByName(b).withColumn("k", F.when(F.col("key") == "semantic", 0).otherwise(1))
    one = _firsts(rows.drop("key"), ["field"], ["part", "ord", "k"])
    return one.select("field", F.row_number().over(Window.partitionBy("field").orderBy("part", "ord", "k")).alias("n"), "phrase")


def doc_codes(overlay: DataFrame) -> DataFrame:
    """(n, doc_type): the codes of an overlay in order."""
    return overlay.select("doc_type").distinct().withColumn("n", F.row_number().over(Window.orderBy("doc_type"))).select("n", "doc_type")


def bank_stats(bank: DataFrame) -> DataFrame:
    """(field, *kinds, total) of bank(field, kind): how many phrases a field has of each kind."""
    kinds = ["semantic", "label", "bias", "value", "prejudice"]
    return bank.groupBy("field").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count("*").alias("total"))


def with_vectors(bank: DataFrame) -> DataFrame:
    """The phrases of bank(kind, vec) that have a vector, with `concept`: whether they say what a field means."""
    return bank.where(F.size(F.coalesce("vec", F.array().cast("array<float>"))) > 0).withColumn("concept", F.col("kind").isin("semantic", "bias"))


def legacy_phrases(texts: DataFrame) -> DataFrame:
    """(field, bias, prejudice): the older bank, a field's semantic text and bias phrases, and its prejudice phrases, as arrays."""
    kept = lambda keys: F.transform(F.filter("all", lambda x: x["key"].isin(keys)), lambda x: x["text"])
    order = F.struct((F.col("key") != "semantic").alias("k"), "ord", "key", "text")
    rows = texts.where("text <> ''").groupBy("field").agg(F.array_sort(F.collect_list(order)).alias("all"))
    return rows.select("field", kept(["semantic", "bias"]).alias("bias"), kept(["prejudice"]).alias("prejudice"))


def field_lookups(fields: DataFrame) -> DataFrame:
    """(field, category, format, is_array, array_category) of fields: what later steps look up."""
    category = F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).otherwise("misc")
    many = F.coalesce("is_array", F.lit(False)) | F.coalesce("is_table", F.lit(False))
    rows = fields.select("field", category.alias("category"), F.nullif(F.lower(F.btrim("format")), F.lit("")).alias("format"), many.alias("is_array"))
    return rows.join(rows.groupBy("category").agg(F.bool_or("is_array").alias("array_category")), "category").select("field", "category", "format", "is_array", "array_category")


def identity_categories(fields: DataFrame, names: list[str], default: str = "misc") -> DataFrame:
    """(category) of the fields that name the document or stand in the top region."""
    held = F.coalesce("top_region", F.lit(False)) | F.col("field").isin(names)
    return fields.where(held).select(F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).otherwise(default).alias("category")).distinct()


def type_specs(anchors: DataFrame, types: DataFrame) -> DataFrame:
    """(domain, doc_type, anchors): groups of types(domain, doc_type, name), each code with its name and then anchors(doc_type, n, anchor)."""
    listed = anchors.groupBy("doc_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "anchor"))), lambda x: x["anchor"]).alias("more"))
    name = F.array(F.replace(F.coalesce("name", "doc_type"), F.lit("_"), F.lit(" ")))
    rows = types.join(listed, "doc_type", "left")
    return rows.select("domain", "doc_type", F.array_distinct(F.concat(name, F.coalesce("more", F.array().cast("array<string>")))).alias("anchors"))


def listed_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """(name, kind) of the JSON files of a folder, in order of names: files with fields are schemas; only where there
    are none, every code of a dictionary's overlay is one, as file#code."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    fields = F.from_json(F.get_json_object("value", "$.fields"), "map<string,string>")
    codes = F.from_json(F.get_json_object("value", "$.trade_schema.overlay"), "map<string,string>")
    rows = files.select("file", fields.alias("fields"), codes.alias("codes"))
    plain = rows.where(F.size("fields") > 0).select(F.col("file").alias("name"), F.lit("schema").alias("kind"))
    virtual = rows.select("file", F.explode(F.map_keys("codes")).alias("code")).select(F.concat("file", F.lit("#"), "code").alias("name"), F.lit("virtual").alias("kind"))
    return (virtual if plain.isEmpty() else plain).orderBy("name")


def listed_phrases(text: Column) -> Column:
    """The phrases of a text parted by commas, semicolons, bars and line ends, each once in any case; single ASCII letters go."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;|\\n]+"), lambda x: F.regexp_replace(x, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")), lambda x: ~x.rlike(r"^\p{ASCII}?$"))
    return F.filter(parts, lambda x, k: F.array_position(F.transform(parts, F.lower), F.lower(x)) == k + 1)


def node_phrases(asked: DataFrame, entries: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(domain, field, lang, side, n, phrase): what a dictionary's entries(lang, node, source, kind, text) say for asked(domain, field, lang).

    A domain has nodes(domain, node, ord); a field goes by the sources of its aliases(domain, field, source, ord), else by
    its own name. `kor`, `ko`, `eng` and `en` ask for one language, anything else for both, Korean first. Bias and
    semantic texts are one side, prejudice the other; each phrase stays once in any case, where it comes first.
    """
    code = F.lower(F.btrim(F.coalesce("lang", F.lit(""))))
    langs = F.when(code.isin("kor", "ko"), F.array(F.lit("ko"))).when(code.isin("eng", "en"), F.array(F.lit("en"))).otherwise(F.array(F.lit("ko"), F.lit("en")))
    rows = asked.select("domain", "field", "lang", F.posexplode(langs).alias("l", "own")).join(nodes.select("domain", "node", F.col("ord").alias("k")), "domain")
    named = aliases.select("domain", "field", "source", F.col("ord").alias("s"))
    rows = rows.join(named, ["domain", "field"], "left").withColumns({"source": F.coalesce("source", "field"), "s": F.coalesce("s", F.lit(0))})
    turn = F.when(F.col("kind") == "bias", 0).when(F.col("kind") == "semantic", 1).when(F.col("kind") == "prejudice", 2)
    said = entries.withColumn("turn", turn).where("turn is not null").select(F.col("lang").alias("own"), "node", "source", "turn", F.posexplode(listed_phrases(F.col("text"))).alias("p", "phrase"))
    side = F.when(F.col("turn") == 2, "prejudice").otherwise("bias")
    met = rows.join(said, ["own", "node", "source"]).withColumns({"side": side, "low": F.lower("phrase")})
    ask = ["domain", "field", "lang", "side"]
    first = met.groupBy(*ask, "low").agg(F.min(F.struct("l", "k", "s", "turn", "p", "phrase")).alias("at"))
    # a field has a few dozen phrases
    return first.select(*ask, (F.row_number().over(Window.partitionBy(*ask).orderBy("at")) - 1).alias("n"), F.col("at.phrase").alias("phrase"))


def listed_characters(text: Column) -> Column:
    """The items of the list `character_dict` in a YAML text: those of a list in brackets, or the indented lines with a dash up to the first other one."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r]")
    key = r"^(\s*)character_dict\s*:\s*(.*)$"

    def unquoted(x: Column) -> Column:
        t = F.regexp_replace(x, r"^\s+|\s+$", "")
        body = F.substring(t, F.lit(2), F.length(t) - 2)
        read = F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(0))
        long = F.length(t) > 1
        return F.when(long & t.rlike("^'.*'$"), F.replace(body, F.lit("''"), F.lit("'"))).when(long & t.rlike('^".*"$'), F.when(F.contains(body, F.lit("\\")), F.coalesce(read, body)).otherwise(body)).otherwise(t)

    def told(at: Column) -> Column:
        head = F.get(at, F.lit(0))
        inline, indent = F.btrim(F.regexp_extract(head, key, 2)), F.length(F.regexp_extract(head, key, 1))
        below = F.filter(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda x: ~x.rlike(r"^\s*$"))
        item = lambda x: x.rlike(r"^\s*-") & (F.length(F.regexp_extract(x, r"^(\s*)", 1)) > indent)
        end = F.array_position(F.transform(below, item), False).cast("int")
        block = F.transform(F.when(end > 0, F.slice(below, 1, F.greatest(end - 1, F.lit(0)))).otherwise(below), lambda x: F.regexp_extract(x, r"^\s*-\s?(.*)$", 1))
        flat = F.filter(F.split(F.regexp_replace(inline, r"^[\[\]]+|[\[\]]+$", ""), ","), lambda x: ~x.rlike(r"^\s*$"))
        return F.transform(F.when(inline.startswith("["), flat).otherwise(block), unquoted)

    at = F.array_position(F.transform(lines, lambda x: x.rlike(key)), True).cast("int")
    return F.when(at > 0, told(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)))).otherwise(F.array().cast("array<string>"))
