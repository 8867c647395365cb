"""Column functions over text values: formats, labels, cleaning, identifiers, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(v: Text) -> Column:
    """Without white space around it; null counts as empty."""
    return F.regexp_replace(F.coalesce(_c(v), F.lit("")), rf"^[{P.BLANKS}]+|[{P.BLANKS}]+$", "")


def stripped(v: Column) -> Column:
    """As trimmed, of a text that isn't null, by a search for each end's characters instead of a pattern."""
    return F.btrim(v, F.lit(P.BLANK_CHARS))


def digit_count(v: Text) -> Column:
    return F.regexp_count(_c(v), F.lit(r"\p{Nd}"))


def has_date_literal(v: Text) -> Column:
    return _c(v).rlike(P.DATE_LITERAL)


def value_matches_format(v: Text, fmt: Text) -> Column:
    """Whether a value can be of a format; an empty one never is, and an unknown format takes anything."""
    v, fmt = trimmed(v), _c(fmt)
    n = digit_count(v)
    tests = {
        "numeric": v.rlike(P.NUMERIC), "date": has_date_literal(v) | (n >= 4), "phone": n >= 7, "link": v.rlike(P.LINK) | v.rlike(P.EMAIL),
        "tracking_code": v.rlike(P.TRACKING) | (n >= 6), "identifier": v.rlike(P.CODE_TOKEN) | (n >= 3), "address": F.length(v) >= 4,
        "enum": F.length(v) >= 1, "synthesis": (F.length(v) >= 4) & v.rlike(r"\p{L}"), "text": v.rlike(r"\p{L}"),
    }
    out = F.when(v == "", F.lit(False))
    for name, test in tests.items():
        out = out.when(fmt == name, test)
    return out.otherwise(F.lit(True))


def format_probe(v: Text) -> Column:
    """The first format whose shape a value has; null if none."""
    v = trimmed(v)
    return (
        F.when(v.rlike(P.LINK) | v.rlike(P.EMAIL), "link").when(v.rlike(P.DATE_LITERAL), "date").when(v.rlike(P.PHONE), "phone")
        .when(v.rlike(P.TRACKING), "tracking_code").when(v.rlike(P.CODE_TOKEN), "identifier").when(v.rlike(P.PURE_NUMERIC), "numeric")
    )


def compact(v: Text) -> Column:
    """Lower case, letters and numbers only."""
    return F.regexp_replace(F.lower(F.coalesce(_c(v), F.lit(""))), r"[^\p{L}\p{N}]", "")


def is_printed_label(v: Text, bank: Column | None = None) -> Column:
    """Whether a text is a label without a value; bank is an array of compact labels."""
    return bare_is_label(F.regexp_replace(trimmed(v), r"^[:： ]+|[:： ]+$", ""), bank)


def bare_is_label(t: Column, bank: Column | None = None) -> Column:
    """is_printed_label of a text that has no white space, colons and blanks around it."""
    named = F.array_contains(bank, compact(t)) & (compact(t) != "") if bank is not None else F.lit(False)
    few = F.regexp_count(t, F.lit(r"\S+")) <= P.MAX_LABEL_WORDS
    return F.when(t == "", True).otherwise(((t.rlike(P.UPPER_LABEL) & ~t.rlike("[0-9]")) | named) & few)


def value_plausible(v: Text) -> Column:
    v = trimmed(v)
    solid = F.length(F.regexp_replace(v, r"\s", ""))
    ratio = F.regexp_count(v, F.lit(r"[\p{L}\p{N}]")) / F.greatest(solid, F.lit(1))
    odd = (F.length(v) <= 4) & v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
    return (v != "") & (F.length(v) <= 120) & ((F.length(v) >= 2) | v.rlike("^[0-9]$")) & (ratio >= 0.55) & ~odd


def format_penalty(fmt: Text, v: Text) -> Column:
    pure = trimmed(v).rlike(P.PURE_NUMERIC)
    return F.when((_c(fmt) == "numeric") & ~trimmed(v).rlike("[0-9]"), 0.72).when((_c(fmt) != "numeric") & pure, 0.72).otherwise(1.0)


def label_cosine_floor(label: Text) -> Column:
    """0.80 up to 3 compact characters, falling evenly to 0.42 at 9."""
    n = F.length(compact(label))
    return F.when(n <= 3, 0.80).when(n >= 9, 0.42).otherwise(0.80 - (0.80 - 0.42) * (n - 3) / 6.0)


def looks_garbled(v: Text) -> Column:
    v = trimmed(v)
    solid = F.greatest(F.length(F.regexp_replace(v, r"\s", "")), F.lit(1))
    singles = F.size(F.filter(F.split(v, r"\s+"), lambda w: F.length(w) == 1))
    mixed = (F.regexp_count(v, F.lit(r"\p{L}")) >= 4) & v.rlike(r"\p{Lu}") & v.rlike(r"\p{Ll}") & (singles >= 2)
    return (F.length(v) >= 3) & ((F.regexp_count(v, F.lit(r"[\p{L}\p{N}]")) / solid < 0.45) | mixed)


def is_junk_phrase(p: Text) -> Column:
    n = F.regexp_count(_c(p), F.lit(r"[\p{L}\p{N}]"))
    return (n == 0) | ((n == 1) & ~_c(p).rlike(r"[^\x00-\x7F]"))


def claimable(v: Text) -> Column:
    c = compact(v)
    return (F.length(trimmed(v)) >= 3) & (c != "") & ~c.rlike(r"^[0-9]{1,4}$")


def plausible_identity(v: Text) -> Column:
    s = trimmed(v)
    return (s != "") & (F.length(s) <= 40) & ~s.rlike(r"[\r\n]") & (F.size(F.split(s, r"\s+")) <= 3) & s.rlike("[0-9]")


def sanitize(text: Text, max_chars: int = P.SANITIZED_CHARS) -> Column:
    """Cleaned text (without NFKC, for which see normal_form): no invisible characters, short runs, no blank lines."""
    s = F.regexp_replace(F.coalesce(_c(text), F.lit("")), P.INVISIBLE, "")
    s = F.regexp_replace(s, P.CONTROL, " ")
    s = F.regexp_replace(F.regexp_replace(s, "\r\n", "\n"), "\r", "\n")
    s = F.regexp_replace(s, r"(.)\1{4,}", "$1$1$1")
    s = F.regexp_replace(s, r"[ \t\x{00A0}]{2,}", " ")
    lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(x, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")), lambda x: x != "")
    s = F.array_join(lines, "\n")
    if max_chars > 0:
        s = F.substring(s, 1, max_chars)
    return F.regexp_replace(s, r"^[\s]+|[\s]+$", "")


def strip_label_prefix(text: Text, label: Text) -> Column:
    body, lab = trimmed(text), trimmed(label)
    rest = F.regexp_replace(F.substring(body, F.length(lab) + 1, F.length(body)), r"^[ \t:：=\-—·|,]+", "")
    return F.when((body == "") | (lab == ""), body).when(F.lower(body) == F.lower(lab), "").when(F.startswith(F.lower(body), F.lower(lab)), trimmed(rest)).otherwise(body)


def normalize_identifier(v: Text) -> Column:
    """Upper case, digits, ASCII letters and Hangul only; full-width forms fold to ASCII."""
    wide = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    return F.upper(F.regexp_replace(F.translate(F.coalesce(_c(v), F.lit("")), wide, narrow), r"[^0-9A-Za-z\x{AC00}-\x{D7A3}]+", ""))


def normalize_homoglyphs(v: Text) -> Column:
    """An identifier of which half or more is digits has look-alike letters turned into digits."""
    s = normalize_identifier(v)
    return F.when(F.regexp_count(s, F.lit("[0-9]")) * 2 < F.length(s), s).otherwise(F.translate(s, *P.HOMOGLYPHS))


def scan_identity(raw: Text) -> Column:
    """The identifier that a raw text names: shapes first, those behind a positive hint before others, then long numbers behind a hint.

    What stands within 60 characters behind a negative hint doesn't count.
    """
    upper = F.upper(F.coalesce(_c(raw), F.lit("")))

    def found(pattern: str) -> Column:
        # split at the matches: the text in front of match k is known from the lengths of the parts before it
        tokens = F.regexp_extract_all(upper, F.lit(pattern), F.lit(0))
        parts = F.split(upper, pattern)
        number = F.sequence(F.lit(0), F.size(tokens) - 1)
        numbered = F.when(F.size(tokens) > 0, number).otherwise(F.array().cast("array<int>"))

        def one(k: Column) -> Column:
            before = F.aggregate(F.slice(F.arrays_zip(parts, tokens), 1, k), F.lit(""), lambda acc, x: F.concat(acc, x["0"], x["1"]))
            head = F.concat(before, F.get(parts, k))
            near = F.regexp_replace(F.lower(F.right(head, F.lit(60))), r"[^\p{L}\p{N}]", "")
            return F.struct(F.get(tokens, k).alias("token"), near.alias("near"))

        return F.transform(numbered, one)

    def hinted(near: Column, words: list[str]) -> Column:
        return near.rlike("|".join(words))

    shapes = F.filter(found(P.IDENTIFIER), lambda x: ~hinted(x["near"], P.IDENTIFIER_NEGATIVE))
    good = F.filter(shapes, lambda x: hinted(x["near"], P.IDENTIFIER_HINTS))
    numbers = F.filter(found(P.IDENTIFIER_NUMBER), lambda x: ~hinted(x["near"], P.IDENTIFIER_NEGATIVE) & hinted(x["near"], P.IDENTIFIER_HINTS))
    return F.coalesce(F.get(good, F.lit(0))["token"], F.get(shapes, F.lit(0))["token"], normalize_homoglyphs(F.get(numbers, F.lit(0))["token"]), F.lit(""))


def char_overlap(a: Text, b: Text) -> Column:
    """Overlap coefficient of the distinct characters, white space aside."""
    x, y = (F.array_distinct(F.filter(F.split(F.regexp_replace(_c(v), r"\s+", ""), ""), lambda ch: ch != "")) for v in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def suffix_prefix(a: Text, b: Text, least: int = 2) -> Column:
    """The longest k of at least `least` so that a ends and b begins with the same k characters; 0 if none."""
    a, b = _c(a), _c(b)
    most = F.least(F.length(a), F.length(b))
    fits = F.filter(F.when(most >= least, F.sequence(F.lit(least), most)).otherwise(F.array().cast("array<int>")), lambda k: F.right(a, k) == F.substring(b, F.lit(1), k))
    return F.coalesce(F.array_max(fits), F.lit(0))


def latin_tokens(text: Text) -> Column:
    """Runs of Latin letters, lower-cased and folded to ASCII."""
    return F.transform(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(P.LATIN_LETTERS + "+"), F.lit(0)), lambda t: F.translate(F.lower(t), *P.FOLD))


def word_set(text: Text) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))


def desc_anchor(desc: Text) -> Column:
    """A schema description without its {Type} marker."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(desc), r"\{(String|Number|Boolean|Array)\}", " "), r"\s+", " "), r"^ | $", "")


def desc_format(desc: Text) -> Column:
    return F.when(F.contains(_c(desc), F.lit("{Number}")), "numeric").otherwise("")


def humanize(name: Text) -> Column:
    return F.trim(F.replace(_c(name), F.lit("_"), F.lit(" ")))


def strip_reasoning(text: Text) -> Column:
    """Without <think> blocks, what stands before a last closing tag and behind an open one."""
    s = F.regexp_replace(_c(text), r"(?is)<think>.*?</think>", "")
    s = F.regexp_replace(s, r"(?is)^.*</think>", "")
    return trimmed(F.regexp_replace(s, r"(?is)<think>.*$", ""))


def safe_name(name: Text) -> Column:
    return F.regexp_replace(_c(name), r"[^A-Za-z0-9_.\-]+", "_")


def block_census(text: Text) -> Column:
    """A map from script to its number of characters; a character counts for the first block that holds it."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\s\p{Nd}]", "")
    entries, taken = [], ""
    for name, _, ranges in P.BLOCKS:
        inside = f"[{ranges}&&[^{taken}]]" if taken else f"[{ranges}]"
        entries.append(F.struct(F.lit(name).alias("key"), F.regexp_count(t, F.lit(inside)).cast("bigint").alias("value")))
        taken += ranges
    entries.append(F.struct(F.lit("Latin").alias("key"), F.regexp_count(t, F.lit(f"[A-Za-z\\x{{00C0}}-\\x{{024F}}\\x{{1E00}}-\\x{{1EFF}}&&[^{taken}]]")).cast("bigint").alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0))


def script_language(census: Column) -> Column:
    """(script, language) of a census: the first deciding block with a character; Latin has no language yet."""
    out = None
    for name, code, _ in P.BLOCKS:
        found = F.struct(F.lit(name).alias("script"), F.lit(code).alias("language"))
        test = F.map_contains_key(census, F.lit(name))
        out = F.when(test, found) if out is None else out.when(test, found)
    return out.when(F.map_contains_key(census, F.lit("Latin")), F.struct(F.lit("Latin").alias("script"), F.lit("").alias("language"))).otherwise(F.struct(F.lit("").alias("script"), F.lit("").alias("language")))


def latin_hits(text: Text) -> Column:
    """A map from language to the number of tokens among its words."""
    tokens = latin_tokens(text)
    entries = [F.struct(F.lit(code).alias("key"), F.size(F.filter(tokens, lambda t, w=words: t.isin(w.split()))).cast("bigint").alias("value")) for code, words in P.LATIN_WORDS.items()]
    return F.map_from_entries(F.array(*entries))


def latin_language(text: Text) -> Column:
    """The Latin-script language by its words; English where too little or too even speaks for any."""
    hits = latin_hits(text)
    counts = F.reverse(F.array_sort(F.map_values(hits)))
    top, second = F.get(counts, F.lit(0)), F.get(counts, F.lit(1))
    best = F.get(F.map_keys(F.map_filter(hits, lambda _, n: n == top)), F.lit(0))
    sure = (F.size(latin_tokens(text)) >= P.LATIN_LIMITS["tokens"]) & (top >= P.LATIN_LIMITS["hits"]) & (top - second >= P.LATIN_LIMITS["margin"])
    return F.when(sure, best).otherwise("eng")


def is_schema_echo(v: Text, field: Text) -> Column:
    """Whether a value is empty, a placeholder, a type marker or its own field's name."""
    t = trimmed(v)
    low = F.regexp_replace(F.lower(t), "^[ .:\"'`]+|[ .:\"'`]+$", "")
    name = F.lower(trimmed(field))
    return (t == "") | low.isin(*P.SCHEMA_ECHO) | t.rlike(P.TYPE_MARKER) | low.rlike(P.FIELD_ECHO) | ((name != "") & ((low == name) | (low == F.replace(name, F.lit("_"), F.lit(" ")))))


def echoes_spec(v: Text, spec: Text) -> Column:
    """Whether a value repeats its specification: one holds the other, or 60 % of the specification's words are there."""
    a, b = compact(v), compact(spec)
    x, y = word_set(v), word_set(spec)
    shared = (F.size(x) >= 2) & (F.size(y) >= 2) & (F.size(F.array_intersect(x, y)) / F.greatest(F.size(y), F.lit(1)) >= 0.60)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | shared)


def looks_prompt_echo(v: Text) -> Column:
    flat = F.regexp_replace(F.lower(_c(v)), r"\s+", "")
    return F.exists(F.array(*[F.lit(m.replace(" ", "")) for m in P.PROMPT_ECHO]), lambda m: F.contains(flat, m))


def looks_reasoning(v: Text) -> Column:
    low = F.lower(trimmed(v))
    body = F.regexp_extract(low, r"(?s)<think>(.*?)(</think>|$)", 1)
    return F.when(F.contains(low, F.lit("<think>")), F.regexp_replace(body, r"\s+", "") != "").otherwise(F.exists(F.array(*[F.lit(o) for o in P.REASONING]), lambda o: F.startswith(low, o)))


def script_share(v: Text, script: Column) -> Column:
    """The share of a script among the characters of any known script; null without one."""
    census = block_census(v)
    total = F.aggregate(F.map_values(census), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(total > 0, F.coalesce(F.try_element_at(census, script), F.lit(0)) / total)


def expected_script(lang: Text) -> Column:
    table = F.create_map(*[F.lit(x) for pair in P.EXPECTED_SCRIPT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(_c(lang))), F.lit("Latin"))


def looks_romanized(v: Text, lang: Text) -> Column:
    """Mostly Latin letters where another script is expected; needs four characters."""
    n = F.aggregate(F.map_values(block_census(v)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return (expected_script(lang) != "Latin") & (n >= 4) & (script_share(v, F.lit("Latin")) >= 0.55)


def draft_matches_language(v: Text, lang: Text) -> Column:
    return F.coalesce(script_share(v, expected_script(lang)) >= 0.25, F.lit(True))


def normalize_lang(code: Text) -> Column:
    """ISO 639-3 of a code such as `en`, `EN-us` or `eng`; English if there is none."""
    c = F.replace(F.lower(F.trim(F.coalesce(_c(code), F.lit("")))), F.lit("-"), F.lit("_"))
    head = F.substring_index(c, "_", 1)
    table = F.create_map(*[F.lit(x) for pair in P.ISO1.items() for x in pair])
    return F.when(c == "", "eng").otherwise(F.coalesce(F.try_element_at(table, head), head))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lcs_similarity(a: Text, b: Text) -> Column:
    """2 * LCS / (m + n) of the compact texts, by the usual table row by row."""

    def table(x: Column, y: Column) -> Column:
        ys = F.transform(F.filter(F.split(y, ""), lambda ch: ch != ""), lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        zero = F.transform(F.sequence(F.lit(0), F.length(y)), lambda i: F.lit(0))

        def row(es: Column, prev: Column, ch: Column) -> Column:
            # cur[j] = prev[j-1] + 1 if equal, else max(cur[j-1], prev[j])
            return F.aggregate(es, F.array(F.lit(0)), lambda cur, e: F.array_append(cur, F.when(e["c"] == ch, F.get(prev, e["j"]) + 1).otherwise(F.greatest(F.get(cur, e["j"]), F.get(prev, e["j"] + 1)))))

        last = _let(ys, lambda es: F.aggregate(F.filter(F.split(x, ""), lambda ch: ch != ""), zero, lambda prev, ch: row(es, prev, ch)))
        return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(2.0 * F.element_at(last, -1) / (F.length(x) + F.length(y)))

    return _let(compact(a), lambda x: _let(compact(b), lambda y: table(x, y)))


def repair_key(key: Text, fields: list[str], least: float = 0.72) -> Column:
    """(field, index) of a key as a model wrote it: a trailing number is an index, a near name is the nearest field."""
    raw = trimmed(key)
    base = F.regexp_extract(raw, r"^(.*?)[ _\-]?([0-9]{1,2})$", 1)
    base = F.when(base == "", raw).otherwise(base)
    index = F.when(base == raw, 0).otherwise(F.regexp_extract(raw, r"([0-9]{1,2})$", 1).cast("int"))
    names = F.array(*[F.lit(f) for f in fields])
    scored = F.transform(names, lambda f, i: F.struct(F.round(lcs_similarity(base, f), 9).alias("s"), (-i).alias("less"), f.alias("f")))
    near = _let(F.array_max(scored), lambda best: F.when(best["s"] >= least, best["f"]).otherwise(""))
    return F.struct(F.when(F.array_contains(names, base), base).otherwise(near).alias("field"), index.alias("idx"))


def salvage_object(text: Text) -> Column:
    """A map of all whole `"key": "value"` or `"key": number` pairs of a text, the last of equal keys, whatever else is broken."""
    pairs = F.regexp_extract_all(_c(text), F.lit(r'"[A-Za-z_][A-Za-z0-9_ \-]*"\s*:\s*("[^"]*"|-?[0-9][0-9.]*)'), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r'^"([^"]*)"', 1).alias("key"), F.regexp_extract(p, r':\s*"?([^"]*)"?$', 1).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def grams_cosine(a: Text, b: Text) -> Column:
    """Cosine of raw counts of 2- and 3-grams of the compact texts."""
    from ..operators.bank import grams

    def counts(g: Column) -> Column:
        return F.transform(F.array_distinct(g), lambda t: F.struct(t.alias("t"), F.size(F.filter(g, lambda u: u == t)).cast("double").alias("n")))

    def square(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, e: s + e["n"] * e["n"])

    def whole(x: Column, y: Column) -> Column:
        dot = _let(counts(x), lambda cx: F.aggregate(cx, F.lit(0.0), lambda s, e: s + e["n"] * F.size(F.filter(y, lambda u: u == e["t"]))) / F.sqrt(square(cx)))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(dot / F.sqrt(square(counts(y))))

    return _let(grams(_c(a)), lambda x: _let(grams(_c(b)), lambda y: whole(x, y)))
