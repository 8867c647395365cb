"""Operators on hand-made rows and against plain models."""

import json
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumidoc.functions import text as X
from lumidoc.operators import bank as B
from lumidoc.operators import chunks as C
from lumidoc.operators import compete as N
from lumidoc.operators import lines as L
from lumidoc.operators import providers as PR
from lumidoc.operators import records as R
from lumidoc.operators import scoring as S
from lumidoc.sources import documents as SRC
from lumidoc.sources.vectorlog import VectorLog, latest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "fmt", "ok"), [("010-1234-5678", "phone", True), ("010-1234-5678", "date", True), ("010-1234-5678", "link", False), ("", "enum", False), ("x", "no such format", True)])
def test_formats(spark, value, fmt, ok):
    assert one(spark, X.value_matches_format(F.lit(value), F.lit(fmt))) is ok


def test_identifiers(spark):
    assert one(spark, X.normalize_homoglyphs(F.lit("inv-2024/O012"))) == "1NV20240012"
    assert one(spark, R.address("ref", F.lit("--"))) == "0x" + "0" * 40
    assert one(spark, R.relay_index(F.lit("inv-2024/O012"))) == zlib.crc32(b"1NV20240012")


def test_canonical_words(spark):
    assert [C.canonical(w) for w in ("«Été»", "soooo", "1,234,567", "ﬁne", "--", None)] == ["ete", "soo", "1234567", "fine", "", ""]
    df = spark.createDataFrame([(["Été!", "B"],)], "w array<string>")
    assert df.select(C.canonical_words("w").alias("x")).first()["x"] == ["ete", "b"]


def windows_by_definition(words, most=48, longest=6):
    out = []
    for size in range(1, longest + 1):
        for a in range(len(words) - size + 1):
            surface = " ".join(words[a : a + size])
            form = " ".join(x for x in map(C.canonical, words[a : a + size]) if x)
            out.append((a, a + size, surface, "surface"))
            if form and form != surface:
                out.append((a, a + size, form, "canonical"))
            if len(out) >= 4 * most:
                break
        if len(out) >= 4 * most:
            break
    return sorted(out, key=lambda c: (c[0] - c[1], c[0], c[3]))[:most]


def test_windows_of_both_tracks(spark):
    rnd = random.Random(1)
    rows = [(k, 0, " ".join(rnd.choice(["Été", "alpha", "B2", "x"]) for _ in range(rnd.randint(1, 60)))) for k in range(25)]
    got = C.windows(spark.createDataFrame(rows, "id int, sentence_index int, sentence string"), "id").collect()
    for k, _, sentence in rows:
        assert sorted((r.start, r.end, r.text, r.track) for r in got if r.id == k) == sorted(windows_by_definition(sentence.split()))


def spans_by_definition(cands):
    winners = []
    for s, e, seq, score in sorted(cands, key=lambda c: (-c[3], c[0] - c[1], c[0], c[2])):
        hit = next((w for w in winners if w[0] < e and w[1] > s), None)
        if hit is None:
            winners.append([s, e, seq])
        else:
            hit[0], hit[1] = min(hit[0], s), max(hit[1], e)
    return sorted(map(tuple, winners))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6), st.integers(0, 5)), min_size=1, max_size=12), min_size=1, max_size=6))
def test_spans_against_a_plain_model(spark, docs):
    rows = [(d, k, s, s + n, "f", p / 4) for d, cands in enumerate(docs) for k, (s, n, p) in enumerate(cands)]
    got = N.nms_spans(spark.createDataFrame(rows, "doc int, seq int, s int, e int, field string, score double")).collect()
    for d in range(len(docs)):
        assert sorted((r.s, r.e, r.seq) for r in got if r.doc == d) == spans_by_definition([(s, e, k, p) for x, k, s, e, _, p in rows if x == d])


def test_span_fixture(spark):
    df = spark.createDataFrame([(1, 0, 0, 3, "a", 0.9), (1, 1, 2, 5, "b", 0.8), (1, 2, 4, 6, "c", 0.7)], "doc int, seq int, s int, e int, field string, score double")
    w = N.nms_spans(df)
    assert [(r.s, r.e, r.absorbed) for r in w.collect()] == [(0, 6, 2)]
    two = spark.createDataFrame([(1, 0, 1, 2, "a", 1.0), (1, 1, 4, 5, "b", 2.0)], "doc int, seq int, s int, e int, field string, score double")
    total = spark.createDataFrame([(1, 6)], "doc int, n_words int")
    assert sorted((r.s, r.e) for r in N.bridge_gaps(two, total).collect()) == [(0, 2), (2, 6)]
    cover = spark.createDataFrame([(1, 0, 3), (1, 2, 5)], "doc int, s int, e int")
    assert N.coverage(cover, spark.createDataFrame([(1, 10)], "doc int, n_words int")).first()["coverage"] == 0.5


def test_iou(spark):
    a, b = (tuple(map(F.lit, x)) for x in ((0, 0, 10, 10), (5, 0, 15, 10)))
    assert round(one(spark, N.iou(a, b)), 4) == 0.3333 and one(spark, N.iou(a, tuple(map(F.lit, (20, 0, 30, 10))))) == 0


def test_margin(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (1, 0.4), (2, 1.0), (2, float("inf"))], "g int, score double")
    got = {r.g: (round(r.m12, 6), round(r.band, 6), r.decisive) for r in S.decisive_margin(df, "g").collect()}
    assert got == {1: (0.4, 0.05, True), 2: (0.0, 0.0, True)}


def test_ctc(spark):
    df = spark.createDataFrame([(0, t, k, 0.9) for t, k in enumerate([3, 3, 0, 3, 5])], "line int, t int, k int, prob double")
    assert L.ctc(df, ["line"]).first()["ks"] == [3, 3, 5]


def test_read_windows(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 30)], "page int, n int")
    got = sorted((r.page, r.start, r.end) for r in L.read_windows(df, "page", "n").collect())
    assert got == [(1, 0, 2), (1, 1, 3), (2, 0, 1)] + [(3, k, min(30, k + 3)) for k in range(0, 30, 3)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(out[j], row[j + 1]))
    return out


def test_lcs(spark):
    rnd = random.Random(2)
    pairs = [("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))), "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", X.lcs_similarity("a", "b").alias("s")).collect():
        want = 1.0 if r.a == r.b and r.a else 2 * lcs(r.a, r.b) / (len(r.a) + len(r.b)) if r.a and r.b else 0.0
        assert abs(r.s - want) < 1e-12


def test_repair_json(spark):
    whole = {"a": {"x": [1, 2]}, "b": {"y": "}{"}}
    text = json.dumps(whole)
    df = spark.createDataFrame([(text,), (text[:-3],), (text[: text.index('"b"') + 7],), ("{",), (None,)], "s string")
    got = [r.x for r in df.select(SRC.repair_json("s").alias("x")).collect()]
    assert got[0] == text and json.loads(got[2]) == {"a": whole["a"]} and got[3] is None


def test_max_pool_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(8)]
    v = spark.createDataFrame([(k, vec()) for k in range(30)], "id int, vec array<double>")
    bank = spark.createDataFrame([(f"f{k % 3}", k, 1.0 + k % 2, vec()) for k in range(12)], "field string, ord int, weight double, vec array<double>")
    whole = sorted(map(tuple, S.max_pool(v, bank, "id", ["field"]).collect()))
    monkeypatch.setattr(S.bank_blocks, "__defaults__", (5,))
    parts = sorted(map(tuple, S.max_pool(v, bank, "id", ["field"]).collect()))
    assert [x[:2] + x[3:] for x in whole] == [x[:2] + x[3:] for x in parts] and len(whole) == 90


def test_label_index_exact_and_short(spark):
    index = B.label_index(spark.createDataFrame([("total", 0, "Total Amount", "label"), ("date", 1, "Date", "label")], "field string, ord int, surface string, source string"))
    labels = spark.createDataFrame([(1, "TOTAL-amount"), (2, "xy"), (3, "total amnt")], "id int, label string")
    got = {(r.id, r.field): r.score for r in B.label_scores(labels, index).collect()}
    assert got[1, "total"] == 1.0 and not any(i == 2 for i, _ in got) and 0.42 < got[3, "total"] < 1


def test_vector_log(spark, tmp_path):
    log = VectorLog(spark, f"file://{tmp_path}", "fields", 2, "h1")
    rows = lambda *r: spark.createDataFrame(list(r), "rid string, vec array<float>, meta string")
    log.upsert(rows(("a", [1.0, 0.0], "1"), ("b", [0.0, 1.0], "1"), ("c", [1.0], "1")), 1)
    log.upsert(rows(("a", [0.0, 1.0], "2")), 2)
    log.delete(spark.createDataFrame([("b",)], "rid string"), 3)
    assert [(r.rid, r.meta) for r in log.live().collect()] == [("a", "2")]
    assert log.get_many(spark.createDataFrame([("b",), ("a",)], "rid string")).count() == 1
    fresh = log.compacted(f"file://{tmp_path}/new")
    assert fresh.log().count() == 1 and [(r.rid, r.meta) for r in latest(fresh.log()).collect()] == [("a", "2")]


def test_relay_edges(spark):
    rec = spark.createDataFrame([(1, "header", "doc_number", "X-100"), (1, "logistics", "reference_bl", "B-1"), (2, "header", "no", "long text without number")], "doc int, category string, field string, value string")
    records = R.grouped(rec, "doc")
    edges = [(r.doc, r.target, r.value) for r in R.relay_edges(records, "doc", "CINV").collect()]
    assert len(edges) == 10 and (1, "BL", "B-1") in edges and not any(d == 2 for d, _, _ in edges)
    assert next(r.identity for r in records.collect() if r.doc == 2).startswith("task_")


def test_load_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello \xff world")
    (tmp_path / "b.PDF").write_bytes(b"pages")
    (tmp_path / "c.pdf").write_bytes(b"short")
    (tmp_path / "d.png").write_bytes(b"\x89PNG")
    pages = lambda b: ["A page with a text layer, long enough to count as one." * 2] if b == b"pages" else ["x"]
    got = {r.path.rsplit("/", 1)[1]: (r.mode, r.text) for r in SRC.load(spark, f"file://{tmp_path}", pages).collect()}
    assert got["a.txt"] == ("text", "hello  world") and got["b.PDF"][0] == "text" and got["c.pdf"] == ("image", None) and got["d.png"] == ("image", None)


def test_encode_once(spark):
    seen = []
    encode = PR.encoder(lambda texts: [[float(len(t)), 1.0] if t else [0.0, 0.0] for t in texts])
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, ""), (5, "cached")], "id int, t string")
    cache = spark.createDataFrame([("cached", [9.0, 9.0])], "text string, vec array<double>")
    got = {r.id: r.vec for r in PR.encode_once(rows, "t", encode, cache).collect()}
    assert got == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: None, 5: [9.0, 9.0]} and not seen
    wide = lambda c: F.array_repeat(F.lit(1.0), 3)
    assert one(spark, PR.routed(F.lit("x"), [wide, PR.hash_embedding], 64)) is not None
    assert one(spark, PR.routed(F.lit("x"), [wide], 2)) == [0.0, 0.0]


def test_prose_field(spark):
    texts = spark.createDataFrame([(1, "abcd"), (2, "x" * 30), (3, "y" * 400), (4, "")], "id int, text string")
    scores = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (2, "a", 0.500), (2, "b", 0.495)], "id int, field string, score double")
    lengths = spark.createDataFrame([("a", 3, 10), ("b", 20, 28), ("c", 100, 150)], "field string, typical int, capacity int")
    from lumidoc.operators import forms as FM

    got = {r.id: (r.field, r.how) for r in FM.prose_field(texts, scores, lengths, "id", "last").collect()}
    assert got == {1: ("a", "index"), 2: ("b", "capacity"), 3: ("c", "length"), 4: ("last", "fallback")}


def test_grid_components_longer_than_any_number_of_rounds(spark):
    from lumidoc.operators import heatmap as H

    stripe = [("a", r, 3) for r in range(300)]
    snake = [("b", r, c) for r in range(0, 240, 2) for c in range(4)] + [("b", r, 3 if r % 4 == 1 else 0) for r in range(1, 239, 2)]
    apart = [("a", r, 5) for r in range(0, 300, 2)]
    got = {(x.category, x.r, x.c): x.comp for x in H.grid_components(spark.createDataFrame(stripe + snake + apart, "category string, r int, c int")).collect()}
    assert got == {k: 3 for k in stripe} | {k: 0 for k in snake} | {k: k[1] * 100000 + 5 for k in apart}
