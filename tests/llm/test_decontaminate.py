import random

from lumidoc.llm import decontaminate as D


def naive(a, b, least):
    """Greedy string tiling by its definition: find the longest unmarked common run, mark it, again."""
    ma, mb, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, j, i)
        if best is None:
            return sum(mb), len(tiles)
        k, j, i = best
        ma[i : i + k], mb[j : j + k] = [True] * k, [True] * k
        tiles.append(best)


def test_tiling_against_its_definition():
    rnd = random.Random(11)
    for _ in range(60):
        b = [rnd.choice("abcd") for _ in range(rnd.randint(1, 14))]
        a = [rnd.choice("abcdx") for _ in range(rnd.randint(0, 20))] + b[len(b) // 2 :] + ["x"] + b[: len(b) // 2]
        least = min(3, len(b))
        block = D.Block([(1, " ".join(b))], 3)
        found = list(block.search(" ".join(a)))
        covered, _ = naive(a, b, least)
        assert (round(found[0][1] * len(b)) if found else 0) == covered


ITEMS = [(1, "Wer hat den Käse zum Bahnhof gerollt und warum ist er dort so lange liegen geblieben"), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, None), (4, ""), (5, "short item"), (None, "an item that has no id but ten words of text"), (2, "one two three four five six seven eight nine ten eleven twelve")]


def test_leaks(spark):
    passage = ITEMS[0][1]
    words = passage.split()
    rows = [
        (10, "Vorher. " + passage.upper() + "! Nachher."), (11, " ".join(words[8:]) + ", und: " + " ".join(words[:8])), (12, " ".join(words[:6]) + " etwas ganz anderes hier"), (13, None), (14, ""), (15, "this is a short item indeed"),
        (16, "clean text without any of it"), (None, "seven eight nine ten eleven twelve one two three four five six"), (17, "filler " * 100_000 + ITEMS[1][1]), (10, passage), (18, "AN ITEM that has no id, but ten words of text"),
    ]
    docs = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, item_id int, coverage string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(10, 1), (10, 1), (11, 1), (15, 5), (None, 2), (None, 2), (17, 2), (17, 2), (18, None)], key=str)
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [12, 13, 14, 16]
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0 and D.keep_clean(docs, bench.limit(0)).count() == len(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, D.leaks(docs, bench).collect()))
    parts = sorted((r.doc_id, *x) for b in D.blocks(bench, "item_id", "text", D.LEAST, 3000) for r in docs.collect() for x in b.search(r.text) if x[1] >= D.THRESHOLD)
    assert len(list(D.blocks(bench, "item_id", "text", D.LEAST, 3000))) > 2
    assert whole == parts and whole


def test_repetitive_texts_and_single_words(spark):
    item, text = "la " * 200, "la " * 3000 + "end"
    block = D.Block([(1, item)], D.LEAST)
    found = list(block.search(text))
    assert [(x[0], x[1], x[2], x[3]) for x in found] == [(1, 1.0, 1, 200)]
    docs = spark.createDataFrame([(1, "the river and the stone"), (2, "River"), (3, "river river"), (4, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "river"), (8, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()) == [(2, 7), (4, 8)]


def test_pairs_in_blocks_give_the_same(monkeypatch):
    rnd = random.Random(2)
    items = [(k, " ".join(rnd.choice("abc") for _ in range(30))) for k in range(6)]
    texts = [" ".join(rnd.choice("abc") for _ in range(120)) for _ in range(6)]
    block = D.Block(items, 3)
    whole = [list(block.search(t)) for t in texts]
    monkeypatch.setattr(D, "PAIRS", 7)
    assert [list(block.search(t)) for t in texts] == whole and any(whole)
