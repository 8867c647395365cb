import zlib

import numpy as np

from lumidoc.llm import langid

TEXT = "doc_id long, text string, lang string"


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12, 40):
        code = langid.codewords(n)
        d = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(d) >= (1 if n == 2 else 2) and set(np.unique(code)) == {-1, 1}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert np.mean(held) > 0.97
    assert all(0 <= g.score <= 1 for g in got.values())


def test_cases(spark):
    words = {"en": "the house and the river of that land ", "fr": "le chien est dans la rue avec une "}
    rows = [(k, words[v] * (1 + k % 3), v) for k in range(40) for v in [["en", "fr"][k % 2]]]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "12 34 !!", "en"), (103, "the river and the land", None), (None, "la rue est dans", "fr"), (104, "the house " * 50_000, "en"), (103, "the river and the land", None)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], TEXT + ", score double, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df).collect()]
    pred = {i: p for i, p, _ in got}
    assert len(got) == len(rows)
    assert [pred[k] for k in (100, 101, 102)] == ["und"] * 3 and all(s == 0 for i, _, s in got if i in (100, 101, 102))
    assert pred[103] == "en" and pred[None] == "fr" and pred[104] == "en"
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {103, None, 104} and kept.where("doc_id in (100, 101, 102)").count() == 0


def test_few_labels(spark):
    none = spark.createDataFrame([(1, "some text", None)], TEXT)
    assert [(r.lang_pred, r.score) for r in langid.identify(none).collect()] == [("und", 0.0)]
    one = spark.createDataFrame([(k, "some text", "en") for k in range(8)], TEXT)
    assert {(r.lang_pred, r.score) for r in langid.identify(one).collect()} == {("en", 1.0)}
    assert langid.identify(none.limit(0)).count() == 0


def test_prediction_looks_at_the_text_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    a = {r.text: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    changed = docs.selectExpr("doc_id + 7 AS doc_id", "text", "'xx' AS lang", "'other' AS source", "n_chars")
    assert a == {r.text: (r.lang_pred, r.score) for r in langid.predict(changed, model).collect()}


def test_ambiguous_texts_are_flagged():
    model = langid.fit(np.stack([langid.features(t) for t in ["aaa bbb"] * 20 + ["xxx yyy"] * 20]), ["a"] * 20 + ["x"] * 20)
    sure, vague = model.decode(np.stack([langid.features("aaa bbb aaa"), langid.features("qqq 1")]))
    assert sure[0] == "a" and not sure[2] and sure[1] > vague[1]


def test_a_repeated_row_counts_once_and_labels_are_bounded(spark):
    rows = [(k, f"the house number {k} of the river", "en") for k in range(60)] + [(1000, "the same row over and over", "en")] * 400 + [(2000 + k, "eine Zeile " + "x" * k, f"dirt{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = langid.sample(docs, "doc_id", "text", "lang", 500, 3).collect()
    assert len({r.lang for r in taken}) <= 3 and len(taken) == len({(r.lang, r.text) for r in taken})
