import random

import sentencepiece
from test_linededup import brute as brute_lines
from test_simhash import groups

import corpus_pipeline
from lumidoc.llm import decontaminate, langid, pieces, simhash

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    rnd = random.Random(9)
    words = {"en": "the of and house river stone light under every morning".split(), "de": "der die und haus fluss stein licht unter jeder morgen".split()}
    passage = "seven small boats crossed the grey bay before the storm came in from the west"
    rows = []
    for k in range(60):
        lang = ["en", "de"][k % 2]
        text = "\n".join(" ".join(rnd.choice(words[lang]) + str(rnd.randint(0, 9)) for _ in range(rnd.randint(5, 40))) for _ in range(rnd.randint(1, 5)))
        if k % 7 == 0:
            text += "\n" + passage if k % 2 else "\n" + " ".join(passage.split()[8:] + passage.split()[:8])
        rows.append((k, text, lang, f"s{k % 3}", len(text)))
    rows.append((100, rows[3][1], "de", "s0", 1))
    rows.append((101, rows[5][1] + "\nA line of its own that nobody else has here", "de", None, None))
    rows.append((102, rows[8][1].replace("1", "2", 1), "en", "s0", 1))
    rows += [(103, None, "en", "s1", None), (104, "", None, "s1", 0), (105, "12 34", "de", "s2", 5)]
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "another item that stands nowhere in these documents at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.train(docs)
    found = dict(zip([r[0] for r in rows], langid._decided(model, [r[1] for r in rows]), strict=True))
    kept = [(r[0], r[1]) for r in rows if found[r[0]][0] != "und" and not found[r[0]][2]]
    assert {100, 101, 102} <= {i for i, _ in kept} and not {103, 104, 105} & {i for i, _ in kept}
    lines = brute_lines(kept)
    prints = {i: simhash.fingerprint(t) for i, t in lines.items()}
    first = groups(sorted(prints), prints, simhash.RADIUS)
    firsts = {i: lines[i] for i in lines if first[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    block = decontaminate.Block([x for x in items if x[1]], decontaminate.LEAST)
    clean = {i: t for i, t in firsts.items() if all(x[1] < decontaminate.THRESHOLD for x in block.search(t))}
    assert len(clean) < len(firsts) < len(lines)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: sp.encode(t) for i, t in clean.items()}


def test_stages_keep_the_columns(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        empty = stage(spark, docs.limit(0), folder)
        assert empty.dtypes == docs.dtypes and empty.count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_line_dedup_keeps_every_document(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.line_dedup(spark, docs, folder)
    assert out.count() == docs.count()
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out.collect())
