import numpy as np

from lumidoc.llm import quality

TEXT = "doc_id long, text string"


def test_em_finds_the_labellers_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(6000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.7]
    counts = {}
    for g in good:
        p = "".join("0" if rng.random() < 0.2 else "+" if (rng.random() < r) == g else "-" for r in right)
        counts[p] = counts.get(p, 0) + 1
    model = quality.fit_labels(counts)
    assert abs(model.good - 0.8) < 0.05
    assert np.allclose(model.chances[:, 1, 2], right, atol=0.05) and np.allclose(model.chances[:, 0, 0], right, atol=0.07)
    assert model.posterior("+++++") > 0.99 > 0.01 > model.posterior("-----")
    again = quality.fit_labels(dict(reversed(list(counts.items()))))
    assert (again.chances == model.chances).all()


def test_agrees_with_labels_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert np.mean([r.keep for r in rows if r["quality"] is not None and r.doc_id is not None and r.keep is not None]) > 0.8


def test_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id: r.keep for r in quality.classify(docs).collect()}
    clean = [kept[d] for d, q in labels.items() if q == 1]
    poor = [kept[d] for d, q in labels.items() if q == 0]
    assert np.mean(clean) > 0.97 and np.mean(poor) < 0.1


def test_cases(spark):
    prose = "The old house stood near the river, and the people of the town walked there every day. "
    rows = [(k, prose * (1 + k % 4)) for k in range(30)] + [(100 + k, "SPAM!! " * 40 + "$$$ ### *** " * (5 + k)) for k in range(6)]
    rows += [(200, None), (201, ""), (None, prose), (3, prose), (202, prose * 20_000), (203, "SPAM!! ### $$$ " * 50_000)]
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows], TEXT + ", quality double, keep boolean")
    got = quality.classify(df).collect()
    keep = {r.doc_id: r.keep for r in got}
    assert len(got) == len(rows)
    assert all(keep[k] for k in range(30)) and keep[None] and keep[202]
    assert not any(keep[k] for k in (100, 101, 105, 200, 201, 203))
    assert all(r.quality == 0 for r in got if r.doc_id in (200, 201))
    assert quality.classify(df.limit(0)).count() == 0
    alike = quality.classify(spark.createDataFrame([(1, prose), (2, prose)], TEXT)).collect()
    assert all(r.keep for r in alike)


def test_expectation_maximisation_against_loops():
    """The label model's rounds written out pattern by pattern."""
    counts = {"+" * 13: 50, "-" * 13: 20, "0" * 13: 5, "+-0+-0+-0+-0+": 7, "--+++++++++++": 9}
    q = {p: 0.05 if p.count("-") >= 2 else 0.95 for p in counts}
    for _ in range(200):
        chance = {}
        for k in range(13):
            for good in (0, 1):
                n = {v: 0.5 + sum(c * (q[p] if good else 1 - q[p]) for p, c in counts.items() if p[k] == v) for v in "-+"}
                chance[k, good] = {v: n[v] / (n["-"] + n["+"]) for v in "-+"} | {"0": 1.0}
        share = min(max(sum(q[p] * c for p, c in counts.items()) / sum(counts.values()), 1e-3), 1 - 1e-3)
        after = {}
        for p in counts:
            both = [1 - share, share]
            for k, v in enumerate(p):
                both = [b * chance[k, good][v] for good, b in enumerate(both)]
            after[p] = both[1] / sum(both)
        moved = max(abs(after[p] - q[p]) for p in counts)
        if moved < 1e-9:
            break
        q = after
    model = quality.fit_labels(counts)
    assert all(abs(model.posterior(p) - after[p]) < 1e-6 for p in counts)
