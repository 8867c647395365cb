import random

from test_simhash import groups as simhash_groups

import corpus_pipeline
from lumidoc.llm import similar, simhash

TEXT = "doc_id long, text string"


def sets(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in low).split(" ") if w]
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or {tuple(words)}


def alike(a, b, least=0.8):
    return len(a & b) >= least * len(a | b)


def brute(rows):
    """The first (id, text) of each group by all pairs; null ids last."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    found, label = [sets(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if alike(found[i], found[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return sorted((d for k, d in enumerate(docs) if label[k] == k), key=str)


def corpus():
    rnd = random.Random(4)
    rows = [(1, None), (2, ""), (3, "Word"), (4, "word"), (5, " \n"), (6, "one two three"), (7, "One  two\nthree"), (8, "one two four")]
    for k in range(10, 40):
        text = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([60, 120, 300]))]
        rows.append((k, " ".join(text)))
        for copy in range(rnd.randint(0, 6)):  # copies of copies: chains whose ends are further apart than 0.8
            text = list(text)
            for _ in range(rnd.randint(1, max(1, len(text) // 60))):
                text[rnd.randrange(len(text))] = f"new{rnd.randint(0, 10**6)}"
            rows.append((rnd.choice([1000, 5]) * k + copy + 10_000, " ".join(text)))
    return rows


def kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in similar.keep_first(spark.createDataFrame(rows, TEXT).repartition(3)).collect()), key=str)


def test_against_all_pairs(spark):
    rows = corpus()
    assert kept(spark, rows) == brute(rows)


def test_pipeline_stage_finds_near_copies_that_fingerprints_miss(spark):
    rows = corpus()
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    missed = len(set(simhash_groups(sorted(prints), prints, simhash.RADIUS).values())) - len(brute(rows))
    assert missed > 20
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], TEXT + ", lang string, source string, n_chars long")
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str) == brute(rows)


def test_one_large_group_and_many_apart_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(similar, "bands", lambda found: [7] if len(found) else [])  # everything meets
    rows = corpus()[:70]
    docs = spark.createDataFrame(rows, TEXT)
    got = similar.keep_first(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute(rows)


def test_ids_that_repeat_or_are_null(spark):
    base = " ".join(f"a{k}" for k in range(100))
    rows = [(1, base), (1, "a text of its own under the same id"), (2, base + " end"), (None, base + " z"), (None, "null but unique text here"), (None, "null but unique text here"), (3, "twice the same row"), (3, "twice the same row")]
    assert kept(spark, rows) == brute(rows)
    assert (1, "a text of its own under the same id") in brute(rows)


def test_empty_table(spark):
    assert similar.keep_first(spark.createDataFrame([], TEXT)).count() == 0


def test_every_pair_is_found_by_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(similar, "bands", lambda found: [7] if len(found) else [])  # everything meets, hubs too
    rows = corpus()[:70]
    words = [similar._words(t) for _, t in rows]
    prints = {similar._class(w): (similar.fingerprint(similar.shingles(w)), len(similar.shingles(w))) for w in words}
    seen, linked = [], similar._linked

    def spy(pairs, *rest):
        seen.extend(tuple(r) for r in pairs.collect())
        return linked(pairs, *rest)

    monkeypatch.setattr(similar, "_linked", spy)
    similar.keep_first(spark.createDataFrame(rows, TEXT)).collect()
    assert seen
    for a, b in seen:
        (p, n), (q, m) = prints[a], prints[b]
        apart = (int.from_bytes(p, "little") ^ int.from_bytes(q, "little")).bit_count()
        assert apart <= (similar.WIDE if min(n, m) < similar.FEW else similar.RADIUS)
