import random

import numpy as np
import pytest
import xxhash

from lumidoc.llm import simhash
from lumidoc.llm.graph import components

TEXT = "doc_id long, text string"


def by_definition(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints, radius):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_by_definition():
    rnd = random.Random(1)
    texts = [None, "", " \t\n", "One", "one", "a b", "A\x0bB\x0cc d", "é É ü x y z"] + [" ".join(rnd.choice(["Ab", "c", "d e", "F!"]) for _ in range(rnd.randint(1, 40))) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(t) == by_definition(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_sliced_pairs_against_all_pairs(radius, monkeypatch):
    monkeypatch.setattr(simhash, "LANES", 128)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(6)]))
    group = np.sort(rng.integers(0, 3, len(fps)))
    i, j = simhash.sliced_pairs(fps, group, radius)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if group[a] == group[b] and bin(int(fps[a] ^ fps[b])).count("1") <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_components(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (5, 5), (90, 100), (70, 70)], "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {90: 90, 100: 90}


@pytest.mark.parametrize("bucket", [512, 1])
def test_links_against_all_pairs(spark, bucket):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(25):
            x = int(b) & (2**64 - 1)
            for _ in range(rng.integers(1, 5)):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x - 2**64 if x >> 63 else x)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, bucket).collect()}
    fps = sorted(fps)
    assert got == {(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}


def corpus():
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "river", "stone"]
    rows = [(1, None), (2, ""), (3, "Word"), (4, "word"), (9, None)]
    for k in range(10, 60):
        t = [rnd.choice(words) + str(rnd.randint(0, 30)) for _ in range(rnd.choice([4, 80, 400]))]
        rows.append((k, " ".join(t)))
        if k % 3 == 0:
            t[rnd.randrange(len(t))] = "changed"
            rows.append((1000 + k, " ".join(t)))
        if k % 5 == 0:
            rows.append((2000 + k, rows[-1][1]))
    rows.append((5, "long tail " * 60_000))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, TEXT)).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    want = groups(sorted(prints), prints, 2)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_cases(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], TEXT)).count() == 0
    rows = spark.createDataFrame([(7, "a b c", 1, "x"), (7, "a b c", 2, "y"), (None, "a b c", 3, "z"), (8, "other words here", 4, "w")], TEXT + ", fp int, fingerprint string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == [(7, 7), (7, 7), (8, 8), (None, 7)]
    kept = simhash.keep_first(rows).collect()
    assert sorted((r.doc_id or 0, r.fp in (1, 2)) for r in kept) == [(0, False), (7, True), (8, False)]
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "fingerprint"}
