"""Operators over regions, schemas and reading that have no SQL, against their definitions."""

import json
import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from lumidoc.functions import text as X
from lumidoc.operators import chunks as C
from lumidoc.operators import forms as FM
from lumidoc.operators import regions as R
from lumidoc.operators import schema as SC
from lumidoc.sources.vectorlog import VectorLog, stats


def grid(rows, cols, seed):
    rnd = random.Random(seed)
    return {(r, c): round(rnd.random(), 3) for r in range(rows) for c in range(cols)}


def reach(cells, gate, rows=(), cols=()):
    """Components by repeated spreading from each first cell, in order of cells."""
    left, out = sorted(k for k, v in cells.items() if v > gate), []
    while left:
        part, grew = {left[0]}, True
        while grew:
            ahead = {(r + d, c) for r, c in part for d in (-1, 1) if r + d not in rows} | {(r, c + d) for r, c in part for d in (-1, 1) if c + d not in cols}
            grew = bool(new := (ahead & set(left)) - part)
            part |= new
        out.append(sorted(part))
        left = [x for x in left if x not in part]
    return out


def frame(spark, pages):
    return spark.createDataFrame([(p, r, c, v) for p, cells in pages.items() for (r, c), v in cells.items()], "page string, r int, c int, score double")


def parts(rows, *keys):
    out = {}
    for x in rows:
        out.setdefault(tuple(x[k] for k in keys), []).append((x.r, x.c))
    return {k: sorted(v) for k, v in out.items()}


def test_components_between_walls(spark):
    pages = {f"p{k}": grid(9, 12, k) for k in range(4)}
    got = parts(R.walled_components(frame(spark, pages), "page", 0.4, [3], [5]).collect(), "page", "comp")
    for p, cells in pages.items():
        want = reach(cells, 0.4, (3,), (5,))
        mine = [v for (q, _), v in sorted(got.items()) if q == p]
        assert sorted(mine) == sorted(want)
        peaks = [max(cells[x] for x in v) for v in mine]
        assert peaks == sorted(peaks, reverse=True)


def test_split_oversized(spark):
    pages = {f"p{k}": grid(10, 10, 10 + k) for k in range(3)}
    comps = R.walled_components(frame(spark, pages), "page", 0.3).cache()
    got = parts(R.split_oversized(comps, "page", 0.3, 6).collect(), "page", "comp", "part")
    for (p, comp), cells in parts(comps.collect(), "page", "comp").items():
        scores, gate, best = {x: pages[p][x] for x in cells}, 0.3, [cells]
        for k in range(1, 5) if len(cells) > 6 else ():
            gate = max(gate, float(np.quantile(list(scores.values()), min(0.95, 0.35 + 0.15 * k))))
            subs = reach(scores, gate)
            if not subs:
                break
            best = subs
            if len(subs) > 1 and max(map(len, subs)) <= 6:
                break
        assert sorted(v for (q, c, _), v in got.items() if (q, c) == (p, comp)) == sorted(best)


def otsu(values):
    """The centre of the bin of 64 that parts values with the greatest variance between, by trying each."""
    low, high = min(values), max(values)
    if len(values) < 2 or high - low < 1e-9:
        return low
    hist, edges = np.histogram(values, bins=64, range=(low, high))
    mid = (edges[:-1] + edges[1:]) / 2
    between = [hist[: k + 1].sum() * hist[k + 1 :].sum() * (np.average(mid[: k + 1], weights=hist[: k + 1]) - np.average(mid[k + 1 :], weights=hist[k + 1 :])) ** 2 if hist[k + 1 :].sum() else 0 for k in range(64)]
    return mid[int(np.argmax(np.round(between, 9)))]


def test_legibility(spark):
    rnd = random.Random(3)
    pages = {"p": [(rnd.choice([0.0, 0.02, 0.7, 0.9]), round(rnd.random(), 2)) for _ in range(40)], "q": [(0.0, 0.0)] * 5 + [(0.9, 0.3)]}
    rows = [(p, 0, c, ink, sharp) for p, cells in pages.items() for c, (ink, sharp) in enumerate(cells)]
    got = {(r.page, r.c): r.state for r in R.legibility(spark.createDataFrame(rows, "page string, r int, c int, ink double, sharpness double"), "page").collect()}
    for p, cells in pages.items():
        gate = otsu([x for x, _ in cells])
        inked = [s for x, s in cells if x > gate]
        fine = otsu(inked) if len(inked) > 1 else 0.0
        assert [got[p, c] for c in range(len(cells))] == ["blank" if x <= gate else "legible" if s > fine else "illegible" for x, s in cells]


def test_prerequisites_of_long_chains_diamonds_and_cycles(spark):
    needs = [(f"c{k}", f"c{k + 1}") for k in range(200)] + [("d", "x"), ("d", "y"), ("x", "z"), ("y", "z"), ("o", "p"), ("p", "o")]
    out = FM.prerequisites(spark.createDataFrame(needs, "item string, needs string"), spark.createDataFrame([("c0",), ("d",), ("o",), ("alone",)], "item string"))
    found = {}
    for r in out.collect():
        assert (r.target, r.item) not in found
        found[r.target, r.item] = r.depth
    assert {k: v for k, v in found.items() if k[0] == "c0"} == {("c0", f"c{k}"): k for k in range(201)}
    assert {k[1]: v for k, v in found.items() if k[0] == "d"} == {"d": 0, "x": 1, "y": 1, "z": 2}
    assert {k[1]: v for k, v in found.items() if k[0] == "o"} == {"o": 0, "p": 1} and found["alone", "alone"] == 0


def test_nested_values(spark):
    rows = spark.createDataFrame([({"b": ["x", None], "a": []},), (None,)], "v map<string,array<string>>")
    kind = rows.schema["v"].dataType
    got = rows.select(SC.stringified(F.col("v"), kind).alias("s"), SC.flattened(F.col("v"), kind).alias("f")).collect()
    assert [tuple(r) for r in got] == [("{a:[],b:[x,None]}", ["x"]), ("None", [])]


def test_listed_schemas(spark, tmp_path):
    (tmp_path / "z.json").write_text(json.dumps({"trade_schema": {"overlay": {"PL": {}, "CI": {}}}}))
    assert [tuple(r) for r in SC.listed_schemas(spark, f"file://{tmp_path}").collect()] == [("z.json#CI", "virtual"), ("z.json#PL", "virtual")]
    (tmp_path / "a.json").write_text(json.dumps({"fields": {"n": {"label": "x"}}}))
    (tmp_path / "broken.json").write_text("{")
    assert [tuple(r) for r in SC.listed_schemas(spark, f"file://{tmp_path}").collect()] == [("a.json", "schema")]


def test_sanitize_with_compatibility_forms(spark):
    rows = spark.createDataFrame([(1, "ＡＢＣ ﬁne ①"), (2, None), (3, "a\r\n\r\nb")], "id int, t string")
    got = {r.id: r.c for r in rows.select("id", X.sanitize(C.normal_form("t")).alias("c")).collect()}
    assert got == {1: unicodedata.normalize("NFKC", "ＡＢＣ ﬁne ①"), 2: "", 3: "a\nb"}


def test_windows_on_both_tracks(spark):
    sents = [(1, 0, "Café ＡＢＣ noir"), (1, 1, " ".join(f"w{k}" for k in range(60))), (2, 0, " ".join(f"É{k}" for k in range(250))), (3, 0, "one")]
    got = {}
    for r in C.windows(spark.createDataFrame(sents, "id int, sentence_index int, sentence string"), "id", most=10, longest=4).collect():
        got.setdefault((r.id, r.sentence_index), set()).add((r.start, r.end, r.text, r.track))
    base = {}
    for i, k, text in sents:
        words, start = text.split(), base.get(i, 0)
        base[i] = start + len(words)
        made = []
        for size in range(1, min(4, len(words)) + 1):
            for at in range(len(words) - size + 1):
                if len(made) >= 40:
                    break
                surface = " ".join(words[at : at + size])
                form = " ".join(C.canonical(w) for w in words[at : at + size])
                made.append((-size, at, "surface", surface))
                if form != surface:
                    made.append((-size, at, "canonical", form))
        assert got[i, k] == {(start + at, start + at - less, t, track) for less, at, track, t in sorted(made)[:10]}


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    log = VectorLog(spark, f"file://{tmp_path}", "n", 2, "r")
    assert log.next_seq() == 0
    rows = spark.createDataFrame([("a", [1.0, 2.0], "m1"), ("a", [3.0, 4.0], "m2"), ("b", [1.0, 1.0], None), ("c", [1.0], "x")], "rid string, vec array<float>, meta string")
    for _ in range(2):
        log.upsert(rows, 0)
    assert tuple(stats(log.log()).first()) == (2, 0, False) and log.next_seq() == 1
    assert {r.rid: (list(r.vec), r.meta) for r in log.live().dropDuplicates(["rid"]).collect()} == {"a": ([3.0, 4.0], "m2"), "b": ([1.0, 1.0], None)}
    log.delete(rows.where("rid = 'a'").select("rid").distinct(), log.next_seq())
    assert [r.rid for r in log.live().collect()] == ["b"] and stats(log.log()).first()["dead"] == 2  # the old row and its tombstone
