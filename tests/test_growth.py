"""Region growth, tall bands and rounds over pages against their definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumidoc.operators import compete as N
from lumidoc.operators import growth as GR
from lumidoc.operators import reading as RD
from lumidoc.operators import scoring as S

STEP = {"down": (0, 1, 0, 0), "right": (0, 0, 0, 1), "up": (-1, 0, 0, 0), "left": (0, 0, -1, 0)}


def inside(box):
    return {(r, c) for r in range(box[0], box[1] + 1) for c in range(box[2], box[3] + 1)}


def grown(cells, box, category, anchor, boxes, rows, cols, cap):
    """Cell by cell, without tables."""

    def score(b):
        at = inside(b)
        if anchor is None:
            known = [cells[x][2][category] for x in at if category in cells[x][2]]
            return sum(known) / len(known) if known else -np.inf
        v = np.mean([cells[x][3] for x in at], axis=0)
        return float(v @ anchor / np.linalg.norm(v)) if np.linalg.norm(v) >= 1e-8 else -np.inf

    def meets(b, region):
        return any(b[0] < (c + 1) * 10 and b[2] > c * 10 and b[1] < (r + 1) * 10 and b[3] > r * 10 for r, c in region)

    first = now = score(box)
    path, away = [], 0
    for _ in range(10 if now > 0 else 0):
        found = []
        for k, (side, move) in enumerate(STEP.items()):
            wide = tuple(a + b for a, b in zip(box, move, strict=True))
            if wide[0] < 0 or wide[2] < 0 or wide[1] >= rows or wide[3] >= cols or len(inside(wide)) > cap:
                continue
            strip = inside(wide) - inside(box)
            bridges = sum(meets(b, inside(box)) and meets(b, strip) for b in boxes)
            mine, after = any(cells[x][1] == category for x in strip), score(wide)
            if (any(cells[x][0] for x in strip) or bridges) and (mine or away < 2) and after > 0 and after >= first * 0.55 and after >= now * (0.80 if bridges else 0.97):
                found.append((-(after - now + 0.01 * bridges), k, side, wide, after, mine))
        if not found:
            break
        _, _, side, box, now, mine = min(found)
        path.append(side)
        away = 0 if mine else away + 1
    return (*box, ",".join(path))


def test_growth(spark):
    rnd = random.Random(5)
    pages, seeds, boxes, want = [], [], [], {}
    for p in range(12):
        rows, cols = rnd.randint(4, 8), rnd.randint(4, 9)
        cells = {(r, c): (rnd.random() < 0.7, rnd.choice(["a", "b", None]), {"a": rnd.random()} if rnd.random() < 0.8 else {}, [rnd.random() + 0.4 for _ in range(3)]) for r in range(rows) for c in range(cols)}
        pages += [(p, r, c, *v) for (r, c), v in cells.items()]
        own = [(x, y, x + rnd.randint(2, 25), y + rnd.randint(2, 25)) for x, y in ((rnd.randint(0, 60), rnd.randint(0, 50)) for _ in range(3))] if p % 2 else []
        boxes += [(p, *b) for b in own]
        for k in range(4):
            r, c = rnd.randrange(rows), rnd.randrange(cols)
            anchor = None if k == 3 else np.array(cells[r, c][3]) / np.linalg.norm(cells[r, c][3])
            seeds.append((p, k, "a", r, r, c, c, None if anchor is None else anchor.tolist()))
            want[p, k] = grown(cells, (r, r, c, c), "a", anchor, own, rows, cols, 20)
    seeds += [(99, 0, "a", 1, 2, 3, 4, [1.0, 0.0, 0.0]), (0, 9, "z", 0, 0, 0, 0, None)]
    want[99, 0], want[0, 9] = (1, 2, 3, 4, ""), (0, 0, 0, 0, "")
    make = spark.createDataFrame
    got = GR.grown_regions(
        make(seeds, "page int, region int, category string, r0 int, r1 int, c0 int, c1 int, anchor array<double>"), make(pages, "page int, r int, c int, content boolean, owner string, affinity map<string,double>, vec array<double>"),
        make(boxes, "page int, x0 int, y0 int, x1 int, y1 int"), "page", (10.0, 10.0), 20,
    )
    assert {(r.page, r.region): tuple(r)[2:] for r in got.collect()} == want
    assert any("," in w[4] for w in want.values())


def test_tall_bands(spark):
    rnd = np.random.default_rng(7)
    profiles = {p: np.convolve(rnd.random(300) * 60 + (np.arange(300) % (17 + p) > 6) * 80, np.ones(4) / 4, "same") for p in range(6)}
    profiles[6] = np.concatenate([np.r_[np.zeros(9), np.full(9, 50.0)] for _ in range(6)] + [np.zeros(9), np.tile(np.r_[np.full(12, 90.0), np.full(10, 40.0)], 4)])

    def runs(v, gate):
        out, begin = [], None
        for y, hot in enumerate([*(v > gate), False]):
            if hot and begin is None:
                begin = y
            elif not hot and begin is not None:
                out += [(begin, y)] if y - begin >= 8 else []
                begin = None
        return out

    bands, want, split = [], set(), 0
    for p, v in profiles.items():
        now = runs(v, np.percentile(v, 12) + 0.22 * (v.max() - np.percentile(v, 12)))
        bands += [(p, *b) for b in now]
        for _ in range(3):
            middle, after = sorted(b - a for a, b in now)[len(now) // 2], []
            for a, b in now:
                part, subs = v[a:b], []
                if b - a > middle * 2.2 and b - a >= 16 and part.max() - np.percentile(part, 20) >= 2:
                    for k in (1, 2, 3):
                        subs = subs if len(subs) > 1 else runs(part, np.percentile(part, 20) + (part.max() - np.percentile(part, 20)) * (0.22 + 0.12 * k))
                after += [(a + x, a + y) for x, y in subs] if len(subs) > 1 else [(a, b)]
            split += len(after) > len(now)
            now = sorted(after)
        want |= {(p, *b) for b in now}
    rows = [(p, y, float(x)) for p, v in profiles.items() for y, x in enumerate(v)]
    got = RD.split_tall(spark.createDataFrame(bands, "page int, y0 int, y1 int"), spark.createDataFrame(rows, "page int, y int, v double"), "page")
    assert {tuple(r) for r in got.collect()} == want and split


def test_arena_over_pages_is_the_arena_of_each(spark):
    rnd = random.Random(2)
    rows = [(p, i, c, round(rnd.random() * (0.6 if c == "d" else 1), 3)) for p in range(4) for i in range(12) for c in "abcd"]
    scores = spark.createDataFrame(rows, "page int, idx int, category string, score double")
    out, _ = N.arena(scores, None, 0.1, 3, 3, ["page"])
    got = {tuple(r) for r in out.select("page", "category", "patches", F.round("peak", 6), "absent").collect()}
    want = set()
    for p in range(4):
        one, _ = N.arena(scores.where(F.col("page") == p).drop("page"), None, 0.1, 3, 3)
        want |= {(p, *tuple(r)) for r in one.select("category", "patches", F.round("peak", 6), "absent").collect()}
    assert got == want


def test_top_k_over_many_batches_with_ties(spark):
    rnd = random.Random(4)
    store = [(f"r{k:03}", [float(rnd.randint(0, 2)), float(rnd.randint(0, 2)), 1.0]) for k in range(400)]
    asked = store[:7]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = S.top_k(spark.createDataFrame(asked, "q string, vec array<double>"), spark.createDataFrame(store, "rid string, vec array<double>"), "q", "rid", 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in store}
    want = {(q, r, n + 1) for q, _ in asked for n, (_, r) in enumerate(sorted((-round(float(unit[q] @ unit[k]), 12), k) for k in unit)[:5])}
    assert {(r.q, r.rid, r["rank"]) for r in got} == want


def test_boxes_come_as_counts_of_cells(spark):
    rnd = random.Random(6)
    for wide, high in ((0.1, 7.3), (16.0, 16.0)):
        rows, cols = 3, 4
        at = lambda step: rnd.choice([rnd.randint(-2, 6) * step, rnd.uniform(-2, 6) * step, rnd.uniform(-1, 1) * 1e12])
        boxes = [(1, at(wide), at(high), at(wide), at(high)) for _ in range(3000)] + [(1, None, 0.0, 1.0, 1.0), (1, float("nan"), 0.0, 9e9, 9e9), (2, 0.0, 0.0, 9.0, 9.0), (None, 0.0, 0.0, 9.0, 9.0)]
        cells = [(1, r, c) for r in range(rows) for c in range(cols)]
        found = GR.cell_ranges(spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(cells, "page int, r int, c int"), "page", (wide, high)).collect()
        assert {r.page for r in found} == {1} and len(found) <= 600
        for r0, r1, c0, c1 in [(0, 0, 0, 0), (0, 2, 1, 3), (1, 2, 3, 3), (2, 2, 0, 1), (0, 2, 0, 3)]:
            want = sum(p == 1 and x0 is not None and x0 < (c1 + 1) * wide and x1 > c0 * wide and y0 < (r1 + 1) * high and y1 > r0 * high for p, x0, y0, x1, y1 in boxes)
            assert sum(r.n for r in found if r.r0 <= r1 and r.r1 >= r0 and r.c0 <= c1 and r.c1 >= c0) == want


def test_grounding_in_blocks(spark, monkeypatch):
    from lumidoc.operators import heatmap as H

    monkeypatch.setattr(H, "GROUNDED_BLOCK", 16)
    monkeypatch.setattr(H, "GROUNDED_STEP", 5)
    rng = np.random.default_rng(3)
    patches = [(p, r, c, rng.normal(size=4).tolist()) for p in (1, 2) for r in range(6) for c in range(8)] + [(1, 9, 9, None), (2, 9, 9, [1.0, 2.0]), (3, 0, 0, [1.0] * 4)]
    claims = [(p, f"{p}-{k}", None if k == 49 else rng.normal(size=4).tolist(), 1, 3, k % 5, k % 5 + 2) for p in (1, 2, 4) for k in range(50)] + [(2, "all", [1.0] * 4, 0, 9, 0, 9)]
    got = H.grounded(spark.createDataFrame(claims, "page int, claim string, vec array<double>, r0 int, r1 int, c0 int, c1 int"), spark.createDataFrame(patches, "page int, r int, c int, vec array<double>"), "page")
    got = {x.claim: (x.s_in, x.s_out, x.accepted) for x in got.collect()}
    assert set(got) == {c[1] for c in claims if c[0] != 4}
    for p, name, vec, r0, r1, c0, c1 in claims:
        if p == 4:
            continue
        if vec is None:
            assert got[name] == (None, None, True)
            continue
        v = np.array(vec)
        sims = [(float(v @ np.array(x) / np.linalg.norm(v) / np.linalg.norm(x)) if x is not None and len(x) == 4 else None, r0 <= r <= r1 and c0 <= c <= c1) for q, r, c, x in patches if q == p]
        known = [s for s, _ in sims if s is not None]
        scores = []
        for side in (True, False):
            n, own = sum(i == side for _, i in sims), [s for s, i in sims if i == side and s is not None]
            scores.append((max(own) - np.mean(known)) / max(np.std(known), 1e-6) - (np.sqrt(2 * np.log(n)) if n > 1 else 0) if own else None)
        assert got[name][:2] == tuple(None if s is None else pytest.approx(s, abs=1e-9) for s in scores)
        assert got[name][2] == (None in scores or scores[0] >= scores[1] or scores[1] - scores[0] < 0.5)
