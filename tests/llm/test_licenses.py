import math
import re
from collections import Counter

from pyspark.sql import functions as F

from lumidoc.llm import licenses


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", low) if w]


def brute(rows):
    """(id, path, license, how, cosine, from_dir) by definition: every line and every text against every template."""
    bags = [(name, Counter(words(t))) for name, t in licenses.TEMPLATES]
    vocabulary = {w for _, b in bags for w in b}
    df = Counter(w for _, _, t in rows for w in set(words(t)) & vocabulary)
    idf = {w: math.log((1 + len(rows)) / (1 + df[w])) + 1 for w in vocabulary}
    unseen = math.log(1 + len(rows)) + 1

    def best(text):
        bag = Counter(words(text))
        n = math.sqrt(sum((c * idf.get(w, unseen)) ** 2 for w, c in bag.items()))
        found = []
        for name, b in bags:
            dot = sum(bag[w] * c * idf[w] ** 2 for w, c in b.items())
            cos = round(dot / n / math.sqrt(sum((c * idf[w]) ** 2 for w, c in b.items())), 6) if n else 0
            if cos >= licenses.LEAST:
                found.append((-cos, name))
        return min(found, default=None)

    own, held = {}, {}
    for k, (_, path, text) in enumerate(rows):
        path = path or ""
        low = (text or "")
        found = [(b[0], s, b[1]) for s, part in [(-1, low), *enumerate(low.split("\n"))] if (b := best(part))]
        if found:
            own[k] = min(found)
            if (whole := next((f for f in found if f[1] == -1), None)) is not None:
                d = path.rpartition("/")[0]
                held[d] = min(held.get(d, (9,)), (whole[0], path, whole[2]))
    out = []
    for k, (i, path, _) in enumerate(rows):
        path = path or ""
        if k in own:
            out.append((i, path, own[k][2], "file" if own[k][1] < 0 else "header", -own[k][0], None))
            continue
        at = path.rpartition("/")[0]
        steps = at.split("/")
        near = next(("/".join(steps[:n]) for n in range(len(steps), -1, -1) if "/".join(steps[:n]) in held), None)
        out.append((i, path, held[near][2] if near is not None else None, "inherited" if near is not None else None, None, near))
    return sorted(out, key=str)


def files():
    rows = [
        (1, "repo/LICENSE", "Released under the MIT License."), (2, "repo/src/a.py", "code = 1\nmore words here"), (3, "repo/src/lib/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "repo/src/lib/deep/x", "anything else"), (5, "repo/src/b.py", "# Licensed under CC BY-NC 4.0.\nsome code that goes on"), (6, "other/c.py", "plain"), (7, None, None), (8, "", ""), (9, "repo/null.py", None),
        (10, "repo/LICENSE.2", "ALL RIGHTS RESERVED."), (11, "repo/src/rights.py", "the rights of all are reserved for some later time in the day"), (12, "/abs/LICENSE", "Licensed under CC BY 4.0."), (13, "/abs/sub/x", "y"),
        (14, "repo/src/long.py", "word " * 50_000 + "\nReleased under the MIT License.\n" + "tail " * 1000), (2, "repo/src/a.py", "code = 1\nmore words here"), (None, "repo/src/n.py", "no id"),
    ]
    return rows + [(100 + k, f"other/d{k}/f", f"text number {k} of the filler and the rest") for k in range(30)]


def test_against_brute_force(spark):
    rows = files()
    df = spark.createDataFrame([(*r, "m", 1) for r in rows], "doc_id long, path string, text string, license string, seg int")
    got = licenses.scan(df, "doc_id", F.col("path"))
    assert sorted(((r.doc_id, r.path, r.license, r.how, r.cosine, r.from_dir) for r in got.collect()), key=str) == brute(rows)
    distance = {r.doc_id: r.distance for r in got.collect()}
    assert distance[2] == 1 and distance[4] == 1 and distance[13] == 1 and distance[5] is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, path string, text string")
    assert licenses.scan(df, "doc_id", F.col("path")).count() == 0


def test_anchors_are_enough():
    weights = [(0, "a", "x", 1, 3.0), (0, "a", "y", 2, 1.0), (0, "a", "z", 1, 0.5)]
    assert licenses._anchors(weights, 0.5) == ["x", "y"] and licenses._anchors(weights, 0.7) == ["x"]


def test_whole_texts_wrapped_headers_and_names(spark):
    import textwrap

    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(textwrap.fill(p, 76) for p in licenses._MIT.split("\n\n"))
    bsd = "Copyright 2019, A Person\n\n" + textwrap.fill(licenses._BSD_OPENING.strip(), 70) + "\n\n" + "\n\n".join(textwrap.fill(p, 70) for p in (licenses._BSD_BODY + licenses._BSD_THIRD + licenses._BSD_WARRANTY).split("\n\n"))
    gpl = "\n".join("# " + x for x in textwrap.wrap(next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and "redistribute" in t), 40))
    code = "\n".join(f"value_{k} = compute(alpha_{k}, beta_{k % 7})" for k in range(60))
    rows = [
        (1, "a/LICENSE", mit), (2, "a/src/x.py", code), (3, "b/COPYING", bsd), (4, "b/y.c", code), (5, "c/z.py", gpl + "\n\n" + code), (6, "c/w.py", code),
        (7, "d/v.js", "// SPDX-License-Identifier: Apache-2.0\n" + code), (8, "e/short.py", gpl), (9, "e/other.py", code),
    ]
    filler = [(100 + k, f"z/f{k}", f"some words of file {k} that stand for the rest of all the software here") for k in range(40)]
    df = spark.createDataFrame(rows + filler, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.how) for r in licenses.scan(df, "doc_id", F.col("path"), names=r"^(LICEN[CS]E|COPYING)").collect()}
    assert got[1] == ("MIT", "file") and got[2] == ("MIT", "inherited") and got[3][0] == "BSD-3-Clause" and got[4] == ("BSD-3-Clause", "inherited")
    assert got[5] == ("GPL-3.0", "header") and got[6] == (None, None) and got[7] == ("Apache-2.0", "header")
    assert got[8][0] == "GPL-3.0" and got[9] == (None, None)
    assert all(got[100 + k] == (None, None) for k in range(40))
