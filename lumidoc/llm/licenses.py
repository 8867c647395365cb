"""License scans: sparse TF-IDF cosines of headers and licence files to templates, then directory inheritance.

DataFrame functions only. A file's header candidates are its lines and its paragraphs of several lines (a comment block
is one), its candidate as a licence file is the whole text. Words are runs of ASCII letters and digits and of any other non-ASCII characters, A-Z lower-cased. A word of
the templates' vocabulary weighs ln((1 + files) / (1 + files with the word)) + 1, counted over all files; any other
word weighs as one that no file has, so it can only lower a cosine. A candidate has the licence of its nearest
template if the cosine, rounded to 6 digits, is at least `least`; the greatest of a file's candidates counts (whole
text first, then the first line, then the first paragraph, then the licence's name).

Exact pruning: a cosine of `least` or more needs one of a template's anchors, its rarest words without which
the rest of the template's unit vector is shorter than `least`. Only texts and parts with an anchor are scored, and
whole texts and paragraphs only if their words outside the vocabulary leave room for that cosine.

Inheritance: a licence file gives its licence to its directory (greatest cosine, then least path). `names` is a pattern
that a licence file's name has to match; without it any file whose whole text is a licence is one. A file without a
licence of its own takes that of the nearest directory above it that has one, found by joining each directory's
ancestors with the directories' licences.

Cases: a null text has no words, a null path is the empty one. Very long texts are read whole. Rows that repeat a path and a text get the same
result. Empty table: empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

LEAST = 0.8
#: Directories (some 100 bytes each) that may be sent to every executor.
BROADCAST_ROWS = 100_000

#: Paragraphs are numbered from here on, behind all lines.
PARAGRAPHS = 1 << 30
PARAGRAPH = r"\n[ \t\r]*\n"

# Fixed texts: licences and headers as they stand in files.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_BODY = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Fixed texts: statements by which files name their licence, and the opening paragraphs of licence texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_OPENING + _BSD_BODY + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_OPENING + _BSD_BODY + _BSD_THIRD + _BSD_WARRANTY),
    ("Apache-2.0", _APACHE_HEADER),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC-BY-4.0")),
]

SEPARATORS = r"[\x00-/:-@\[-`{-\x7f]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def _template_words(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, word, times) of the given templates."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.select("template", "license", F.explode(words(lowered(F.col("text")))).alias("word"))
    return rows.groupBy("template", "license", "word").agg(F.count("*").alias("times"))


def _weights(files: DataFrame, templates: DataFrame) -> tuple[list[tuple[int, str, str, int, float]], float]:
    """Every template word with its weight, and the weight of unseen words; counts are over all files."""
    vocabulary = templates.select("word").distinct()
    known = F.array(*[F.lit(r["word"]) for r in vocabulary.orderBy("word").collect()])
    seen = files.select(F.explode(F.array_intersect(F.split("text", SEPARATORS), known)).alias("word"))
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = files.count()
    weigh = lambda n: math.log((1 + total) / (1 + n)) + 1
    return [(r["template"], r["license"], r["word"], r["times"], weigh(counts.get(r["word"], 0))) for r in templates.collect()], weigh(0)


def _anchors(weights: list[tuple[int, str, str, int, float]], least: float) -> list[str]:
    """Words of which a text must have one to come to the least cosine with any template."""
    found: set[str] = set()
    for k in sorted({w[0] for w in weights}):
        own = sorted((idf, (times * idf) ** 2, word) for t, _, word, times, idf in weights if t == k)  # the rarest ones last
        total = rest = sum(x for _, x, _ in own)
        while math.sqrt(max(0.0, rest / total)) >= least - 1e-6:
            _, x, word = own.pop()
            rest -= x
            found.add(word)
    return sorted(found)


def _any(text: Column, anchors: list[str]) -> Column:
    """Whether a lowered text has one of the anchors as a word."""
    inside = r"[0-9a-z\x{80}-\x{10FFFF}]"
    return text.rlike(f"(?<!{inside})(?:{'|'.join(anchors)})(?!{inside})")


def _could(text: Column, weights: dict[str, float], unseen: float, least: float) -> Column:
    """Whether a text can come to the least cosine at all, from the words outside the vocabulary.

    With V the weights of the vocabulary's words, each as often as it stands there, and n the number of other
    words, the vocabulary's share of the squared length is at most (sum V)^2 / ((sum V)^2 + n * unseen^2).
    """
    lookup = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    found = F.aggregate(
        words(text), F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("n")),
        lambda acc, w: F.struct((acc["v"] + F.coalesce(F.try_element_at(lookup, w), F.lit(0.0))).alias("v"), (acc["n"] + F.when(F.map_contains_key(lookup, w), 0).otherwise(1)).alias("n")),
    )
    square = found["v"] * found["v"]
    return square >= (least - 1e-6) ** 2 * (square + found["n"] * unseen * unseen)


def scored(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(path, mark, seg, cosine, license) of each candidate of files(path, mark, text) with a licence; seg -1: whole text."""
    spark = files.sparkSession
    own = _template_words(spark, templates)
    weights, unseen = _weights(files, own)
    anchors = _anchors(weights, least)
    length = {k: math.sqrt(sum((w[3] * w[4]) ** 2 for w in weights if w[0] == k)) for k in {w[0] for w in weights}}
    idf = spark.createDataFrame(sorted({(w[2], w[4]) for w in weights}), "word string, idf double")
    vectors = spark.createDataFrame([(k, name, word, times * x / length[k]) for k, name, word, times, x in weights], "template int, license string, word string, weight double")

    hit = written(files.where(_any(F.col("text"), anchors)), "license-hits")
    lines = hit.select("path", "mark", F.posexplode(F.split("text", "\n")).alias("seg", "part")).where(_any(F.col("part"), anchors))
    blocks = hit.where(F.col("text").rlike(PARAGRAPH)).select("path", "mark", F.posexplode(F.split("text", PARAGRAPH)).alias("seg", "part")).where(F.contains("part", F.lit("\n")) & _any(F.col("part"), anchors))
    longer = hit.select("path", "mark", F.lit(-1).alias("seg"), F.col("text").alias("part")).unionByName(blocks.withColumn("seg", F.col("seg") + PARAGRAPHS))
    parts = lines.unionByName(longer.where(_could(F.col("part"), {w[2]: w[4] for w in weights}, unseen, least))).distinct()
    found = parts.select("path", "mark", "seg", F.explode(words(F.col("part"))).alias("word"))
    counted = found.groupBy("path", "mark", "seg", "word").agg(F.count("*").alias("times"))
    weighed = counted.join(F.broadcast(idf), "word", "left").withColumn("x", F.col("times") * F.coalesce("idf", F.lit(unseen)))
    norms = weighed.groupBy("path", "mark", "seg").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.where("idf is not null").join(F.broadcast(vectors), "word").groupBy("path", "mark", "seg", "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    cosines = dots.join(norms, ["path", "mark", "seg"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least)
    best = cosines.groupBy("path", "mark", "seg").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("best"))
    return best.select("path", "mark", "seg", (-F.col("best.less")).alias("cosine"), F.col("best.license").alias("license"))


def directory(path: Column) -> Column:
    """What stands before the last `/`; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def inherited(directories: DataFrame, holders: DataFrame) -> DataFrame:
    """(dir, from_dir, license, distance) of directories(dir) with a holder(dir, license) at or above them."""
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), "/").alias("at"), k.alias("depth")))
    ladder = directories.select("dir", F.size(steps).alias("deep"), F.explode(above).alias("a"))
    # an absolute path's first step is empty like the root itself: the deeper of the two counts
    ladder = ladder.select("dir", "deep", F.col("a.at").alias("at"), F.col("a.depth").alias("depth"))
    met = ladder.join(holders.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(F.max(F.struct("depth", "at", "license", (F.col("deep") - F.col("depth")).alias("distance"))).alias("near"))
    return met.select("dir", F.col("near.at").alias("from_dir"), F.col("near.license").alias("license"), F.col("near.distance").alias("distance"))


def scan(files: DataFrame, id_col: str, path: Column, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, names: str | None = None) -> DataFrame:
    """(id_col, path, license, how, cosine, from_dir, distance) for every row.

    how: `file` for a licence file, `header` for a licence in a line or paragraph, `inherited` from from_dir; null if none.
    """
    rows = files.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), lowered(F.col(text_col)).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    found = scored(rows.select("path", "mark", "text"), templates, least)
    own = found.groupBy("path", "mark").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "seg", "license")).alias("own"))
    own = own.select("path", "mark", F.col("own.license").alias("license"), F.when(F.col("own.seg") < 0, "file").otherwise("header").alias("how"), (-F.col("own.less")).alias("cosine"))
    holding = found.where("seg < 0") if names is None else found.where((F.col("seg") < 0) & F.regexp_extract("path", r"[^/]*$", 0).rlike(names))
    whole = holding.groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("less"), "path", "license")).alias("one"))
    holders = whole.select("dir", F.col("one.license").alias("license"))
    named = rows.select("id", "path", "mark", directory(F.col("path")).alias("dir"))
    given = written(inherited(named.select("dir").distinct(), holders).withColumnRenamed("license", "given"), "directories", 8)
    if given.count() <= BROADCAST_ROWS:  # else the join shuffles, and a directory of many files is split
        given = F.broadcast(given)
    joined = named.join(own, ["path", "mark"], "left").join(given, "dir", "left")
    free = F.col("license").isNull()
    return joined.select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "given").alias("license"),
        F.coalesce("how", F.when(F.col("given").isNotNull(), "inherited")).alias("how"), "cosine",
        F.when(free, F.col("from_dir")).alias("from_dir"), F.when(free, F.col("distance")).alias("distance"),
    )
