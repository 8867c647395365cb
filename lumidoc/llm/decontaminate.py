"""Benchmark decontamination by greedy string tiling.

Texts become runs of word characters, lower-cased. A document and a benchmark item that share a seed (`least`
consecutive tokens, found by a rolling Karp-Rabin hash and verified) are tiled: the longest common run of unmarked
tokens is marked in both, again and again, until none of `least` tokens is left. An item is leaked into a document
if the tiles cover at least `threshold` of its tokens, in whatever order the passages stand.

The benchmark is the stated query set: it goes through all documents in blocks of at most BLOCK_BYTES of text, each
sent to the executors, so what is sent is bounded however many items there are. Documents are never shuffled.

Cases: null and empty texts have no tokens and match nothing. Items shorter than `least` tokens are matched by a
run of all their tokens; items of fewer than `shortest` tokens only by documents that have no other tokens. Very long and repetitive texts are tiled whole: seeds go
through in blocks of PAIRS, and tiling ends once the item is covered. Equal items are judged each by itself. Ids may be null or repeat. Empty tables: no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, limit_batches

LEAST = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8_000_000
#: Tokens from which on an item can be found inside a text: one word would be found everywhere.
SHORTEST = 2
#: Pairs of equal seeds that are held at once.
PAIRS = 1 << 20

_TOKEN = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n ids, modulo 2^64."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        h = h * _BASE + (ids[k : k + len(h)].astype(np.uint64) + np.uint64(1))
    return h


class Block:
    """Benchmark items prepared for search."""

    def __init__(self, items: list[tuple], least: int, shortest: int = 1) -> None:
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple] = []  # id, token ids
        for item_id, text in items:
            words = tokens(text)
            if words:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)))
        self.short: dict[tuple[int, ...], list[int]] = {}
        for k, (_, x) in enumerate(self.items):
            if len(x) < shortest:
                self.short.setdefault(tuple(x.tolist()), []).append(k)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for _, x in self.items])]).astype(np.int64)
        self.flat = np.concatenate([np.zeros(0, np.int64), *[x for _, x in self.items]])
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by length: hash, item, place
        for n in sorted({min(least, len(x)) for _, x in self.items if len(x) >= shortest}):
            own = [k for k, (_, x) in enumerate(self.items) if len(x) >= shortest and min(least, len(x)) == n]
            found = [rolling(self.items[k][1], n) for k in own]
            h = np.concatenate(found)
            order = np.argsort(h, kind="stable")
            self.seeds[n] = (h[order], np.repeat(own, [len(f) for f in found])[order], np.concatenate([np.arange(len(f)) for f in found])[order])

    def search(self, text: str | None) -> Iterator[tuple]:
        """(item id, coverage, tiles, longest tile, tokens of the item) of each item that shares a seed with the text."""
        words = tokens(text)
        if not words or not self.items:
            return
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        for k in self.short.get(tuple(ids.tolist()), ()):
            yield self.items[k][0], 1.0, 1, len(ids), len(ids)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for n, seeds in self.seeds.items():
            if len(ids) < n:
                continue
            item, i, j, length = self._matches(ids, np.flatnonzero(known[n:] - known[:-n] == n), n, *seeds)  # runs of benchmark words only
            edges = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True]) if len(item) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                item_id, own = self.items[item[a]]
                tiles = tiled(list(zip(i[a:b].tolist(), j[a:b].tolist(), (length[a:b] + n - 1).tolist(), strict=True)), n, len(own))
                yield item_id, sum(t[2] for t in tiles) / len(own), len(tiles), max(t[2] for t in tiles), len(own)

    def _matches(self, ids: np.ndarray, full: np.ndarray, n: int, hashes: np.ndarray, items: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """Maximal matches from the seeds of n tokens at the places `full` of a text: (item, place in text, in item, seeds)."""
        h = np.zeros(len(full), np.uint64)
        for k in range(n):
            h = h * _BASE + (ids[full + k].astype(np.uint64) + np.uint64(1))
        low = np.searchsorted(hashes, h, "left")
        times = np.searchsorted(hashes, h, "right") - low
        met = np.flatnonzero(times)
        ends = np.cumsum(times[met])
        runs, begin = [tuple(np.zeros(0, np.int64) for _ in range(4))], 0
        while begin < len(met):  # whole places of the text, about PAIRS pairs at a time
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            part = met[begin:stop]
            begin = stop
            own = np.repeat(part, times[part])
            at = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
            i, item, j = full[own], items[at], places[at]
            same = np.ones(len(i), bool)
            for k in range(n):  # equal hashes are verified
                same &= ids[i + k] == self.flat[self.starts[item] + j + k]
            runs.append(_runs(item[same], i[same], j[same], np.ones(int(same.sum()), np.int64)))
        return _runs(*(np.concatenate([r[k] for r in runs]) for k in range(4)))


def _runs(item: np.ndarray, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring stretches of one item and diagonal joined: (item, first place in text, in item, seeds)."""
    order = np.lexsort((i, i - j, item))
    item, i, j, length = item[order], i[order], j[order], length[order]
    if not len(item):
        return item, i, j, length
    new = np.r_[True, (item[1:] != item[:-1]) | (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + length[:-1])]
    first = np.flatnonzero(new)
    return item[first], i[first], j[first], np.add.reduceat(length, first)


def tile(seeds: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from all common runs of n tokens (place in text, place in item)."""
    i, j = (np.array(sorted(set(seeds)), np.int64).reshape(-1, 2)[:, k] for k in (0, 1))
    _, i, j, length = _runs(np.zeros(len(i), np.int64), i, j, np.ones(len(i), np.int64))
    return tiled(list(zip(i.tolist(), j.tolist(), (length + n - 1).tolist(), strict=True)), n, max(j + length, default=0) + n - 1)


def tiled(matches: list[tuple[int, int, int]], n: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from maximal matches (place in text, place in item, length): tiles of the same shape.

    The longest match is taken first (then the first in the item, then in the text); what an earlier tile has marked
    is cut out of a match, and its parts queue again. It ends when too few of the item's `size` tokens are left.
    """
    queue = [(-length, j, i) for i, j, length in matches]
    heapq.heapify(queue)
    text_marks: set[int] = set()
    item_marks: set[int] = set()
    tiles = []
    while queue and size - len(item_marks) >= n:
        length, j, i = heapq.heappop(queue)
        free = [k for k in range(-length) if i + k not in text_marks and j + k not in item_marks]
        if len(free) == -length:
            tiles.append((i, j, -length))
            text_marks.update(range(i, i - length))
            item_marks.update(range(j, j - length))
            continue
        first = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - first >= n:
                    heapq.heappush(queue, (-(k - first), j + free[first], i + free[first]))
                first = k
    return tiles


def blocks(benchmark: DataFrame, id_col: str, text_col: str, least: int = LEAST, block_bytes: int = BLOCK_BYTES, shortest: int = SHORTEST) -> Iterator[Block]:
    """The benchmark's items in blocks of about block_bytes of text; one block is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = max(1, math.ceil(total / block_bytes))
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k)
        items = sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is not None, x[0], x[1]))
        yield Block(items, least, shortest)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(id_col, item_col, coverage, tiles, longest, item_tokens) of every document and item with that coverage."""
    spark = docs.sparkSession
    limit_batches(spark)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    names = [id_col, item_col, "coverage", "tiles", "longest", "item_tokens"]
    item_kind = benchmark.schema[item_col].dataType
    kind = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, `{item_col}` {item_kind.simpleString()}, coverage double, tiles int, longest int, item_tokens int"
    out = None
    for block in blocks(benchmark, item_col, item_text_col, least):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place, found = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    for x in shared.value.search(text):
                        if x[1] >= threshold:
                            place.append(k)
                            found.append(x)
                cols = [pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64()), *(pa.array([x[k] for x in found], pa.int32()) for k in (2, 3, 4))]
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *cols], names=names)

        part = rows.mapInArrow(freed(run), kind)
        out = part if out is None else out.union(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """The rows of docs into which no benchmark item is leaked."""
    spark = docs.sparkSession
    limit_batches(spark)
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text_col, least):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [all(x[1] < threshold for x in shared.value.search(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(freed(run), docs.schema)
    return docs
