"""SimHash near-dedup: fingerprints of word shingles, compared within banded buckets by bit-sliced counters.

Fixed choices: words are runs of bytes other than 0x20 and 0x09-0x0D after A-Z were lower-cased, shingles have
`width` words joined by a space (the whole sequence if there are fewer), a shingle hashes to XXH64 with seed 42,
a fingerprint bit is 1 if set in over half the hashes. No words: fingerprint zero.

Cases: a null text counts as an empty one. Repeated rows stay repeated. An empty table gives an empty result.
A null id takes part in its group and never names it, unless the group has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, shuffle_width, written
from .graph import components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: A bucket with more distinct fingerprints than this is dealt again by finer keys.
BUCKET = 512
#: Fingerprints of many rows (some 30 bytes each) that are sent to every executor at most.
BROADCAST_ROWS = 100_000
#: Lanes of one bit-sliced block.
LANES = 1 << 14

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    parts = [words[k:] for k in range(min(width, len(words)))]
    n = len(words) - len(parts) + 1
    joined = map(b" ".join, zip(*parts, strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)
    rows = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id_col, fp BIGINT: the fingerprint's bits) for every row."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    rows = docs.select(id_col, F.col(text_col).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def sliced_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of all pairs of one group whose fingerprints differ in at most radius bits.

    group must be sorted. The fingerprints are stored as 64 vertical bit planes, 64 lanes to a machine word. For
    a shift d, lane i compares with lane i + d: each differing plane is added to all lanes' distances at once by a
    ripple of carry-save counters, and a block is left as soon as every lane in it is over the radius.
    """
    n, width = len(fps), (radius + 4).bit_length()  # a live lane is at most at radius + 4 when next looked at
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for begin in range(0, n, LANES):
        lanes = min(LANES, n - begin)
        last = begin + lanes
        reach = int(np.searchsorted(group, group[last - 1], "right")) - 1  # the last partner of any lane here
        spread = int((np.searchsorted(group, group[begin:last], "right") - np.arange(begin, last)).max())
        if spread < 2:
            continue
        words = (lanes + 63) // 64
        held = words + spread // 64 + 2
        bits = np.zeros((held * 64, 8), np.uint8)
        bits[: reach - begin + 1] = fps[begin : reach + 1].view(np.uint8).reshape(-1, 8)
        planes = np.packbits(np.unpackbits(bits, axis=1, bitorder="little").T.copy(), axis=1, bitorder="little").view(np.uint64)
        varying = [b for b in range(64) if (x := planes[b]).any() and not _constant(x, reach - begin + 1)]
        for d in range(1, spread):
            same = np.zeros(words * 64, bool)
            k = min(lanes, n - begin - d)
            same[:k] = group[begin : begin + k] == group[begin + d : begin + d + k]
            live = np.packbits(same, bitorder="little").view(np.uint64)
            q, r = divmod(d, 64)
            counters = [np.zeros(words, np.uint64) for _ in range(width)]
            for turn, b in enumerate(varying):
                row = planes[b]
                moved = row[q : q + words] >> np.uint64(r)
                if r:
                    moved = moved | row[q + 1 : q + 1 + words] << np.uint64(64 - r)
                carry = (row[:words] ^ moved) & live
                for c in counters:
                    c ^= carry  # c becomes the sum bit, ~c & carry the carry bit
                    carry = carry & ~c
                if turn % 4 == 3 or turn == len(varying) - 1:
                    live = live & ~_over(counters, radius)
                    if not live.any():
                        break
            if live.any():
                hit = np.flatnonzero(np.unpackbits(live.view(np.uint8), bitorder="little"))
                left.append(begin + hit)
                right.append(begin + hit + d)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _constant(plane: np.ndarray, n: int) -> bool:
    full = np.unpackbits(plane.view(np.uint8), bitorder="little")[:n]
    return bool(full.all())


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius: a bitwise comparison from the highest bit."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


def _keys(level: int, radius: int) -> list[int]:
    """Masks of one level: of (radius + 2) * 2^level blocks all but radius are equal in any linked pair."""
    n = (radius + 2) * 2**level
    edges = [round(64 * k / n) for k in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(blocks) - sum(left) for left in combinations(blocks, radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucketed(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """rows(fp) with one row for each mask of the level: (mask number, masked bits)."""
    masks = F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x)).cast("bigint")).alias("v")) for k, x in enumerate(_keys(level, radius))])
    return rows.select("fp", F.explode(masks).alias("key")).select("fp", F.col("key.m").alias("m"), F.col("key.v").alias("v"))


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) distinct pairs of different fingerprints of classes(fp, distinct) that differ in at most radius bits.

    Any pair within the radius agrees on all but `radius` of radius + 2 blocks of bits, so it meets in a bucket of
    one of the masks. Buckets over the limit are dealt again by masks of twice as many blocks, where a pair again
    meets; at the last level all buckets are compared, whatever their size.
    """
    spark = classes.sparkSession
    rows, found, level = classes.select("fp"), [], 0
    while True:
        keyed = _bucketed(rows, level, radius)
        sizes = keyed.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1")
        met = written(keyed.join(sizes, ["m", "v"]), f"buckets{level}", 4)
        last = level == 2 or met.where(F.col("n") > bucket).isEmpty()
        small = met if last else met.where(F.col("n") <= bucket)
        found.append(_compare(small, radius, shuffle_width(spark)))
        if last:
            break
        rows, level = met.where(F.col("n") > bucket).select("fp").distinct(), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _compare(met: DataFrame, radius: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            m, v, fp = (np.concatenate([p[k] for p in parts]) for k in range(3))
            change = np.r_[True, (m[1:] != m[:-1]) | (v[1:] != v[:-1])]
            i, j = sliced_pairs(fp.view(np.uint64), np.cumsum(change), radius)
            a, b = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            m, v, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(m):
                continue
            # what belongs to the last key of this batch may go on in the next one
            tail = int(np.flatnonzero((m != m[-1]) | (v != v[-1]))[-1]) + 1 if (m[0], v[0]) != (m[-1], v[-1]) else 0
            if tail:
                yield close([*kept, (m[:tail], v[:tail], fp[:tail])])
                kept = []
            kept.append((m[tail:], v[tail:], fp[tail:]))
        if kept:
            yield close(kept)

    dealt = met.select("m", "v", "fp").repartition(width, "m", "v").sortWithinPartitions("m", "v", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(id_col, fingerprint: 16 lower-case hex digits, component_id: the smallest id reachable) for every row.

    Rows with equal fingerprints are one class; classes link at `radius` or fewer differing bits.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "prints")
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "classes", 4)
    label = components(links(classes, radius))
    least = label.join(classes, label.node == classes.fp).groupBy("label").agg(F.min("first").alias("low"))
    moved = label.join(least, "label").select(F.col("node").alias("fp"), "low")
    named = written(classes.join(moved, "fp", "left").select("fp", "n", F.coalesce("low", "first").alias("component_id")), "named", 4)
    # at most BROADCAST_ROWS fingerprints can have more rows than this: they are sent to every executor, the others shuffle
    often = max(100, (classes.agg(F.sum("n").alias("n")).first()["n"] or 0) // BROADCAST_ROWS)
    hot, rest = F.broadcast(named.where(F.col("n") > often)), named.where(F.col("n") <= often)
    found = prints.join(hot, "fp").unionByName(prints.join(hot, "fp", "left_anti").join(rest, "fp"))
    return found.select(id_col, hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that name their group: one for each component. Rows without an id are kept as they are.

    Repeated rows of one id count once, one of them stays. The ids that go are few beside the texts: they are sent
    to the texts while their number allows, else the anti-join shuffles.
    """
    found = written(near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width, radius).select(id_col, "component_id"), "groups", 4)
    gone, _ = _sent(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    twice, repeated = _sent(found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "twice")
    rest = docs.join(gone, id_col, "left_anti")
    if repeated:
        rest = rest.join(twice, id_col, "left_anti").unionByName(rest.join(twice, id_col, "left_semi").dropDuplicates([id_col]))
    return rest.select(docs.columns)


def _sent(ids: DataFrame, name: str) -> tuple[DataFrame, int]:
    """ids written, to be broadcast if they are few, and their number."""
    ids = written(ids, name, 4)
    n = ids.count()
    return (F.broadcast(ids) if n <= BROADCAST_ROWS else ids), n
