"""Near copies by word shingles: of documents joined by a Jaccard similarity of `least` or more, the first one stays.

Words as in simhash.py. A document is the set of its shingles of `width` words (the whole sequence if there are fewer).
Documents of the same words are one class. Classes meet where all ROWS minima of one of BANDS bands agree: at
similarity s a pair meets with probability 1 - (1 - s^ROWS)^BANDS, which is 0.99997 at 0.8. Whatever is linked was
decided on the whole sets, so nothing below `least` links.

Pairs. Every pair is found by SimHash fingerprints of BITS bits, bit-sliced: fingerprints (or the differences of two)
stand as bit planes, 64 to a machine word, and the distances of all are counted at once by carry-save counters, until
all are over the radius (4 standard deviations above the mean distance at 0.8; few shingles: a wider one). In each
bucket, of two classes too, all classes are first held against a few hubs (its least and greatest class, some by other
hashes, and the one that meets the most others), which joins a family of copies at a cost in proportion to its size.
Those classes of a bucket that are then not in its largest group are held against all its classes of other groups;
what also agrees in enough of FINE minima's lowest bits (again 4 deviations) becomes a pair, in the first bucket that
has both. A bucket is dealt out in blocks of LANES classes, so no task holds more.

Cases: a null text has no words, like an empty one; texts without words are equal. A document is a row's (id, text):
rows that repeat both count once and one of them stays, while one id with different texts is several documents. The
first document of a group has the smallest id, then the smallest text hash; null ids come last. Very long texts are
read whole. Columns of any name stay as they are. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, fresh, limit_batches, shuffle_width, written
from .graph import components
from .simhash import BROADCAST_ROWS, SEED, _BITS, _LOWER, _over

SHINGLE_WORDS = 5
LEAST = 0.8
BANDS = 20
ROWS = 4
#: Bits of a fingerprint, the radius of the search, and that for sets of fewer than FEW shingles, whose distances spread more.
BITS, RADIUS, FEW, WIDE = 256, 64, 32, 100
#: Minima whose lowest bits are compared next, and how many of them may differ.
FINE, FINE_RADIUS = 1024, 145
#: Classes of a bucket that one task holds at once.
LANES = 4096
#: Classes that are held against a block at a time.
QUERIES = 64
#: Shingles whose BANDS * ROWS hashes are held at once.
BLOCK = 1024

_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor %d" % k, SEED) | 1 for k in range(FINE)], np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(words: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of all shingles, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    parts = [words[k:] for k in range(min(width, len(words)))]
    n = len(words) - len(parts) + 1
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*parts, strict=False)), repeat(SEED)), np.uint64, n))


def minima(found: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of `count` hash functions over the shingles."""
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, BLOCK * BANDS * ROWS // count)
    for k in range(0, len(found), step):
        np.minimum(low, (found[k : k + step, None] * _FACTORS[:count]).min(axis=0), out=low)
    return low


def bands(found: np.ndarray) -> list[int]:
    """One signed key for each band; none without shingles."""
    if not len(found):
        return []
    low = minima(found, BANDS * ROWS)
    return [_signed(xxhash.xxh64_intdigest(low[k : k + ROWS].tobytes(), k)) for k in range(0, BANDS * ROWS, ROWS)]


def fine(found: np.ndarray) -> bytes:
    """One bit of each of FINE minima."""
    low = minima(found, FINE)
    return np.packbits((low ^ (low >> np.uint64(17)) ^ (low >> np.uint64(40))) & np.uint64(1) != 0).tobytes()


_TURNS = np.array([xxhash.xxh64_intdigest(b"turn %d" % k, SEED) | 1 for k in range(BITS // 64)], np.uint64)


def fingerprint(found: np.ndarray) -> bytes:
    """SimHash of distinct shingle hashes: a bit is 1 if set in over half of them."""
    bits = []
    for turn in _TURNS:
        h = found * turn
        h = (h ^ (h >> np.uint64(32))) * turn
        rows = (h ^ (h >> np.uint64(29))).view(np.uint8).reshape(-1, 8)
        bits += [np.bincount(rows[:, k], minlength=256) @ _BITS * 2 > len(found) for k in range(8)]
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


class Planes:
    """Fingerprints as vertical bit planes, 64 lanes to a machine word."""

    def __init__(self, prints: list[bytes]) -> None:
        found = np.frombuffer(b"".join(prints), np.uint8).reshape(-1, BITS // 8)
        self.n = len(found)
        held = np.zeros((-(-self.n // 64) * 64, BITS // 8), np.uint8)
        held[: self.n] = found
        bits = np.unpackbits(held, axis=1, bitorder="little").T.copy()
        self.planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def near(self, queries: list[bytes], radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, lane) numbers of all within the radius; the block is left once every lane is over it."""
        shape = (len(queries), self.planes.shape[1])
        live = np.full(shape, np.iinfo(np.uint64).max, np.uint64)
        counters = [np.zeros(shape, np.uint64) for _ in range((radius + 32).bit_length())]  # a live lane is looked at every 32 planes
        ones = np.unpackbits(np.frombuffer(b"".join(queries), np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")
        flips = ones.T.astype(np.uint64) * np.iinfo(np.uint64).max
        for turn, (plane, flip) in enumerate(zip(self.planes, flips, strict=True), 1):
            carry = (plane[None, :] ^ flip[:, None]) & live
            for c in counters:
                c ^= carry  # c becomes the sum bit, ~c & carry the carry bit
                carry &= ~c
                if not carry.any():
                    break
            if turn % 32 == 0:
                live &= ~_over(counters, radius)
                if not live.any():
                    break
        return np.nonzero(np.unpackbits(live.view(np.uint8), axis=1, bitorder="little")[:, : self.n])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _class(words: list[bytes]) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED))


def _prints(rows: DataFrame, width: int) -> DataFrame:
    """(id, mark, cls, n, keys, print) of rows(id, mark, text); n: how many distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, size, keys, prints = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = _words(text)
                found = shingles(words, width)
                cls.append(_class(words))
                size.append(len(found))
                keys.append(bands(found))
                prints.append(fingerprint(found))
            cols = [batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "mark", "cls", "n", "keys", "print"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(freed(run), f"id {kind}, mark bigint, cls bigint, n bigint, keys array<bigint>, print binary")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(cls, shingles) of rows(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _words(text)
                found = pa.array([shingles(words, width).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([_class(words)], pa.int64()), found], names=["cls", "shingles"])

    return rows.select("text").mapInArrow(freed(run), "cls bigint, shingles array<bigint>")


def _fine(rows: DataFrame, width: int) -> DataFrame:
    """(cls, fine) of rows(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_class(w) for w in words], pa.int64()), pa.array([fine(shingles(w, width)) for w in words], pa.binary())], names=["cls", "fine"])

    return rows.select("text").mapInArrow(freed(run), "cls bigint, fine binary")


def _texts(needed: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows at the places of the classes needed(cls)."""
    places = written(classes.join(needed, "cls", "left_semi").select(F.col("place.id").alias("__id"), F.col("place.mark").alias("__mark")), "similar-places", 4)
    return rows.join(_sent(places), _same("id", "__id") & (F.col("mark") == F.col("__mark")), "left_semi")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _linked(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b) of those pairs(a, b) whose sets are similar; written."""
    pairs = written(pairs.distinct(), "similar-pairs", 4)
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = written(_sets(_texts(needed, classes, rows), width).dropDuplicates(["cls"]), "similar-sets", 4)
    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    return written(met.where(both >= least * (F.size("x") + F.size("y") - both)).select("a", "b"), "similar-links", 4)


def _buckets(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(band, key, cls, n, members) of all classes in buckets of two or more, and the pairs of each with its hubs."""
    keyed = classes.select("cls", "n", F.posexplode("keys").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    met = written(keyed.join(sizes, ["band", "key"]), "similar-buckets", 4)
    score = met.groupBy("cls").agg(F.sum("members").alias("score"))
    one = F.struct("cls", "n")
    picked = [F.min(one), F.max(one), *[F.max(F.struct(x.alias("by"), one.alias("one")))["one"] for x in (F.col("score"), F.xxhash64("cls", F.lit(1)), F.xxhash64("cls", F.lit(2)))]]
    hubs = met.join(score, "cls").groupBy("band", "key").agg(F.array_distinct(F.array(*picked)).alias("hubs"))
    ends = met.join(hubs, ["band", "key"]).select("cls", "n", F.explode("hubs").alias("end")).where(F.col("cls") != F.col("end.cls"))
    ends = ends.where(_could(F.col("n"), F.col("end.n"), least))
    return met, ends.select(F.least("cls", "end.cls").alias("a"), F.greatest("cls", "end.cls").alias("b"))


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of those pairs(a, b) whose fingerprints are within the radius: the differences of LANES pairs at a time as bit planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, -1) for k in (3, 4))
            few, apart = batch.column(2).to_numpy(zero_copy_only=False), one ^ two
            hold = np.zeros(n, bool)
            for at, radius in ((np.flatnonzero(few), WIDE), (np.flatnonzero(~few), RADIUS)):
                for k in range(0, len(at), LANES):
                    lanes = at[k : k + LANES]
                    hold[lanes[Planes([apart[lanes].tobytes()]).near([bytes(BITS // 8)], radius)[1]]] = True
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(hold)) for k in (0, 1)], names=["a", "b"])

    own = lambda side: classes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("print").alias(f"print_{side}"))
    both = pairs.distinct().join(own("a"), "a").join(own("b"), "b").select("a", "b", (F.least("n_a", "n_b") < FEW).alias("few"), "print_a", "print_b")
    return both.mapInArrow(freed(run), "a bigint, b bigint")


def _could(n: Column, m: Column, least: float) -> Column:
    """Whether sets of n and m shingles can be similar at all."""
    return F.least(n, m) >= F.lit(least) * F.greatest(n, m)


_DEALT = ["band", "key", "block", "query", "cls", "n", "label", "print", "fine", "keys"]


class _Block:
    """The classes of one block of a bucket, and the search among them."""

    def __init__(self, place: list[int], least: float) -> None:
        self.place, self.least, self.lanes, self.queries, self.planes = place, least, [], [], None

    def pairs(self) -> list[tuple[int, int]]:
        """What the queries gathered so far find; they are then forgotten."""
        queries, self.queries = self.queries, []
        if not queries or not self.lanes:
            return []
        if self.planes is None:
            self.planes, self.columns = Planes([x[3] for x in self.lanes]), _columns(self.lanes)
        names, sizes, labels, bits, keys = self.columns
        out: list[tuple[int, int]] = []
        for few in (False, True):
            own = [q for q in queries if (q[1] < FEW) == few]
            if not own:
                continue
            q, k = self.planes.near([x[3] for x in own], WIDE if few else RADIUS)
            name, size, label, detail, met = _columns(own)
            hold = (label[q] != labels[k]) & (np.minimum(size[q], sizes[k]) >= self.least * np.maximum(size[q], sizes[k]))
            q, k = q[hold], k[hold]
            hold = np.bitwise_count(detail[q] ^ bits[k]).sum(axis=1, dtype=np.int64) <= FINE_RADIUS
            q, k = q[hold], k[hold]
            hold = (met[q] == keys[k]).argmax(axis=1) == self.place[0]  # the first bucket that has both
            a, b = name[q[hold]], names[k[hold]]
            out += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)
        return out


def _columns(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    numbers = (np.array([x[k] for x in rows], np.int64) for k in range(3))
    return *numbers, np.frombuffer(b"".join(x[4] for x in rows), np.uint64).reshape(len(rows), -1), np.array([x[5] for x in rows], np.int64)


def _search(dealt: DataFrame, least: float) -> DataFrame:
    """(a, b) of different groups within the radius, of dealt(_DEALT) sorted by the first four; each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block([], least)
        found: list[tuple[int, int]] = []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            found = []
            for *place, query, cls, n, label, own, bits, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != block.place:
                    found += block.pairs()
                    block = _Block(place, least)
                (block.queries if query else block.lanes).append((cls, n, label, own, bits, keys))
                if len(block.queries) == QUERIES:
                    found += block.pairs()
            yield close()
        found = block.pairs()
        yield close()

    return dealt.select(_DEALT).mapInArrow(freed(run), "a bigint, b bigint")


def groups(classes: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """(node, label) of all classes that are linked with another one."""
    met, ends = _buckets(classes, least)
    first = _linked(_near(ends, classes), classes, rows, width, least)
    label = components(first)
    named = met.where("members > 2").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    parts = named.groupBy("band", "key", "label").agg(F.count("*").alias("part"))
    main = parts.groupBy("band", "key").agg(F.max(F.struct("part", "label")).alias("main"), F.sum("part").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    mixed = named.drop("members").join(main.select("band", "key", "members", F.col("main.label").alias("main")), ["band", "key"])
    mixed = written(mixed, "similar-mixed", 4)
    if mixed.isEmpty():
        return label
    detail = written(_fine(_texts(mixed.select("cls").distinct(), classes, rows), width).dropDuplicates(["cls"]), "similar-fine", 4)
    mixed = mixed.join(detail.join(classes.select("cls", "print", "keys"), "cls"), "cls")
    blocks = F.ceil(F.col("members") / LANES).cast("int")
    lane = mixed.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("query", F.lit(False))
    query = mixed.where("label <> main").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("query", F.lit(True))
    dealt = lane.unionByName(query).repartition(shuffle_width(classes.sparkSession), "band", "key", "block").sortWithinPartitions("band", "key", "block", "query")
    return components(first.union(_linked(_search(dealt, least), classes, rows, width, least)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, least: float = LEAST) -> DataFrame:
    """The rows of docs without those that are near copies of a first one, directly or through others."""
    limit_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    prints = written(_prints(rows, width), "similar-prints")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "mark")
    classes = written(prints.groupBy("cls").agg(F.min(place).alias("place"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("print").alias("print")), "similar-classes", 4)
    label = groups(classes, rows, width, least)
    named = classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").groupBy(F.coalesce("label", "cls").alias("label")).agg(F.min("place").alias("place"))
    own_mark, own_id, own_of = fresh(docs.columns, "mark", "id", "of")
    firsts = named.select(F.col("place.id").alias("__id"), F.col("place.mark").alias("__mark"))
    known = written(prints.groupBy("id", "mark").agg(F.count("*").alias("times")), "similar-known", 4)
    same = _same("id", "__id") & (F.col("mark") == F.col("__mark"))
    gone = written(known.join(firsts, same, "left_anti").select("id", "mark").toDF(own_id, own_of), "similar-gone", 4)
    twice = written(known.where("times > 1").join(firsts, same, "left_semi").select("id", "mark").toDF(own_id, own_of), "similar-twice", 4)
    match = _same(id_col, own_id) & (F.col(own_mark) == F.col(own_of))
    rest = docs.withColumn(own_mark, F.xxhash64(text_col)).join(_sent(gone), match, "left_anti")
    if not twice.isEmpty():
        again = _sent(twice)
        rest = rest.join(again, match, "left_anti").unionByName(rest.join(again, match, "left_semi").dropDuplicates([id_col, own_mark]))
    return rest.select([F.col(f"`{c}`") for c in docs.columns])
