"""Line dedup by a deletion-neighbourhood join: of lines within one edit of each other the earliest stays.

A line is a stretch between line feeds, compared without blanks around it; blank lines always stay. Equal lines are
one class, whose place is its earliest occurrence (smallest id, then smallest line number). A class is dropped if a
class with an earlier place lies within one edit: one character inserted, deleted or replaced or, where one of the two
lines has at least `words` words, one word. Each class that stays is kept at its earliest occurrence and removed
everywhere else. `least_chars` (off: 0) compares lines for equality only where both are shorter.

Join. Two sequences within one edit agree on the first or on the last half of their characters (or words), so lines
first meet by hashes of their halves. What met meets again by the hash of all but one of 8 segments, and only then all
deletions inside the open segment are emitted as hashed keys, which sums over the sequence give in linear time: equal
keys at one position are replacements, and a deletion that equals another whole line is an insertion. Links are
verified on the texts. Every step groups by keys or joins on them; a group never gathers in one place, as a shared key
only links its members to the earliest one. Only hashes and places are shuffled, texts only of lines that met, and the
documents once at the end.

Cases: a null text has no lines and stays null. Rows with a null id come before all others. Rows that repeat an id
and a text count as one document; of equal places there is only one. Very long lines cost time and keys in proportion
to their length. Empty table: empty result. Other columns stay as they are, whatever their names; `n_lines` and
`n_dropped` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, fresh, limit_batches, written

#: Words from which on a changed word counts as one edit.
WORDS = 8
SEGMENTS = 8
#: Keys of 8 bytes, or lines' places, that may be sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Rows that a Python worker hands over at once.
BATCH = 20_000

_AROUND = " \t\r\x0b\x0c"
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


# sequences


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(base: int, n: int) -> np.ndarray:
    """At least the first n + 1 powers modulo 2^64."""
    return _powers(base, 1 << max(10, (n + 1).bit_length()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _elements(line: str, unit: int) -> np.ndarray:
    """One number for each character (unit 0) or word (unit 1)."""
    if unit:
        return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in line.split()], np.uint64)
    return _mixed(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))


def _sums(line: str, unit: int) -> np.ndarray:
    """Sums of the first 0, 1, 2 ... elements, each times its power."""
    x = _elements(line, unit)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _power(_BASE, len(x))[: len(x)], dtype=np.uint64)])


def _units(line: str, words: int, least_chars: int) -> list[int]:
    """The units in which a line can be within one edit of another one."""
    return [0] * (len(line) + 1 >= least_chars) + [1] * (len(line.split()) + 1 >= words)


@lru_cache(1 << 12)
def _classes(n: int) -> list[int]:
    """Least lengths of the length classes in which a sequence of n elements meets others: its own class and, where
    that begins with n, the one below, so that n and n + 1 always share one."""
    step = 1 << max(0, n.bit_length() - 3)
    own = n - n % step
    if n > own or n == 0:
        return [own]
    return [own, _classes(n - 1)[0]]


def half_keys(line: str, words: int = WORDS, least_chars: int = 0) -> list[int]:
    """Hashes of the first and last half, for each unit and length class; signed."""
    out = []
    if len(line) + 1 >= least_chars:
        for c in _classes(len(line)):
            h = c >> 1
            out.append(_hash(line[:h], c << 2))
            out.append(_hash(line[len(line) - h :], (c << 2) + 1))
    parts = line.split()
    if len(parts) + 1 >= words:
        for c in _classes(len(parts)):
            h = c >> 1
            out.append(_hash(" ".join(parts[:h]), (c << 2) + 2))
            out.append(_hash(" ".join(parts[len(parts) - h :]), (c << 2) + 3))
    return out


def _hash(text: str, seed: int) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)
    return x - (1 << 64) if x >> 63 else x


def _segments(line: str, words: int, least_chars: int) -> list[tuple[int, int, np.ndarray, list[int], list[tuple[int, int]]]]:
    """(unit, length of the longer line of a pair, sums, keys, open stretches) of a line without one of SEGMENTS segments."""
    out = []
    for unit in _units(line, words, least_chars):
        p = _sums(line, unit)
        n = len(p) - 1
        behind = (p[n] - p) * _power(_BACK, n)[: n + 1]  # of what follows the first k elements, as if nothing stood before
        for longer in (n, n + 1):
            edges = [longer * i // SEGMENTS for i in range(SEGMENTS + 1)]
            keys, stretches = [], []
            for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
                high = n - (longer - high)
                if high < low:
                    continue
                key = np.array([p[low], behind[high], (longer << 5) + (i << 1) + unit], np.uint64)
                keys.append(xxhash.xxh64_intdigest(key.tobytes()))
                stretches.append((low, high))
            out.append((unit, longer, p, np.array(keys, np.uint64).view(np.int64).tolist(), stretches))
    return out


def segment_keys(line: str, words: int = WORDS, least_chars: int = 0) -> list[int]:
    return [k for *_, keys, _ in _segments(line, words, least_chars) for k in keys]


#: Kinds of variants: deletions that stand for replacements, deletions of a longer line, whole shorter lines.
SAME, LONG, SHORT = 0, 1, 2


def variants(line: str, met: set[int], words: int = WORDS, least_chars: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, keys) of all deletions inside the segments whose keys met, and of the whole line."""
    kinds, found = [], []
    for unit, longer, p, keys, stretches in _segments(line, words, least_chars):
        n = len(p) - 1
        own = [s for k, s in zip(keys, stretches, strict=True) if k in met]
        if not own:
            continue
        tag = np.uint64(unit)
        if longer > n:
            kinds.append(np.array([SHORT], np.int32))
            found.append(_mixed(p[n:] + tag))
            continue
        at = np.concatenate([np.arange(low, high) for low, high in own])
        gone = p[at] + (p[n] - p[at + 1]) * np.uint64(_BACK)
        kinds += [np.full(len(at), SAME, np.int32), np.full(len(at), LONG, np.int32)]
        found += [_mixed(_mixed(gone + tag) + at.astype(np.uint64) * np.uint64(_BASE) + np.uint64(n)), _mixed(gone + tag)]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(kinds), np.concatenate(found).view(np.int64)


def _one_edit(a: str | list[str], b: str | list[str]) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    x, y = (a[low + 1 :], b[low + 1 :]) if len(a) == len(b) else (a[low + 1 :], b[low:]) if len(a) > len(b) else (a[low:], b[low + 1 :])
    return x == y


def near(a: str, b: str, words: int = WORDS, least_chars: int = 0) -> bool:
    """Whether two lines are within one edit."""
    if max(len(a), len(b)) >= least_chars and _one_edit(a, b):
        return True
    x, y = a.split(), b.split()
    return max(len(x), len(y)) >= words and _one_edit(x, y)


# tables


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text); mark tells texts of one id apart."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def _scan(rows: DataFrame, words: int, least_chars: int) -> DataFrame:
    """(id, mark, at, h1, h2, keys) of every line that isn't blank; keys: its half_keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, h1, h2, keys = [], [], [], [], []

            def close() -> pa.RecordBatch:
                places = pa.array(row, pa.int64())
                hashes = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), pa.array(at, pa.int32()), *hashes, pa.array(keys, pa.list_(pa.int64()))], names=["id", "mark", "at", "h1", "h2", "keys"])

            for k, text in enumerate(batch.column(2).to_pylist()):
                for n, line in enumerate(text.split("\n") if text else ()):
                    line = line.strip(_AROUND)
                    if not line:
                        continue
                    raw = line.encode("utf-8", "surrogatepass")
                    row.append(k)
                    at.append(n)
                    h1.append(xxhash.xxh64_intdigest(raw, 1))
                    h2.append(xxhash.xxh64_intdigest(raw, 2))
                    keys.append(half_keys(line, words, least_chars))
                    if len(h1) >= BATCH:
                        yield close()
                        row, at, h1, h2, keys = [], [], [], [], []
            yield close()

    long = T.LongType()
    kinds = [("id", rows.schema["id"].dataType), ("mark", long), ("at", T.IntegerType()), ("h1", long), ("h2", long), ("keys", T.ArrayType(long))]
    return rows.mapInArrow(freed(run), T.StructType([T.StructField(n, t) for n, t in kinds]))


def _met(keyed: DataFrame) -> DataFrame:
    """Keys of keyed(key, h1) that different lines share."""
    return keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")


def _sent(df: DataFrame, name: str) -> DataFrame:
    df = written(df, name, 4)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts(rows: DataFrame, near_lines: DataFrame) -> DataFrame:
    """(h1, h2, place, line) of near_lines(h1, h2, place), read from the documents at these places."""
    wanted = near_lines.groupBy(F.col("place.id").alias("__id"), F.col("place.mark").alias("__mark")).agg(F.collect_list(F.struct("h1", "h2", "place")).alias("wanted"))
    wanted = written(wanted, "line-places", 4)
    if (wanted.agg(F.sum(F.size("wanted")).alias("n")).first()["n"] or 0) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = rows.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    each = found.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    each = each.select("w.h1", "w.h2", "w.place", F.btrim(F.element_at("lines", F.col("w.place.at") + 1), F.lit(_AROUND)).alias("line"))
    return each.groupBy("h1", "h2").agg(F.first("place").alias("place"), F.first("line").alias("line"))


def _keyed(lines: DataFrame, words: int, least_chars: int) -> DataFrame:
    """(key, h1, h2) by segments of lines(h1, h2, place, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [segment_keys(x, words, least_chars) for x in batch.column(2).to_pylist()]
            place = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.int64()), batch.column(0).take(place), batch.column(1).take(place)], names=["key", "h1", "h2"])

    return lines.select("h1", "h2", "line").mapInArrow(freed(run), "key bigint, h1 bigint, h2 bigint")


def _varied(lines: DataFrame, words: int, least_chars: int) -> DataFrame:
    """(h1, h2, kind, variant) of lines(h1, h2, line, met)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (line, met) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                kinds, keys = variants(line, set(met), words, least_chars)
                for begin in range(0, len(keys), BATCH):
                    part = slice(begin, begin + BATCH)
                    place = pa.array(np.full(len(keys[part]), k))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(kinds[part]), pa.array(keys[part])], names=["h1", "h2", "kind", "variant"])

    return lines.select("h1", "h2", "line", "met").mapInArrow(freed(run), "h1 bigint, h2 bigint, kind int, variant bigint").distinct()


def _verified(pairs: DataFrame, lines: DataFrame, words: int, least_chars: int) -> DataFrame:
    """(h1, h2) of the late lines of pairs(l1, l2, e1, e2) that are within one edit of the early one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = [near(a, b, words, least_chars) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(hold, pa.bool_()))

    texts = lines.select("h1", "h2", "line")
    both = pairs.join(texts.toDF("l1", "l2", "late"), ["l1", "l2"]).join(texts.toDF("e1", "e2", "early"), ["e1", "e2"])
    return both.select(F.col("l1").alias("h1"), F.col("l2").alias("h2"), "late", "early").mapInArrow(freed(run), "h1 bigint, h2 bigint").distinct()


def _links(rows: DataFrame, classes: DataFrame, words: int, least_chars: int) -> DataFrame:
    """(h1, h2) of the classes that have an earlier one within one edit."""
    keyed = classes.select(F.explode("keys").alias("key"), "h1", "h2")
    some = keyed.join(_sent(_met(keyed.select("key", "h1")), "halves"), "key", "left_semi").select("h1", "h2").distinct()
    lines = written(_texts(rows, classes.drop("keys").join(some, ["h1", "h2"])), "near-lines", 4)

    parts = _keyed(lines, words, least_chars)
    met = parts.join(_met(parts.select("key", "h1")), "key").groupBy("h1", "h2").agg(F.collect_set("key").alias("met"))
    varied = _varied(lines.join(met, ["h1", "h2"]), words, least_chars).join(lines.select("h1", "h2", "place"), ["h1", "h2"])
    varied = written(varied.select("kind", "variant", F.struct("place", "h1", "h2").alias("own")), "variants", 4)

    same = varied.where(F.col("kind") == SAME)
    early = same.groupBy("variant").agg(F.min("own").alias("early"), F.count("*").alias("n")).where("n > 1")
    replaced = same.join(early, "variant").where("own <> early").select(F.col("own").alias("late"), "early")
    long = varied.where(F.col("kind") == LONG).select("variant", F.col("own").alias("long"))
    short = varied.where(F.col("kind") == SHORT).select("variant", F.col("own").alias("short"))
    inserted = long.join(short, "variant").select(F.greatest("short", "long").alias("late"), F.least("short", "long").alias("early"))
    pairs = replaced.union(inserted).select("late.h1", "late.h2", "early.h1", "early.h2").toDF("l1", "l2", "e1", "e2").distinct()
    return _verified(pairs, lines, words, least_chars)


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least_chars: int = 0) -> DataFrame:
    """(id, mark, kept): the numbers of the lines that stay, of each document that keeps any."""
    rows = _rows(docs, id_col, text_col)
    classes = written(_scan(rows, words, least_chars).groupBy("h1", "h2").agg(F.min(F.struct("id", "mark", "at")).alias("place"), F.first("keys").alias("keys")), "line-classes", 4)
    stay = classes.drop("keys").join(_links(rows, classes, words, least_chars), ["h1", "h2"], "left_anti")
    return stay.groupBy(F.col("place.id").alias("id"), F.col("place.mark").alias("mark")).agg(F.collect_list("place.at").alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least_chars: int = 0) -> DataFrame:
    """docs with only the lines that stay in text_col, and `n_lines` and `n_dropped`: lines that aren't blank, and those removed."""
    limit_batches(docs.sparkSession)
    rest = docs.drop("n_lines", "n_dropped")
    mark, own_id, own_mark, numbers = fresh(rest.columns, "mark", "id", "of", "kept")
    kept = kept_lines(docs, id_col, text_col, words, least_chars).toDF(own_id, own_mark, numbers)
    rows = rest.withColumn(mark, F.xxhash64(text_col)).join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_mark)), "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in rest.columns], numbers)
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, held in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text is None:
                    texts.append(None)
                    total.append(0)
                    gone.append(0)
                    continue
                stay, lines = set(held or ()), text.split("\n")
                full = [bool(x.strip(_AROUND)) for x in lines]
                out = [x for k, x in enumerate(lines) if k in stay or not full[k]]
                texts.append("\n".join(out))
                total.append(sum(full))
                gone.append(len(lines) - len(out))
            cols = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int32()), pa.array(gone, pa.int32())], names=[*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return rows.mapInArrow(freed(run), T.StructType([*rest.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_dropped", T.IntegerType())]))
