"""SentencePiece encoding and decoding with a given byte-fallback BPE model, giant documents by a parallel scan.

Exactness. A sequence of pieces is the model's encoding if and only if every two neighbours are the encoding of
their own concatenation (merges are ranked by the merged piece). So an encoding is a path over piece occurrences
(begin, end) with a weight of 0 for neighbours that hold together and minus infinity for others: a max-plus
problem whose best path is unique. No piece holds a blank behind another character, so a path always has a
boundary in front of each blank run (a sync point); between sync points the library's encoder gives the pieces.

Scan. A document over one chunk (CHUNK characters) is cut into chunks at fixed places. Each chunk yields the transfer matrix
from the occurrences that reach over its left border to those that reach over its right one; the document's
matrices are combined associatively in a balanced tree; going down the tree fixes every border's occurrence, and
each chunk is backtraced by itself. Only the stretch between a border and the next sync point needs the matrix
work. Documents of one chunk need no scan: their only borders are their ends, so they are encoded in one piece.
A document's key is made of hashes of its id and text, so a task that runs again cuts the same chunks; rows that repeat
both are scanned once.

Cases: a null text has null ids and null text; an empty one has no ids. U+2581 decodes to a blank, as in the
library; any other text comes back as it was. Ids may be null or repeat. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, limit_batches, shuffle_width, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 14

BLANK = "▁"

#: An occurrence: where it begins and ends, from a border on.
State = tuple[int, int]
#: The borders of a document.
START: State = (-1, 0)
#: right state -> the left states from which it is reached.
Matrix = dict[State, frozenset[State]]


class Pieces:
    """A SentencePiece BPE model, with the library's results and the neighbour test of the scan."""

    def __init__(self, path: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.sp
        self.score = {sp.id_to_piece(k): (sp.get_score(k), k) for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))}
        self.longest = max(map(len, self.score))
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.line = "\n" in "".join(p for p in self.score if len(p) > 1)
        self.blank = [self.score[BLANK][1]] if BLANK in self.score else [self.byte[b] for b in BLANK.encode()]
        self.pair = lru_cache(1 << 18)(self._pair)
        self.whole = lru_cache(1 << 16)(self._whole)

    # whole texts

    def encode(self, text: str) -> list[int]:
        """The library's ids of a text."""
        return self.sp.encode(text, num_threads=1)

    def _spans(self, normal: str) -> list[int]:
        """The ids of normalised text that begins and ends at sync points."""
        if normal == BLANK:
            return list(self.blank)
        if normal[0] == BLANK:  # the library puts a blank in front
            return self.sp.encode(normal[1:].replace(BLANK, " "), num_threads=1)
        return self.sp.encode("\n" + normal.replace(BLANK, " "), num_threads=1)[len(self.blank) + len(self.ids("\n")) :]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids, num_threads=1)

    # the scan

    def merge(self, text: str) -> list[str]:
        """BPE of a short text by its definition: the best-ranked, leftmost merge first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.score.get(parts[k] + parts[k + 1])
                if found and (best is None or found[0] > best):
                    best, at = found[0], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _whole(self, piece: str) -> bool:
        return len(piece) == 1 or piece in self.score and len(self.merge(piece)) == 1

    def _pair(self, a: str, b: str) -> bool:
        return self.merge(a + b) == [a, b]

    def sync(self, text: str, at: int) -> bool:
        """Whether every path has a boundary at this place of normalised text."""
        return 0 < at < len(text) and (text[at] == BLANK and text[at - 1] != BLANK or not self.line and "\n" in (text[at], text[at - 1]))

    def ids(self, parts: Iterable[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            found = self.score.get(p)
            out += [found[1]] if found else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def walk(self, text: str, ends: dict[int, dict[int, frozenset]], begin: int, stop: int) -> None:
        """Extend ends (end -> begin of an occurrence -> its origins) by all occurrences that begin in [begin, stop)."""
        for b in range(begin, stop):
            before = ends.get(b)
            if not before:
                continue
            for c in range(b + 1, min(b + self.longest, len(text)) + 1):
                piece = text[b:c]
                if not self.whole(piece):
                    continue
                origins = frozenset().union(*(o for a, o in before.items() if a is None or a < 0 and b == 0 or self.pair(text[a:b], piece)))
                if origins:
                    ends.setdefault(c, {})[b] = origins

    def syncs(self, text: str, s: int, e: int) -> tuple[int, int] | None:
        """The first and last sync point in [s, e]."""
        first = next((k for k in range(s, e + 1) if self.sync(text, k)), None)
        if first is None:
            return None
        return first, next(k for k in range(e, s - 1, -1) if self.sync(text, k))

    def transfer(self, text: str, s: int, e: int) -> Matrix:
        """The matrix of the chunk [s, e) of text; text holds `longest` characters of either neighbour."""
        ends: dict[int, dict] = {}
        if s == 0:
            ends[0] = {-1: frozenset([START])}
        for a in range(max(0, s - self.longest), s):
            for b in range(s, min(a + self.longest, len(text)) + 1):
                if self.whole(text[a:b]):
                    ends.setdefault(b, {})[a] = frozenset([(a - s, b - s)])
        if span := self.syncs(text, s, e):
            self.walk(text, ends, s, span[0])
            origins = frozenset().union(*ends.get(span[0], {}).values())
            if span[1] == e:  # the last piece before a sync point needs no name
                return {(-1, 0): origins} if origins else {}
            ends = {span[1]: {None: origins}}
            self.walk(text, ends, span[1], e)
        else:
            self.walk(text, ends, s, e)
        return {(a - e, c - e): o for c, x in ends.items() if c >= e for a, o in x.items() if a is not None and a < e}

    def backtrace(self, text: str, s: int, e: int, left: State, right: State) -> list[int]:
        """The ids of the pieces that begin in [s, e), between the occurrences at the two borders."""
        a, b = left[0] + s, left[1] + s
        if span := self.syncs(text, s, e):
            first, last = span
            head = self._path(text, {b: {a: frozenset([(a, b)])}}, b, first, first) if b < first else []
            middle = self._spans(text[first:last]) if last > first else []
            tail = [] if last == e else self._path(text, {last: {None: frozenset([(last, last)])}}, last, e, right[1] + e, right[0] + e)
            return self.ids(head) + middle + self.ids(tail)
        return self.ids(self._path(text, {b: {a: frozenset([(a, b)])}}, b, e, right[1] + e, right[0] + e)) if b < e else []

    def _path(self, text: str, ends: dict, begin: int, stop: int, end: int, at: int | None = None) -> list[str]:
        known = {(a, c) for c, x in ends.items() for a in x}
        self.walk(text, ends, begin, stop)
        if at is None:  # at a sync point any last piece will do; from one left state there is one path only
            at = next(iter(ends[end]))
        out: list[str] = []
        while (at, end) not in known:
            piece = text[at:end]
            out.append(piece)
            end, at = at, next(a for a in ends[at] if a is None or a < 0 and at == 0 or (a, at) in known and a < begin and self.pair(text[a:at], piece) or self.pair(text[a:at], piece))
        return out[::-1]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of two neighbouring stretches; associative."""
    out = {}
    for right, mids in b.items():
        origins = frozenset().union(*(a[m] for m in mids if m in a))
        if origins:
            out[right] = origins
    return out


def borders(matrices: list[Matrix]) -> list[State]:
    """The occurrence at every border of a document, first to last, by a balanced tree of combined matrices.

    The last one is the only one that ends with the document and is reached from its start.
    """

    def build(lo: int, hi: int) -> tuple:
        if hi - lo == 1:
            return (matrices[lo],)
        mid = (lo + hi) // 2
        x, y = build(lo, mid), build(mid, hi)
        return combine(x[0], y[0]), x, y

    out = [START]

    def descend(node: tuple, left: State, right: State) -> None:
        if len(node) == 1:
            out.append(right)
            return
        _, x, y = node
        middle = min(m for m in y[0][right] if m in x[0] and left in x[0][m])
        descend(x, left, middle)
        descend(y, middle, right)

    root = build(0, len(matrices))
    descend(root, START, next(x for x, origins in root[0].items() if x[1] == 0 and START in origins))
    return out


@lru_cache(2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def encode_giant(model: Pieces, text: str, chunk: int = CHUNK) -> list[int]:
    """The scan on one machine; for tests and for callers without Spark."""
    normal = BLANK + text.replace(" ", BLANK)
    cuts = [*range(0, len(normal), chunk), len(normal)]
    parts = [_window(normal, s, e, model.longest) for s, e in zip(cuts, cuts[1:], strict=False)]
    matrices = [model.transfer(*p) for p in parts]
    states = borders(matrices)
    return [k for p, a, b in zip(parts, states, states[1:], strict=False) for k in model.backtrace(*p, a, b)]


def _window(normal: str, s: int, e: int, reach: int) -> tuple[str, int, int]:
    low = max(0, s - reach)
    return normal[low : e + reach], s - low, e - low


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(id_col, ids ARRAY<INT>) for every row. The model's path must be readable on every executor."""
    return _ordinary(docs, id_col, text_col, model, False, chunk).unionByName(_giants(docs, id_col, text_col, model, chunk))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """decode(encode(docs)), ordinary documents in one pass through Python: half the workers, and ids cross once."""
    return _ordinary(docs, id_col, text_col, model, True, chunk).unionByName(decode(_giants(docs, id_col, text_col, model, chunk), id_col, model))


def _small(chunk: int) -> Column:
    return F.col("text").isNull() | (F.length("text") <= chunk)


def _ordinary(docs: DataFrame, id_col: str, text_col: str, model: str, back: bool, chunk: int) -> DataFrame:
    limit_batches(docs.sparkSession)
    rows = docs.select(id_col, F.col(text_col).alias("text"))
    names = [id_col, "ids", *["text"] * back]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for batch in batches:
            ids = [None if t is None else own.encode(t) for t in batch.column(1).to_pylist()]
            texts = [pa.array([None if x is None else own.decode(x) for x in ids], pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), *texts], names=names)

    return rows.where(_small(chunk)).mapInArrow(freed(plain), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids array<int>" + ", text string" * back)


def _giants(docs: DataFrame, id_col: str, text_col: str, model: str, chunk: int) -> DataFrame:
    """(id_col, ids) of the documents over one chunk, by the scan."""
    spark = docs.sparkSession
    limit_batches(spark)
    hashed = [F.xxhash64(F.lit(k), F.col(id_col).cast("string"), F.col(text_col)).cast("string") for k in (0, 1)]
    rows = docs.select(F.concat_ws(":", *hashed).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~_small(chunk))
    kind = rows.schema["id"].dataType.simpleString()
    longest = loaded(model).longest

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(2).to_pylist()):
                normal = BLANK + text.replace(" ", BLANK)
                for n, s in enumerate(range(0, len(normal), chunk)):
                    part, low, high = _window(normal, s, min(s + chunk, len(normal)), longest)
                    cols = [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([n], pa.int32()), pa.array([part]), pa.array([low], pa.int32()), pa.array([high], pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "chunk", "part", "low", "high"])

    shape = f"key string, id {kind}, chunk int, part string, low int, high int"
    width = shuffle_width(spark)
    chunks = written(rows.mapInArrow(freed(split), shape).repartition(width, "key", "chunk").dropDuplicates(["key", "chunk"]), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for batch in batches:
            found = []
            for part, low, high in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                m = own.transfer(part, low, high)
                found.append([[*right, *left] for right in sorted(m) for left in sorted(m[right])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["key", "chunk", "matrix"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        found: list[Matrix] = []
        for entries in pdf["matrix"]:
            m: dict[State, set[State]] = {}
            for r0, r1, l0, l1 in entries:
                m.setdefault((int(r0), int(r1)), set()).add((int(l0), int(l1)))
            found.append({k: frozenset(v) for k, v in m.items()})
        states = borders(found)
        return pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "border": [[*a, *b] for a, b in zip(states, states[1:], strict=False)]})

    states = chunks.select("key", "chunk", "part", "low", "high").mapInArrow(freed(matrices), "key string, chunk int, matrix array<array<int>>").repartition(width, "key").groupBy("key").applyInPandas(choose, "key string, chunk int, border array<int>")

    def backtraced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for batch in batches:
            ids = [own.backtrace(part, low, high, tuple(b[:2]), tuple(b[2:])) for part, low, high, b in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int32()))], names=["key", "id", "chunk", "ids"])

    joined = chunks.join(states, ["key", "chunk"]).select("key", "id", "chunk", "part", "low", "high", "border")
    traced = joined.mapInArrow(freed(backtraced), f"key string, id {kind}, chunk int, ids array<int>")
    whole = traced.groupBy("key").agg(F.first("id").alias("id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    again = rows.groupBy("key").agg(F.count("*").alias("times"))
    every = whole.join(again, "key").select("id", "ids", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return every.select(F.col("id").alias(id_col), "ids")


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The lists of a column of numbers; much faster than value by value."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for k, known in enumerate(column.is_valid().to_pylist()):
        yield values[ends[k] : ends[k + 1]].tolist() if known else None


def decode(encoded: DataFrame, id_col: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(id_col, ids, text): the text that the ids stand for."""
    limit_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in _lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    rows = encoded.select(id_col, "ids")
    return rows.mapInArrow(freed(run), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids array<int>, text string")
