"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary logistic classifier on hashed byte n-grams predicts
whether the text's codeword has it. Decoding sums, for every language, the logistic loss of its bits against the
classifiers' margins, weighted by each classifier's accuracy on training rows; the nearest codeword wins, and a
text whose two nearest codewords are about as far is flagged as ambiguous.

Training takes about `per_language` distinct documents of each language at most (a documented bound: the smallest hashes
of their ids; rows that repeat a text count once) and the `languages` most frequent languages at most (a documented
bound, too; far more labels are dirt); documents are read whole, and the counts are over all of them. Prediction reads
whole texts only, of any length, and other columns of any name stay. Ties of loss go to the first language by name.

Cases: a null text, or one without a letter, is `und` with score 0 and is not ambiguous. Without labelled
documents every text is `und`. With one language that language is predicted with score 1. A null id is never
trained on and counts as not held out. Empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, limit_batches

BINS_LOG2 = 12
PER_LANGUAGE = 500
LANGUAGES = 256
UNDETERMINED = "und"
#: Below this lead of the nearest codeword over the second, as a share of the second's loss, a text is ambiguous.
AMBIGUOUS = 0.05

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters lower-cased; digits, signs and white space to one blank; other bytes as they are.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 1-, 2- and 3-grams; zeros for a text without bytes."""
    raw = b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "
    bins = 1 << BINS_LOG2
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    pair = b[:-1] << 8 | b[1:]
    grams = [b, pair + 256, (pair[:-1] << 8 | b[2:]) + 65792]
    shift = np.uint32(32 - BINS_LOG2)
    count = sum(np.bincount((g * np.uint32(2654435761)) >> shift, minlength=bins) for g in grams)
    return np.sqrt(count / max(1, count.sum())).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1 as rows: all splits of the languages for up to 5, else far-apart pseudo-random rows."""
    if n <= 1:
        return np.ones((n, 0), np.float32)
    if n <= 5:
        cols = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(cols, np.float32).T
    bits, rng = 8 * int(np.ceil(np.log2(n))), np.random.default_rng(7)
    best, apart = None, -1
    for _ in range(200):
        code = np.where(rng.random((n, bits)) < 0.5, -1, 1)
        gram = code @ code.T
        low = int((bits - gram[~np.eye(n, dtype=bool)]).min()) if (np.abs(code.sum(0)) < n).all() else -1
        if low > apart:
            best, apart = code, low
    return best.astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # bins x bits
    bias: np.ndarray
    trust: np.ndarray  # each bit's weight in the decoding

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Texts x languages: the weighted logistic loss to each codeword."""
        margin = x @ self.weight + self.bias
        return np.stack([(np.logaddexp(0, -margin * row) * self.trust).sum(1) for row in self.code], 1)

    def decode(self, x: np.ndarray) -> list[tuple[str, float, bool]]:
        """(language, score from 0 to 1, ambiguous) of each row of features."""
        if len(self.languages) == 0:
            return [(UNDETERMINED, 0.0, False)] * len(x)
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0, False)] * len(x)
        loss = self.losses(x)
        order = np.argsort(loss, axis=1, kind="stable")
        near, next_ = (np.take_along_axis(loss, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
        share = np.exp(-(loss - near[:, None]))
        score = 1 / share.sum(1)
        lead = (next_ - near) / np.maximum(next_, 1e-12)
        return [(self.languages[o], float(s), bool(a < AMBIGUOUS)) for o, s, a in zip(order[:, 0], score, lead, strict=True)]


def fit(x: np.ndarray, labels: list[str], rounds: int = 250, rate: float = 4.0, decay: float = 1e-5) -> Model:
    """Train all bits' classifiers at once by full-batch gradient descent with momentum, classes weighted alike."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    bits = code.shape[1]
    if not bits:
        return Model(languages, code, np.zeros((x.shape[1], 0), np.float32), np.zeros(0), np.zeros(0))
    y = np.array([languages.index(v) for v in labels])
    target = code[y]
    share = (1 / np.bincount(y))[y][:, None]
    share = (share / share.sum()).astype(np.float32)
    w, c = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    vw, vc = np.zeros_like(w), np.zeros_like(c)
    for _ in range(rounds):
        margin = x @ w + c
        g = -target / (1 + np.exp(np.clip(target * margin, -30, 30))) * share
        vw = 0.9 * vw - rate * (x.T @ g + decay * w)
        vc = 0.9 * vc - rate * g.sum(0)
        w, c = w + vw, c + vc
    right = ((np.sign(x @ w + c) == target) * share).sum(0)
    right = np.clip(right, 0.5, 1 - 1e-3)
    return Model(languages, code, w, c, np.log(right / (1 - right)) / np.log((1 - 1e-3) / 1e-3))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, languages: int = LANGUAGES) -> DataFrame:
    """(lang, text) of at most about per_language labelled training documents of each language.

    A document is taken if the hash of its id is under its language's rate, a number from the counts of all; so
    no language's rows meet in one task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("id is not null and lang is not null and text is not null").where(~held_out(F.col("id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 30, round((1 << 30) * per_language / r["n"]))) for r in counts], "lang string, rate bigint")
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    taken = rows.join(F.broadcast(rates), "lang").where(place < F.col("rate"))  # at most `languages` rates
    return taken.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit a model on the labelled rows of docs that aren't held out."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [(v, features(t).astype(np.float16).tobytes()) for v, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in x], pa.string()), pa.array([f for _, f in x], pa.binary())], names=["lang", "x"])

    rows = sample(docs, id_col, text_col, lang_col, per_language).mapInArrow(freed(run), "lang string, x binary").collect()
    if not rows:
        return Model([], np.zeros((0, 0)), np.zeros((1 << BINS_LOG2, 0)), np.zeros(0), np.zeros(0))
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    return fit(x, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous; all its columns stay (those three names are replaced)."""
    spark = docs.sparkSession
    limit_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score", "ambiguous")
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _decided(shared.value, batch.column(at).to_pylist())
            cols = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return rest.mapInArrow(freed(run), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, ambiguous) for every row of docs, by a model learned from docs."""
    model = train(docs, id_col, text_col, lang_col)
    rows = predict(docs.select(id_col, F.col(text_col).alias("text")), model)
    return rows.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is found: neither undetermined nor ambiguous."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _decided(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and not vague for lang, _, vague in found], pa.bool_()))

    return docs.mapInArrow(freed(run), docs.schema)


def _decided(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, False)] * len(texts)
    known = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
    for begin in range(0, len(known), 64):
        part = known[begin : begin + 64]
        for k, found in zip(part, model.decode(np.stack([features(texts[k]) for k in part])), strict=True):
            out[k] = found
    return out
