"""Quality classifier from weak labels.

Labellers. Overlapping heuristics look at a whole text and vote good, bad or nothing.
Label model. Expectation-maximisation over the counts of all documents' vote patterns (at most 3 to the power of the
number of labellers, whatever the corpus) estimates each labeller's accuracies and the share of good documents; every
pattern gets its posterior.
Scorer. A logistic model on hashed byte n-grams and binned statistics is trained on posteriors of at most
`sample` documents (a documented bound: the smallest hashes, alike from the patterns that look good and bad), and
scores every whole document, however long.

Cases: null and empty texts have score 0 and aren't kept. If all patterns agree on one side, that side's share
serves as every score. Ids may be null or repeat. Empty table: empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches

SAMPLE = 4000
BINS_LOG2 = 12
KEEP = 0.5

_BREAK = re.compile(rb"[.!?:;\"')\]]\s*$")
_SIGNS = frozenset(b"#$%&*+<=>@\\^_`{|}~")


def _class(codes: object) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_NOISE, _UPPER, _BLANK, _MARK = _class(_SIGNS), _class(range(65, 91)), _class(b" \t\n\r\x0b\x0c"), _class(b"!?")
_LETTER = _class([*range(65, 91), *range(97, 123), *range(128, 256)])

#: For each kind of poor text more than one labeller looks, each in its own way.
LABELLERS = ["noise", "noisy_words", "letters", "sign_words", "capitals", "capital_words", "exclaiming", "variety", "top_word", "deflated", "word_length", "line_ends", "size"]


def statistics(raw: bytes) -> tuple[float, ...]:
    """What the labellers look at, in their order: shares of noise signs, noisy words and so on, and the number of words."""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = max(1, len(words))
    seen = Counter(words)
    noisy = signs = capital = 0
    for w, k in seen.items():
        if w[-1] in _SIGNS:
            noisy += k
            if not w.strip(b"#$%&*+<=>@\\^_`{|}~"):
                signs += k
        if len(w) > 1 and w.isupper():
            capital += k
    full = max(1, len(raw) - int(count[_BLANK].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ended = sum(1 for x in lines if _BREAK.search(x[-8:]))
    return (
        count[_NOISE].sum() / full, noisy / n, count[_LETTER].sum() / full, signs / n, count[_UPPER].sum() / max(1, count[_LETTER].sum()), capital / n,
        count[_MARK].sum() / n, len(seen) / n**0.7, max(seen.values(), default=0) / n, len(zlib.compress(raw, 1)) / max(1, len(raw)), full / n, ended / max(1, len(lines)), float(len(words)),
    )


def votes(stats: tuple[float, ...]) -> str:
    """One sign for each labeller: `+` good, `-` bad, `0` nothing."""
    noise, noisy, letters, signs, capitals, capital, marks, variety, top, deflated, length, ended, n = stats
    long = n >= 20
    return "".join((
        "-" if noise > 0.03 else "+" if noise < 0.01 else "0",
        "-" if noisy > 0.1 else "+" if noisy < 0.03 else "0",
        "-" if letters < 0.75 else "+" if letters > 0.9 else "0",
        "-" if signs > 0.05 else "+" if signs < 0.01 else "0",
        "-" if capitals > 0.4 else "+" if capitals < 0.2 else "0",
        "-" if capital > 0.3 else "+" if capital < 0.1 else "0",
        "-" if marks > 0.3 else "+" if marks < 0.1 else "0",
        "0" if not long else "-" if variety < 0.6 else "+" if variety > 1.2 else "0",
        "0" if not long else "-" if top > 0.3 else "+" if top < 0.15 else "0",
        "0" if not long else "-" if deflated < 0.2 else "+" if deflated > 0.35 else "0",
        "-" if length < 2 or length > 16 else "+" if 3 < length < 11 else "0",
        "0" if not long else "+" if ended > 0.5 else "-" if ended < 0.1 else "0",
        "-" if n < 2 else "+" if n > 50 else "0",
    ))


@dataclass(frozen=True)
class LabelModel:
    good: float  # the share of good documents
    chances: np.ndarray  # labellers x classes (bad, good) x votes (-, 0, +); no vote says nothing: 1

    def posteriors(self, vote: np.ndarray) -> np.ndarray:
        """The probabilities that documents with these votes (patterns x labellers, 0 to 2) are good."""
        logs = np.log(self.chances)[np.arange(vote.shape[1]), :, vote].sum(1) + np.log([1 - self.good, self.good])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def posterior(self, pattern: str) -> float:
        """The probability that a document with these votes is good."""
        return float(self.posteriors(_votes([pattern]))[0])


def _votes(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(v) for v in p] for p in patterns])


def fit_labels(counts: dict[str, int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation from the balance of votes; order of patterns and rows doesn't matter."""
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    vote = _votes(patterns)
    one = np.eye(3)[vote]  # patterns x labellers x votes
    q = np.where((vote == 0).sum(1) >= 2, 0.05, 0.95)  # two bad votes: bad, to begin with
    for _ in range(rounds):
        both = np.stack([(1 - q) * weight, q * weight], 1)
        chances = np.einsum("pc,plv->lcv", both, one) + 0.5
        chances /= chances[:, :, [0, 2]].sum(2, keepdims=True)
        chances[:, :, 1] = 1
        good = float(np.clip(both[:, 1].sum() / weight.sum(), 1e-3, 1 - 1e-3))
        model = LabelModel(good, chances)
        after = model.posteriors(vote)
        if np.abs(after - q).max() < 1e-9:
            break
        q = after
    return model


def features(raw: bytes, stats: tuple[float, ...]) -> np.ndarray:
    """Hashed byte 1- to 3-grams (square roots of shares) and bins of the statistics."""
    bins = 1 << BINS_LOG2
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    pair = b[:-1] << 8 | b[1:]
    shift = np.uint32(32 - BINS_LOG2)
    count = np.zeros(bins)
    for g in (b, pair + 256, (pair[:-1] << 8 | b[2:]) + 65792):
        count += np.bincount((g * np.uint32(2654435761)) >> shift, minlength=bins)
    x = np.zeros(bins + 16 * len(LABELLERS), np.float32)
    x[:bins] = np.sqrt(count / max(1, count.sum()))
    scale = (32, 16, 16, 16, 16, 16, 8, 5, 16, 16, 1, 16, 0)  # 0: by powers of two
    for k, v in enumerate(stats):
        level = min(15, int(v * scale[k])) if scale[k] else min(15, int(np.log2(1 + v)))
        x[bins + 16 * k + level] = 0.5
    return x


@dataclass(frozen=True)
class Scorer:
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 4.0, decay: float = 1e-5) -> Scorer:
    """Logistic regression on posteriors; both sides weigh the same."""
    side = np.where(y >= 0.5, 0.5 / max(1e-9, (y >= 0.5).sum()), 0.5 / max(1e-9, (y < 0.5).sum())).astype(np.float32)
    w, c, vw, vc = np.zeros(x.shape[1], np.float32), 0.0, 0.0, 0.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(x @ w + c, -30, 30))) - y) * side
        vw = 0.9 * vw - rate * (x.T @ g + decay * w)
        vc = 0.9 * vc - rate * float(g.sum())
        w, c = w + vw, c + vc
    return Scorer(w, c)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def voted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, votes) of every row."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(statistics(_raw(t))) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "votes"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, votes string")


def label_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel | None, dict[str, int]]:
    """The label model of all documents with text, and the counts of their vote patterns."""
    full = docs.where(F.length(text_col) > 0)
    counts = {r["votes"]: r["n"] for r in voted(full, id_col, text_col).groupBy("votes").agg(F.count("*").alias("n")).collect()}
    return (fit_labels(counts) if counts else None), counts


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[LabelModel | None, Scorer]:
    """Both models from docs."""
    model, counts = label_model(docs, id_col, text_col)
    size = (1 << BINS_LOG2) + 16 * len(LABELLERS)
    if model is None:
        return None, Scorer(np.zeros(size, np.float32), 0.0)
    posterior = dict(zip(counts, model.posteriors(_votes(list(counts))).tolist(), strict=True))
    many = {side: sum(n for p, n in counts.items() if (posterior[p] >= 0.5) == side) for side in (True, False)}
    rate = {side: min(1.0, sample / 2 / max(1, n)) for side, n in many.items()}
    if not all(many.values()):
        share = float(np.clip(sum(posterior[p] * n for p, n in counts.items()) / sum(counts.values()), 0.01, 0.99))
        return model, Scorer(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    top = max(rate.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = _raw(text)
                stats = statistics(raw)
                y = posterior.get(votes(stats), 0.5)
                if place < rate[y >= 0.5]:
                    out.append((place, y, features(raw, stats).astype(np.float16).tobytes()))
            cols = [pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["place", "y", "x"])

    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.where(F.length(text_col) > 0).select(place.alias("place"), F.col(text_col).alias("text")).where(F.col("place") < top)
    rows = rows.groupBy("place").agg(F.first("text").alias("text"))  # rows that repeat an id and a text count once
    found = rows.mapInArrow(run, "place double, y double, x binary").collect()
    found.sort(key=lambda r: (r["place"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32) if found else np.zeros((0, size), np.float32)
    return model, fit_scorer(x, np.array([r["y"] for r in found], np.float32))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """(id_col, quality from 0 to 1, keep, votes, posterior) of every row; posterior is the label model's."""
    spark = docs.sparkSession
    limit_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs, id_col, text_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, scorer = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score, signs, chance = np.zeros(len(texts)), [], []
            for k, text in enumerate(texts):
                raw = _raw(text)
                stats = statistics(raw)
                signs.append(votes(stats))
                chance.append(labels.posterior(signs[-1]) if raw and labels else 0.0)
                if raw:
                    score[k] = scorer.score(features(raw, stats)[None, :])[0]
            cols = [pa.array(score), pa.array(score >= keep), pa.array(signs, pa.string()), pa.array(chance, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "quality", "keep", "votes", "posterior"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, quality double, keep boolean, votes string, posterior double")
