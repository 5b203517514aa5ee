"""Quality classifier: naive Bayes support vectors.

A record is the set of its n-gram indicators: words, and runs of one to three
word shapes (case pattern plus punctuation) and repetition patterns, hashed into fixed spaces.  Each
indicator is scaled by its class log-count ratio r; a linear hinge-loss model is
fitted on the scaled indicators by dual coordinate descent, and the score is
the logistic of four times its margin (labels lie beyond margins of 1 and -1).

The model is fitted in one task on at most ``sample`` labelled records, those
with the smallest hash of their id, chosen before any text is read; ``sample``
bounds that task whatever the table's size.  Every record is then scored whole.

Defined results: a null or empty text has no indicators and gets the logistic
of the intercept's margin; very long texts and words are read whole; without labels of both classes, as in
empty tables, every score is 0.5, and a score of 0.5 is predicted 1; repeated
rows score alike; a labelled id that occurs more than once counts once, with its largest label and smallest
text; rows without id or label teach nothing; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import hold, keep_rows, per_document, slices

WORD_BITS, SHAPE_BITS = 18, 17
LAGS = 4
#: Words, shapes, and repetition patterns have numbers of their own, in this order.
DIM = (1 << WORD_BITS) + (1 << SHAPE_BITS) + LAGS
#: Words that a worker remembers, and the longest of them.
_CACHE_LIMIT, _LONGEST = 200_000, 64
_MARKS = (".", ",", ";", ":")
_RUN = re.compile(r"([A-Z]+)|([a-z]+)|([0-9]+)|([^A-Za-z0-9])\4*")


def shape(word: str) -> str:
    """Case and punctuation pattern: ``THE!!`` is ``AA!!``, ``Thnd,`` is ``Aa,``."""
    # most words are plain, with one mark at most
    core, mark = (word[:-1], word[-1]) if word[-1:] in _MARKS else (word, "")
    if core.isalpha():
        if core.islower():
            return "a" + mark
        if core[0].isupper() and core[1:].islower():
            return "Aa" + mark
    return long_shape(word)


def long_shape(word: str) -> str:
    """The pattern of any word, run by run; a run counts as one, two or more capitals, as letters, digits, or up to three marks."""
    out = []
    for run in _RUN.finditer(word):
        text = run[0]
        if run[1]:
            out.append("A" if len(text) == 1 else "AA")
        elif run[2]:
            out.append("a")
        elif run[3]:
            out.append("0")
        elif text[0].isalpha():
            out.append("A" if text[0].isupper() else "a")
        else:
            out.append(text[0] * min(len(text), 3))
    kept = [x for i, x in enumerate(out) if not i or x != out[i - 1]]
    return "".join(kept)


class Indicators:
    """Texts to sorted arrays of distinct indicator numbers; remembers words within a bound.

    A word is one integer: its number in the high half, its shape's hash in the low half.
    """

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, np.int64)
        found = list(map(self.known.get, words))
        if None in found:
            new = {w for w, x in zip(words, found, strict=True) if x is None}
            if len(self.known) + len(new) > _CACHE_LIMIT:
                # common words come early, so the oldest ones stay
                kept = list(islice(self.known.items(), _CACHE_LIMIT // 4))
                self.known.clear()
                self.known.update(kept)
            fresh = {w: self.one(w) for w in new}
            if len(self.known) + len(fresh) <= _CACHE_LIMIT:
                self.known |= {w: x for w, x in fresh.items() if len(w) <= _LONGEST}
            found = [fresh[w] if x is None else x for w, x in zip(words, found, strict=True)]
        packed = np.array(found, np.int64)
        return self.combined(np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1))

    @staticmethod
    def one(word: str) -> int:
        number = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
        return number << 32 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass"))

    @staticmethod
    def combined(ids: np.ndarray) -> np.ndarray:
        s = ids[:, 1].astype(np.uint64)
        grams = [s * np.uint64(0x9E3779B97F4A7C15)]
        for n, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            if len(s) > n:
                grams.append((grams[-1][:-1] ^ (s[n:] + np.uint64(n))) * np.uint64(odd))
        shapes = np.concatenate(grams) >> np.uint64(64 - SHAPE_BITS)
        return np.unique(np.concatenate([ids[:, 0], shapes.astype(np.int64) + (1 << WORD_BITS), repeats(ids[:, 0])]))


def repeats(words: np.ndarray, lags: int = LAGS, run: int = 3) -> np.ndarray:
    """Indicators of ``run`` words in a row that equal the word 1 to ``lags`` places before."""
    found = []
    for lag in range(1, lags + 1):
        same = np.concatenate([[0], np.cumsum(words[lag:] == words[:-lag])])
        if (same[run:] - same[:-run] == run).any():
            found.append(DIM - lag)
    return np.array(found, np.int64)


#: Shared by the tasks of a worker process.
INDICATORS = Indicators()


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 0.1, passes: int = 20, alpha: float = 1.0, seed: int = 7):
    """Weights of the hinge-loss model (the last is the intercept) and the log-count ratios."""
    w = np.zeros(DIM + 1)
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(rows) or y.min() == y.max():
        return w, np.zeros(DIM)
    n_rows = [np.zeros(DIM), np.zeros(DIM)]
    for x, label in zip(rows, labels, strict=True):
        n_rows[int(label > 0)][x] += 1
    p, q = n_rows[1] + alpha, n_rows[0] + alpha
    ratio = np.log(p / (labels > 0).sum()) - np.log(q / (labels <= 0).sum())
    seen = n_rows[0] + n_rows[1] >= 2
    ratio[~seen] = 0.0
    values = [ratio[x] for x in rows]
    # rare classes weigh as much as common ones
    upper = np.where(y > 0, c * len(y) / (2 * (y > 0).sum()), c * len(y) / (2 * (y < 0).sum()))
    # unit length: long records do not outweigh short ones
    values = [v / max(np.sqrt(v @ v), 1e-12) for v in values]
    dual, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(passes):
        largest = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + w[-1]) - 1.0
            new = min(max(dual[i] - g / 2.0, 0.0), upper[i])
            if (step := (new - dual[i]) * y[i]) != 0.0:
                w[x] += step * v
                w[-1] += step
                dual[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w, ratio


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 12_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> bytes:
    """Fit on at most ``sample`` labelled records; the packed model has a fixed size."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull())
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most ``sample`` ids and labels are broadcast
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, keys, found, marks = Indicators(), [], [], []
        for batch in batches:
            for part in slices(batch, "text"):
                keys += part.column("id").to_pylist()
                marks += part.column("label").to_pylist()
                found += [indicators(t or "").astype(np.int32) for t in part.column("text").to_pylist()]
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        weights, ratio = fit([found[i] for i in order], np.array([marks[i] for i in order]))
        packed = np.concatenate([weights[:-1], ratio, weights[-1:]]).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(model, "model binary").first()
    return bytes(made[0]) if made else bytes(4 * (2 * DIM + 1))


def score_texts(texts: list[str], weights: np.ndarray, ratio: np.ndarray, bias: float, indicators: Indicators) -> list[float]:
    scores = []
    for t in texts:
        x = indicators(t)
        r = ratio[x]
        norm = np.sqrt(float(r @ r)) or 1.0
        margin = float(weights[x] @ r) / norm + bias
        scores.append(float(1.0 / (1.0 + np.exp(-np.clip(4.0 * margin, -500, 500)))))
    return scores


def _scorer(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str):
    """A function from texts to scores, with the trained model broadcast (a fixed size)."""
    packed = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col, text_col, label_col))

    def score(texts: list[str]) -> list[float]:
        hold("quality", INDICATORS.known.clear)
        flat = np.frombuffer(packed.value, "<f4")
        return score_texts(texts, flat[:DIM], flat[DIM:-1], float(flat[-1]), INDICATORS)

    return score


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 12_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """One row per record: id, score, predicted; trained on the given labels."""
    score = _scorer(docs, labels, sample, id_col, text_col, label_col)

    def run(texts: list[str]) -> dict[str, list]:
        scores = score(texts)
        return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return per_document(docs, id_col, text_col, "score double, predicted int", run)


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 12_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """The records that the classifier accepts (score 0.5 or more), with all their columns."""
    score = _scorer(docs, labels, sample, id_col, text_col, label_col)

    def accepted(texts: list[str]) -> list[bool]:
        return [s >= 0.5 for s in score(texts)]

    return keep_rows(docs, text_col, accepted)


def held_out(id_col: str = "doc_id"):
    """True for ids that training never sees: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
