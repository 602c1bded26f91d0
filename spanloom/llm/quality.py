"""Ordinal cumulative-link regression on graded ratings with hashed text features.

One weight per hashed feature is shared by all grades; ordered thresholds cut the score, so that
``P(grade >= k) = logistic(score - threshold_k)``. It gives the expected grade and the chance of
each grade or better. Fitted with an L1 penalty by accelerated proximal steps on a bounded sample
of rated documents (TRAIN_ROWS, those with the least hashes of their ids); applied to every document.

Features: each distinct word, its first letters, and bins of a document's shape (signs, capitals,
repetition). Grades of the table ``labels``: 0 toxic, 1 harmless but of low quality, 2 good and clean.
Toxic is the lowest grade, since how many such words a text has varies most: the end of the scale is
open, while a grade in the middle would have to hold both few and many of them.

Defined cases: a null or empty text has its shape features only; a document rated twice counts with
its worst ratings; rows without an id or a rating don't train; without ratings everything has the
top grade; repeated rows get equal results.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import forget_encoders, slices
from .common import read_texts

#: Rated documents that the fit uses at most.
TRAIN_ROWS = 12_000
#: Hashed features.
WIDTH = 1 << 19
#: Weight of the L1 penalty, as a share of a row.
PENALTY = 2.0
STEPS = 150
#: A document stays if its chance of the top grade is at least this.
LEAST_CHANCE = 0.5
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_WORDS_HELD = 300_000


def _place(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


class Features(dict):
    """Places of a token's features; holds the tokens met last."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        core = token.lower().strip(_MARKS)
        names = [core] + [f"^{core[:k]}" for k in (5, 7) if len(core) > k] if core else []
        if len(self) >= _WORDS_HELD:
            self.clear()
        found = tuple(map(_place, names))
        if len(token) <= 60:
            self[token] = found
        return found

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        kinds = set(tokens)
        places: set[int] = set()
        for token in kinds:
            places.update(self[token])
        n, k = max(1, len(tokens)), max(1, len(kinds))
        signs = sum(1 for t in kinds if t[-1] in "#$%&*!|@~^=<>") / k
        capitals = sum(map(str.isupper, kinds)) / k
        size = min(12, int(math.log2(n + 1)))
        shape = [f"=signs{int(10 * signs + 0.5)}", f"=caps{int(10 * capitals + 0.5)}", f"=kinds{size}:{int(10 * len(kinds) / n)}", f"=bars{min(3, tokens.count('|'))}"]
        places.update(map(_place, shape))
        return np.fromiter(places, np.int32, len(places))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., by row."""
        return _logistic(scores[:, None] - self.thresholds)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(places: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, penalty: float = PENALTY, steps: int = STEPS) -> OrdinalModel:
    """Least penalised log loss. Grades 0 .. n_grades - 1; without rows every grade but the top is ruled out."""
    if not len(places):
        return OrdinalModel(np.zeros(WIDTH, np.float32), np.full(n_grades - 1, -20.0) + np.arange(n_grades - 1))
    n = len(places)
    sizes = np.array([len(p) for p in places])
    used, columns = np.unique(np.concatenate(places), return_inverse=True)
    rows = np.repeat(np.arange(n), sizes)
    share = [(np.sum(grades >= k) + 0.5) / (n + 1) for k in range(1, n_grades)]
    theta = np.array([math.log((1 - s) / s) for s in share])
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(len(theta)))
    w, ahead, t = np.zeros(len(used)), np.zeros(len(used)), 1.0
    # the loss bends by at most a quarter a row; steps by column, as rare words are seen seldom
    rate = 1.0 / np.maximum(0.25 * np.bincount(columns, sizes[rows].astype(float) ** 0.5), 1e-9)
    inf = np.inf
    for _ in range(steps):
        score = np.bincount(rows, ahead[columns], n)
        cuts = np.concatenate([[-inf], theta, [inf]])
        above, below = _logistic(score - cuts[grades]), _logistic(score - cuts[grades + 1])
        pull = -(1 - above - below)  # of the log loss by the score, whichever the grade
        grad = np.bincount(columns, pull[rows], len(used))
        new = ahead - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
        gap = np.maximum(above - below, 1e-12)
        for k in range(len(theta)):
            slope = np.where(grades == k + 1, above * (1 - above) / gap, 0) - np.where(grades == k, below * (1 - below) / gap, 0)
            theta[k] -= np.clip(2.0 * slope.sum() / n, -0.2, 0.2)
        theta = np.maximum.accumulate(theta + 1e-6 * np.arange(len(theta)))
    weights = np.zeros(WIDTH, np.float32)
    weights[used] = w
    return OrdinalModel(weights, theta)


def grades_of(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 toxic, 1 harmless but of low quality, 2 good and clean; the worst of several ratings."""
    rated = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").dropna()
    return rated.groupBy("doc_id").agg(
        F.when(F.max("toxic") > 0, 0).when(F.min("quality") <= 0, 1).otherwise(2).alias("grade")
    )


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on at most ``most`` rated documents; the sample's ids (no more than that) are broadcast."""
    sample = grades_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        features = Features()
        for batch in batches:
            found = [features.of(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "places"])

    joined = read_texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "grade")
    rows = joined.mapInArrow(run, "doc_id long, grade int, places array<int>").dropDuplicates(["doc_id"]).toArrow()
    places = [np.asarray(p.values, np.int32) for p in rows.column("places").combine_chunks()] if rows.num_rows else []
    return fit(places, rows.column("grade").to_numpy().astype(int) if rows.num_rows else np.zeros(0, int))


_SCORED = "expected_grade double, p_harmless double, p_clean double, kept boolean"


def grade_documents(docs: DataFrame, labels: DataFrame, least: float = LEAST_CHANCE, carried: bool = False) -> DataFrame:
    """``doc_id, expected_grade, p_harmless, p_clean, kept`` for every row.

    With ``carried`` the kept rows of ``docs`` with all their columns come back instead.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def graded(texts: list[str]) -> np.ndarray:
        weights = model.value.weights
        scores = np.array([weights[held.of(t)].sum(dtype=np.float64) for t in texts])
        return model.value.tails(scores)

    held = Features()
    if carried:
        at = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_encoders()
            for batch in batches:
                for part in slices(batch):
                    if part.num_rows:
                        tails = graded([t or "" for t in part.column(at).to_pylist()])
                        yield part.filter(pa.array(tails[:, -1] >= least))

        return docs.mapInArrow(keep, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for part in slices(batch):
                if part.num_rows:
                    tails = graded(part.column(1).to_pylist())
                    columns = [part.column(0), *map(pa.array, (tails.sum(axis=1), tails[:, 0], tails[:, -1], tails[:, -1] >= least))]
                    yield pa.record_batch(columns, ["doc_id", "expected_grade", "p_harmless", "p_clean", "kept"])

    return read_texts(docs).mapInArrow(run, f"doc_id long, {_SCORED}")
