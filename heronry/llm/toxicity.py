"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features.

Grades run from 0 (clean) to 3. One weight vector is shared by three ordered thresholds: P(grade > k) is the logistic of
w.x - t_k with t_0 < t_1 < t_2. The result is the expected grade, and P(grade > 0).

Features are words without the marks around them, and the first 4 to 7 letters of words, as these stand for stems with
any ending. Of all of them those are kept that the labelled rows tie to toxicity (chi squared, and more often in toxic
rows). A word stands for the one of its kept features that has the highest chi squared, so an unseen ending weighs as much
as one seen in learning.

The labels know toxic or not only. The grade of a toxic row is how strong the evidence for it is in rows that it isn't
learned from: the labelled rows are dealt into two halves by their id, the log odds of each feature are taken from the other
half, and the rows' sums of them are cut into thirds, grades 1 to 3. Only which features are kept is decided on all labelled
rows, the row's own label included.

Limits of learning: at most MOST_LABELLED rows with a label, those with the lowest hash of their id; the number of features
is bounded by these rows, and no feature is left out. Scoring covers all rows and whole texts.

What is defined for odd input:
- Null or empty texts have no features and get the score of a text without them. Rows with a null id are scored.
- Texts of any length are scored whole; a task holds one text and its distinct words. Equal texts get equal scores. Sums
  that tie get the same grade. An empty table gives an empty result.
- Labels that are null, and labels of unknown ids, are ignored. With no toxic or no clean labelled row there is nothing to
  learn: every row gets the share of toxic labels (0 without labels) as its probability.
- Repeated rows are scored one by one. Other columns of the input are kept or ignored, never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import quoted, written

MOST_LABELLED = 20_000
STEMS = range(4, 8)
#: A feature must stand in so many toxic rows, have this chi squared at least and this log odds ratio.
LEAST_TOXIC_ROWS, LEAST_CHI2, LEAST_LOG_ODDS = 5, 30.0, 3.5
_MARKS = ".,;:!?#*$%&|\"'()[]{}<>-_~`"


def word_features(word: str) -> tuple[int, ...]:
    """64-bit hashes of the word and of its stems."""
    bare = word.lower().strip(_MARKS)
    if not bare:
        return ()
    names = ["=" + bare] + ["^" + bare[:n] for n in STEMS if len(bare) >= n]
    return tuple(xxhash.xxh64_intdigest(x) - 2**63 for x in names)


class _Kept(dict):
    """What `of` gives for a word (bytes), kept for at most `most` words."""

    def __init__(self, of, most: int = 200_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.of(word.decode())
        return value


def _words(text: pa.Scalar) -> list[bytes]:
    return text.as_buffer().to_pybytes().lower().split() if text.is_valid else []


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    ranks: np.ndarray  # of the features, by chi squared
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, from w.x."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - sums[:, None], -500, 500)))


def fitted(rows: list[np.ndarray], grades: np.ndarray, n_features: int, steps: int = 400, ridge: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of highest penalised likelihood, by Adam on the whole sample.

    Both classes get the same total weight. Thresholds are t_0 and the logarithms of their steps, so they stay ordered.
    """
    starts = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns = np.concatenate(rows) if rows else np.zeros(0, int)
    share = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
    p = np.zeros(n_features + 3)
    p[n_features] = 1.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t = p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])
        sums = np.bincount(starts, w[columns], len(rows))
        above = 1 / (1 + np.exp(np.clip(t[None, :] - sums[:, None], -30, 30)))
        edges = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        high, low = edges[at, grades], edges[at, grades + 1]
        chance = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        d_sum = share * (d_high - d_low)
        d_t = np.zeros(5)
        np.add.at(d_t, grades, -share * d_high)
        np.add.at(d_t, grades + 1, share * d_low)
        d_t = d_t[1:4]
        gaps = np.exp(p[n_features + 1 :])
        gradient = np.concatenate([np.bincount(columns, d_sum[starts], n_features) - ridge * w, [d_t.sum(), d_t[1:].sum() * gaps[0], d_t[2] * gaps[1]]])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        p = p + 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])


def graded_by_other_half(rows: list[np.ndarray], toxic: np.ndarray, half: np.ndarray, n_features: int) -> np.ndarray:
    """Grades of rows: 0 where not toxic, else 1 to 3 by thirds of the row's sum of log odds that the rows of the other half
    give its features. Features that the other half doesn't tie to toxicity add nothing."""
    grades = np.zeros(len(rows), np.int64)
    for own in (0, 1):
        other = half != own
        counts = [np.bincount(np.concatenate([r for r, o in zip(rows, other & side, strict=True) if o] or [np.zeros(0, np.int64)]), minlength=n_features) for side in (toxic, ~toxic)]
        n = [(other & side).sum() for side in (toxic, ~toxic)]
        odds = np.log((counts[0] + 0.5) * (n[1] - counts[1] + 0.5) / ((counts[1] + 0.5) * (n[0] - counts[0] + 0.5)))
        odds = np.where(counts[0] > 0, np.maximum(odds, 0), 0)
        at = np.flatnonzero((half == own) & toxic)
        sums = np.array([odds[rows[k]].sum() for k in at])
        if len(at):
            grades[at] = 1 + np.searchsorted(np.quantile(sums, [1 / 3, 2 / 3]), sums, "left")
    return grades


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """A model from the labelled rows of docs; labels has doc_id and toxic (0 or 1)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(word_features, 50_000)
        for batch in batches:
            lists = [np.unique(np.array([f for w in set(_words(t)) for f in kept[w]], np.int64)) for t in batch[2]]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1].cast(pa.int32()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "toxic", "features"])

    rows = written(texts.mapInArrow(featured, "doc_id long, toxic int, features array<long>"), "toxic-features")
    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, n1 = totals["n"], totals["toxic"] or 0
    if n1 == 0 or n1 == n:
        share = n1 / n if n else 0.0
        level = np.log((1 - share + 1e-9) / (share + 1e-9))
        return Model(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), level + np.array([0.0, 1.0, 2.0]))
    df = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("a"), F.sum("toxic").alias("b"))
    df = df.where(F.col("b") >= LEAST_TOXIC_ROWS)
    b, c = F.col("b"), F.col("a") - F.col("b")
    odds = F.log((b + 0.5) * (n - n1 - c + 0.5) / ((c + 0.5) * (n1 - b + 0.5)))
    chi2 = n * F.pow(b * (n - n1 - c) - c * (n1 - b), F.lit(2)) / (F.lit(float(n1)) * (n - n1) * (b + c) * (n - b - c) + 1e-9)
    ranked = df.select("feature", odds.alias("odds"), chi2.alias("chi2")).where((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("chi2") >= LEAST_CHI2))
    best = np.array([r[0] for r in ranked.orderBy(F.desc("chi2"), "feature").select("feature").collect()], np.int64)  # bounded by the sample
    ranks = np.argsort(best)
    features = best[ranks]

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(_known(features, ranks))
        for batch in batches:
            found = [_places(t, kept) for t in batch[2]]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1].cast(pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "toxic", "columns"])

    sample = texts.mapInArrow(graded, "doc_id long, toxic int, columns array<long>").toPandas()  # at most most_labelled rows
    sample = sample.sort_values("doc_id", kind="stable")  # sums in a fixed order
    columns = [np.asarray(c, np.int64) for c in sample["columns"]]
    half = np.array([zlib.crc32(str(i).encode()) & 1 for i in sample["doc_id"]], np.int64)
    grades = graded_by_other_half(columns, sample["toxic"].to_numpy() > 0, half, len(features))
    weights, thresholds = fitted(columns, grades, len(features))
    return Model(features, ranks, weights, thresholds)


def _known(features: np.ndarray, ranks: np.ndarray):
    """A function from a word to the place in `features` of the best one that it has; -1 if it has none."""
    place = {int(h): k for k, h in enumerate(features)}
    rank = ranks.tolist()

    def known(word: str) -> int:
        found = [place[h] for h in word_features(word) if h in place]
        return min(found, key=rank.__getitem__) if found else -1

    return known


def _places(text: pa.Scalar, kept: _Kept) -> np.ndarray:
    """The places of the features that a text's words stand for, each once."""
    found = set(map(kept.__getitem__, set(_words(text))))
    found.discard(-1)
    return np.array(sorted(found), np.int64)


def score(docs: DataFrame, model: Model, new: tuple[str, str, str] = ("toxic_probability", "expected_severity", "toxic")) -> DataFrame:
    """docs, all columns, with three new ones: the probability of a grade above 0, the expected grade (0 to 3), and whether
    that probability is at least one half. Names that docs has already are taken over by the new columns."""
    columns = [c for c in docs.columns if c not in new]
    known = docs.sparkSession.sparkContext.broadcast(model)  # bounded like the sample

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        kept = _Kept(_known(model.features, model.ranks))
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column(at).cast(pa.binary())):
                sums[i] = model.weights[_places(t, kept)].sum()
            above = model.above(sums)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(above[:, 0] >= 0.5)], kinds.names)

    # plain names meanwhile, as Spark looks the columns up by name there
    at = columns.index("text")
    plain = docs.select(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns)))
    kinds = StructType([*plain.schema, StructField("p", DoubleType()), StructField("severity", DoubleType()), StructField("toxic", BooleanType())])
    return plain.mapInArrow(scored, kinds).toDF(*columns, *new)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that a model fitted on their labels doesn't find toxic, with all columns."""
    new = ("_heronry_p", "_heronry_severity", "_heronry_toxic")
    return score(docs, fit(docs, labels), new).where(~F.col(new[2])).select(quoted(docs.columns))
