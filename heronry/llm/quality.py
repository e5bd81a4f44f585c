"""Quality scores from document statistics: random Fourier features, ridge regression, isotonic calibration.

Some twenty statistics of a text (shares of kinds of characters, lengths of words and lines, repeats) are standardised
and mapped to cosines with random frequencies, whose products approximate a Gaussian kernel. Partitions sum the normal
equations of ridge regression, Spark adds the sums row by row of the matrix, and the driver solves the small system.
Scores are then calibrated on other labelled rows: they are counted in bins, and the bins made monotone by pooling.

Learning uses labelled rows with crc32(doc_id as text) mod 3 = 0 for the regression and = 2 for the calibration, of each
at most MOST_LABELLED (those with the lowest hash of their id). Rows with remainder 1 are never learned from. Labels,
lang, source and doc_id are no inputs of a score. Scoring covers all rows and whole texts.

What is defined for odd input:
- Null or empty texts have zero for every statistic, and get a score. Rows with a null id are scored; held_out is false.
- Null labels and labels of unknown ids are ignored. Without labelled rows the score is the middle, 0.5; with labels of
  one kind, or none left for calibration, it is what regression or the share of good labels gives, within 0 and 1.
- Repeated rows are scored one by one. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, written

MOST_LABELLED, FEATURES, RIDGE, BINS = 100_000, 256, 1.0, 400
#: Width of the Gaussian kernel, for standardised statistics, against the square root of their number.
WIDTH = 1.0

_CLASS = np.zeros(256, np.uint8)  # 0: other bytes, of multi-byte letters too
for _n, _of in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",;:", b"!", b"?", b"#*$%&|<>", b"()[]{}\"'", b"=_/\\-+@~^`"), 1):
    _CLASS[list(_of)] = _n
N_CLASSES = 13
_CHUNK = 1 << 20
STATISTICS = N_CLASSES + 11


def statistics(text: bytes) -> np.ndarray:
    """The statistics of a text in UTF-8."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    counts = np.zeros(N_CLASSES)
    for at in range(0, len(text), _CHUNK):
        counts += np.bincount(_CLASS[np.frombuffer(text, np.uint8, min(_CHUNK, len(text) - at), at)], minlength=N_CLASSES)
    out[:N_CLASSES] = counts / len(text)
    words = text.split()
    n = len(words)
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        distinct = len(set(words))
        lines = [x for x in text.split(b"\n") if x.strip()]
        runs = set(zip(words, words[1:], words[2:]))  # noqa: B905
        out[N_CLASSES:] = (
            np.log1p(n),
            lengths.mean(),
            lengths.std(),
            np.log1p(lengths.max()),
            distinct / n,
            np.log(distinct + 1) / np.log(n + 2),
            1 - len(runs) / max(1, n - 2) if n > 2 else 0.0,
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))),
            sum(w.isupper() for w in words) / n,
            max(map(len, lines), default=0) / len(text),
        )
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch[1]]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(of, "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray  # of the features, then the constant; empty if nothing was learned
    knots: np.ndarray  # raw scores
    values: np.ndarray  # calibrated ones

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(11)
        frequencies = rng.normal(size=(STATISTICS, FEATURES)) / (WIDTH * np.sqrt(STATISTICS))
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        cosines = np.sqrt(2 / FEATURES) * np.cos(z @ frequencies + phases)
        return np.concatenate([cosines, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if len(self.weights) else np.full(len(x), 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.interp(raw, self.knots, self.values) if len(self.knots) else np.clip(raw, 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, STATISTICS)


def pooled(at: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of bins in order: neighbours that fall are pooled until the shares rise."""
    blocks: list[list[float]] = []
    for a, count, hits in zip(at, n, good, strict=True):
        blocks.append([a * count, count, hits])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    x, count, hits = np.array(blocks).T
    return x / count, np.maximum.accumulate((hits + 0.5) / (count + 1))


def fit(rows: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """A model from rows (doc_id, x) and labels (doc_id, quality 0 or 1)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    known = known.withColumn("fold", crc_mod(F.col("doc_id"), 3)).where("fold != 1")
    parts = [known.where(F.col("fold") == fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled) for fold in (0, 2)]
    chosen = rows.join(parts[0].unionByName(parts[1]), "doc_id").select("doc_id", "x", F.col("y").cast("double").alias("y"), "fold")
    chosen = written(chosen, "labelled")
    training = chosen.where("fold = 0")
    moments = training.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")).collect()
    if not moments:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(0), np.zeros(0), np.zeros(0))
    mean, deviation = np.zeros(STATISTICS), np.ones(STATISTICS)
    for r in moments:  # one row a statistic
        mean[r["i"]], deviation[r["i"]] = r["mean"], r["deviation"] if r["deviation"] > 1e-9 else 1.0
    model = Model(mean, deviation, np.zeros(0), np.zeros(0), np.zeros(0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column("x")))
                total += z.T @ np.concatenate([z, np.asarray(batch.column("y"))[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    # a matrix of fixed size from each partition of the bounded sample, added up by matrix row on the executors
    by_row = training.select("x", "y").mapInArrow(sums, "i int, row array<double>")
    added = by_row.select("i", F.posexplode("row").alias("k", "v")).groupBy("i", "k").agg(F.sum("v").alias("v")).collect()
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in added:
        system[r["i"], r["k"]] = r["v"]
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.raw(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column("y")], ["s", "y"])

    scored = chosen.where("fold = 2").select("x", "y").mapInArrow(raw, "s double, y double")
    place = F.floor(F.least(F.greatest(F.col("s"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2.0))
    bins = scored.groupBy(place.alias("bin")).agg(F.avg("s").alias("at"), F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()  # at most BINS + 1 rows
    if bins:
        model.knots, model.values = pooled(*(np.array([float(r[c]) for r in bins]) for c in ("at", "n", "good")))
    return model


def score(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs: predicted is 1 from a score of one half."""
    rows = written(measured(docs), "statistics")
    known = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, most_labelled))  # of fixed size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = known.value.score(_matrix(batch[1])) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(np.clip(s, 0.0, 1.0))], ["doc_id", "score"])

    out = rows.mapInArrow(scored, "doc_id long, score double")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
