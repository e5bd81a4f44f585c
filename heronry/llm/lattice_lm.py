"""Language-model scores: the probability of a text under all its segmentations into the pieces of a vocabulary.

The pieces are those of an existing vocabulary. Their probabilities are counted here: every distinct word of the training
documents is cut by the vocabulary's own rule, and its pieces count as often as the word stands in the corpus. A text is
its words in order, each after one space, and an end. As no piece crosses a space, the sum over all segmentations of a text is the product over its
words of the sums over theirs, so each distinct word is summed once, by forward recursion in logarithms. Beside it stands
a unigram score of whole words with additive smoothing.

Word counts of the whole corpus are a table in the shared folder. Scoring a document needs the values of its words: the
most frequent ones, at most MOST_COMMON, are broadcast; the rest of each document's words meet the table in a join.

What is defined for odd input:
- Words are runs of characters other than space and \\x09-\\x0D, with A-Z in lower case. A null text counts as empty: one
  end. Whole texts count; a very long word is one word, of any length.
- Rows with a null id are training rows (held_out false). Repeated rows count and are scored as often as they stand there.
- Characters outside the vocabulary are spelled by its byte pieces. Every piece has at least the smoothing count.
- Without training rows all counts are zero: base_score is the number of tokens times log10(1 / (V + 1)) with V = 0.
- Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import crc_mod, written

#: Words whose values are broadcast, at most; about 40 MB.
MOST_COMMON = 300_000
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000
SMOOTHING = 0.1
SPACE = "▁"


def _words(text: pa.Scalar) -> list[bytes]:
    return text.as_buffer().to_pybytes().lower().split() if text.is_valid else []


def _held_out(doc_id):
    return F.coalesce(crc_mod(doc_id, 10) == 0, F.lit(False))


def _rows(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text"), _held_out(doc_id).alias("held_out"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n): how often each word of any document stands in training documents, 0 for words of others alone.
    The word that is null counts training documents, that is ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            words = [*trained, *(w for w in others if w not in trained)]
            n = [*trained.values(), *([0] * (len(words) - len(trained)))]
            return pa.RecordBatch.from_arrays([pa.array([*words, None], pa.binary()), pa.array([*n, ends], pa.int64())], ["word", "n"])

        trained, others, ends = Counter(), set(), 0
        for batch in batches:
            for text, held_out in zip(batch[1], batch[2].to_pylist(), strict=True):
                if held_out:
                    others.update(_words(text))
                else:
                    trained.update(_words(text))
                    ends += 1
                if len(trained) + len(others) > FLUSH:
                    yield flushed()
                    trained, others, ends = Counter(), set(), 0
        yield flushed()

    return _rows(docs).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Pieces:
    """Log probabilities of a vocabulary's pieces, and sums over segmentations with them."""

    def __init__(self, path: str, log10: np.ndarray | None = None):
        import sentencepiece

        self.vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.vocabulary.get_piece_size()
        if log10 is not None:
            v = self.vocabulary
            plain = [i for i in range(self.size) if not (v.is_byte(i) or v.is_control(i) or v.is_unknown(i))]
            self.log = {v.id_to_piece(i): float(log10[i]) * math.log(10) for i in plain}
            self.bytes = {int(v.id_to_piece(i)[3:5], 16): float(log10[i]) * math.log(10) for i in range(self.size) if v.is_byte(i)}
            self.longest = max(map(len, self.log), default=1)
            self.end = float(log10[v.eos_id()])

    def of(self, words: list[str]) -> list[list[int]]:
        return self.vocabulary.encode(words, num_threads=1)

    def log10_sum(self, word: str) -> float:
        """log10 of the sum, over all ways to spell the word after a space, of the product of their pieces."""
        text, log = SPACE + word, self.log
        ahead = [0.0] + [-math.inf] * len(text)
        for begin in range(len(text)):
            so_far = ahead[begin]
            if so_far == -math.inf:
                continue
            for end in range(begin + 1, min(len(text), begin + self.longest) + 1):
                p = log.get(text[begin:end])
                if p is not None:
                    ahead[end] = _added(ahead[end], so_far + p)
            if self.bytes:
                spelled = sum(self.bytes[b] for b in text[begin].encode("utf-8", "surrogatepass"))
                ahead[begin + 1] = _added(ahead[begin + 1], so_far + spelled)
        return ahead[-1] / math.log(10)


def _added(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def piece_log10(counts: DataFrame, vocabulary: str) -> np.ndarray:
    """log10 probability of each piece, from counts of words; the end's count is that of documents."""
    size = Pieces(vocabulary).size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = Pieces(vocabulary), np.zeros(size, np.int64)
        for batch in batches:
            words, n = batch[0].to_pylist(), batch[1].to_pylist()
            for at in range(0, len(words), 2000):
                part = words[at : at + 2000]
                for ids, times in zip(pieces.of([w.decode("utf-8", "replace") for w in part]), n[at : at + 2000], strict=True):
                    for i in ids:
                        total[i] += times
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    words = counts.where("word is not null and n > 0").select("word", "n")
    rows = words.mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most a row a piece
    total = np.full(size, SMOOTHING)
    for r in rows:
        total[r["piece"]] += r["n"]
    p = Pieces(vocabulary).vocabulary
    total[p.eos_id()] += (counts.where("word is null").agg(F.sum("n")).first()[0] or 0)
    total[[i for i in range(size) if (p.is_control(i) and i != p.eos_id()) or p.is_unknown(i)]] = 0
    with np.errstate(divide="ignore"):
        return np.log10(total / total.sum())


def score(docs: DataFrame, vocabulary: str, most_common: int = MOST_COMMON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    score is the log10 probability of the text under the pieces, base_score that under smoothed word counts.
    """
    spark = docs.sparkSession
    counts = written(word_counts(docs), "words")
    ends = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    words = counts.where("word is not null")
    totals = words.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).first()
    train_tokens, kinds = (totals["n"] or 0) + ends, (totals["v"] or 0) + (ends > 0)
    log10 = piece_log10(counts, vocabulary)
    below = math.log10(train_tokens + SMOOTHING * (kinds + 1))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary, log10)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pieces.log10_sum(w.decode("utf-8", "replace")) for w in batch[0].to_pylist()])], ["word", "n", "lattice"])

    valued = written(words.select("word", "n").mapInArrow(summed, "word binary, n long, lattice double"), "values")
    by_size = valued.groupBy(F.floor(F.log2(F.col("n") + 1)).alias("size")).agg(F.count("*").alias("words")).collect()  # at most 64 rows
    least, so_far = 64, 0
    for size, n in sorted(((r["size"], r["words"]) for r in by_size), reverse=True):
        if so_far + n > most_common:
            break
        least, so_far = size, so_far + n
    common = F.floor(F.log2(F.col("n") + 1)) >= least
    rows = valued.where(common).collect()  # at most most_common words
    known = spark.sparkContext.broadcast({r["word"]: (r["n"], r["lattice"]) for r in rows})
    end_base, end_score = math.log10(ends + SMOOTHING) - below, float(log10[Pieces(vocabulary).vocabulary.eos_id()])

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with a null word and the sums over its common words, and one for each other word."""
        values = {w: (math.log10(n + SMOOTHING) - below, lattice, n > 0) for w, (n, lattice) in known.value.items()}
        nothing = (None, None, None)
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, text, held_out in zip(batch[0].to_pylist(), batch[1], batch[2].to_pylist(), strict=True):
                tokens = _words(text)
                base, lattice, met = end_base, end_score, int(ends > 0)
                for word, n in Counter(tokens).items():
                    b, s, seen = values.get(word, nothing)
                    if b is None:
                        out.append((row_id, None, None, None, None, word, n, None, None))
                    else:
                        base, lattice, met = base + n * b, lattice + n * s, met + n * seen
                out.append((row_id, doc_id, held_out, len(tokens) + 1, met, None, None, base, lattice))
                row_id += 1
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    parts = written(_rows(docs).mapInArrow(partly, PARTS), "parts")
    rare = parts.where("word is not null").select("row_id", "word", "times")
    rare = rare.join(valued.where(~common), "word")
    base = F.log10(F.col("n") + SMOOTHING) - below
    rare = rare.groupBy("row_id").agg(
        F.sum(F.col("times") * base).alias("more_base"), F.sum(F.col("times") * F.col("lattice")).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.where("word is null").join(rare, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"),
        (F.col("lattice") + zero("more")).alias("score"),
    )


PARTS = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, word binary, times long, base double, lattice double"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [p.split()[0] for p in PARTS.split(", ")])
