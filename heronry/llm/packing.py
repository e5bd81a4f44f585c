"""Packing of tokenized documents into sequences of bounded length by minimum bin slack.

Each document's ids (those of the tokenizer, then an end id) are cut into pieces of at most `capacity` ids. Which lengths
share a sequence depends on the histogram of piece lengths alone, which has at most `capacity` rows at any scale: the plan
takes the longest length left, fills the rest of its window with the multiset of lengths that comes closest to it (a
subset-sum over bitsets, with counts, traced back), and repeats that pattern as often as the counts allow. Pieces then
find their place by their rank among the pieces of their length; ranks come from salted groups, so no length is hot.

What is defined for odd input:
- A null or empty text is the end id alone. Repeated rows are packed as often as they stand there. Null ids are kept.
- Texts of more than SEGMENT characters are tokenized in segments, which end after white space that an ASCII letter or
  digit follows; where there is none for longer, the segment goes on. A task holds one whole text and its ids.
- Other columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import small_batches, written

CAPACITY, END_ID = 2048, 1
#: Words whose ids a task keeps.
MOST_WORDS = 400_000
#: Characters of text that are cut into words at a time; of short texts that are taken together.
SEGMENT, TOGETHER = 1_000_000, 300_000
#: Groups that pieces are dealt into for ranking, for each shuffle partition.
GROUPS = 4

# Texts of these characters alone are cut into words here, which gives what the tokenizer's own rules give: none of them
# changes under composition, each has a lower case of one letter among them, and white space and letters are the same sets.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]*")
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
# No token spans white space, and no rule of the tokenizer looks back over white space from one of these.
_CUT = re.compile(r"[ \t\n\r](?=[0-9A-Za-z])")


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ids(tokenizer, text: str) -> np.ndarray:
    return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


class WordIds(dict):
    """The ids of a word as little-endian 32-bit numbers, kept for at most MOST_WORDS words."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)  # which ids end a word
        self.ends[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True

    def learn(self, lists: list[list[str]]) -> None:
        """Encodes the words that aren't known yet in one go, apart by spaces."""
        words = set().union(*lists)
        new = list(words.difference(self))
        if len(self) + len(new) > MOST_WORDS:
            self.clear()
            new = list(words)
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            ids = _ids(self.tokenizer, " ".join(part))
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) == len(part):  # else each is encoded when it is looked up
                raw = ids.tobytes()
                self.update(zip(part, (raw[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = _ids(self.tokenizer, word).tobytes()
        return ids

    def of(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))


_kept: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One store a worker process, so that it serves one task after the other."""
    if path not in _kept:
        _kept[path] = WordIds(_tokenizer(path))
    return _kept[path]


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about `most` characters, whose ids put together are those of the text."""
    at = 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def encoded(texts: list[str], ids: WordIds) -> list[bytes]:
    """The ids of each text, as little-endian 32-bit numbers; the same as those of the tokenizer for the whole text.

    Words that are new are learned for all texts together, or for each segment of a text that is longer than one.
    """
    out: list[bytes] = []
    plain = ["<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]  # no special token's name, and only the letters above
    lists = [_WORD.findall(t.lower()) if p and len(t) <= SEGMENT else [] for t, p in zip(texts, plain, strict=True)]
    ids.learn(lists)
    for text, own, words in zip(texts, plain, lists, strict=True):
        if len(text) <= SEGMENT:
            out.append(ids.of(words) if own else _ids(ids.tokenizer, text).tobytes())
            continue
        parts = []
        for part in segments(text):
            if own:
                words = _WORD.findall(part.lower())
                ids.learn([words])
                parts.append(ids.of(words))
            else:
                parts.append(_ids(ids.tokenizer, part).tobytes())
        out.append(b"".join(parts))
    return out


def _together(batch: pa.RecordBatch, most: int = TOGETHER) -> Iterator[list[tuple]]:
    """The (doc_id, text) rows of a batch, as many at a time as have `most` characters."""
    rows, held = [], 0
    for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
        rows.append((doc_id, text.as_py() or ""))
        held += len(rows[-1][1])
        if held > most:
            yield rows
            rows, held = [], 0
    yield rows


PIECES = "piece_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """PIECES, and with them ids as a binary: the documents' ids, cut every `capacity` ids. A piece_id is made of the task's
    number and the piece's place in it, so it is to be kept in a table before it is used twice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        piece_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, held = [], 0
            for group in _together(batch):
                for (doc_id, _), own in zip(group, encoded([text for _, text in group], store), strict=True):
                    ids = own + end
                    for start in range(0, len(ids), 4 * capacity):
                        part = ids[start : start + 4 * capacity]
                        rows.append((piece_id, doc_id, start // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if with_ids else None))
                        piece_id += 1
                        held += len(part) if with_ids else 100
                        if held > 2_000_000:
                            yield made(rows)
                            rows, held = [], 0
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())] * with_ids
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def fill(counts: dict[int, int], space: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum comes closest to `space` from below, with no more of a length than counts has.

    Bit s of `reached` says that some multiset of the lengths so far sums to s. Long lengths come first, and the search
    ends as soon as the space can be filled exactly.
    """
    full = (1 << (space + 1)) - 1
    reached, steps = 1, []
    for length in sorted((x for x in counts if x <= space), reverse=True):
        steps.append((length, reached))
        left, part = min(counts[length], space // length), 1
        while left > 0:
            part = min(part, left)
            reached |= (reached << (length * part)) & full
            left -= part
            part *= 2
        if reached >> space & 1:
            break
    total, found = reached.bit_length() - 1, []
    for length, before in reversed(steps):
        times = 0
        while not before >> total & 1:
            total -= length
            times += 1
        if times:
            found.append((length, times))
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, repeats, first sequence, offset): pieces of that length and of `repeats` ranks from the
    first go to as many sequences from the first, all at that offset. Its size follows the number of lengths, not the data."""
    left = {x: n for x, n in histogram.items() if n > 0}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = dict(fill({x: n for x, n in rest.items() if n}, capacity - longest))
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(left[x] // times for x, times in pattern.items())
        offset = 0
        for length, times in sorted(pattern.items(), reverse=True):
            for _ in range(times):
                rows.append((length, used[length], repeats, sequence, offset))
                used[length] += repeats
                offset += length
            left[length] -= times * repeats
            if not left[length]:
                del left[length]
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces of docs (doc_id, start, length, ids_crc32, doc_tokens) with sequence_id and offset, which are gapless in each
    sequence and in all at most `capacity` ids, and with the ids unless they aren't wanted. Ids move at most once, in the join
    that brings pieces and places together."""
    with small_batches(docs.sparkSession):
        cut = written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    out = places(cut.drop("ids"), capacity)
    if with_ids:
        out = out.join(cut.select("piece_id", "ids"), "piece_id")
    return out.drop("piece_id")


def places(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of `cut` (PIECES, as a table that is kept) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity)
    known = cut.sparkSession.sparkContext.broadcast((rows[:, 0] << 44 | rows[:, 1], rows))  # bounded like the plan

    # each length is dealt into groups by its count, so that no group holds more than its share of all pieces
    spark = cut.sparkSession
    share = sum(histogram.values()) // (GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    salts = spark.createDataFrame([(x, -(-n // share)) for x, n in histogram.items()], "length long, salts long")
    cut = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("piece_id"), F.col("salts")))  # a row a length
    sizes = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    sizes = sizes.select("length", "salt", before.alias("before"))
    place = Window.partitionBy("length", "salt").orderBy("piece_id")
    ranked = cut.withColumn("place", F.row_number().over(place)).join(sizes, ["length", "salt"])
    ranked = ranked.select(*(c.split()[0] for c in PIECES.split(", ")), (F.col("before") + F.col("place") - 1).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows = known.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(first, length << 44 | rank, "right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(rows[at, 4])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, PIECES + ", sequence_id long, offset long")
