"""Alignment of two tokenizers over a corpus: which of their ids cover the same bytes, and how often, by external counting.

Both tokenizers cut space + text into tokens. Links are the pairs of tokens whose bytes overlap; each pair of ids is counted
over the corpus, and each document gets back what its links count. Counting is external:
1. A task collects the links of RUN_LINKS tokens' worth of documents, sorts them, adds up those of one document, and deals
   them by the B id to RADIX parts: each is a run of (pair, document, times), zstd-compressed, in order of B id, then A id.
   Runs are a table in the shared folder.
2. The runs of a part meet in groups of at most GROUP_RECORDS records (a part with more gets more groups, so a frequent B id
   is no hot key) and a k-way heap merge adds up each pair; Spark adds up what groups have of the same pair. The counts,
   B id by B id, give each B id's maximum.
3. The groups meet the counts of their part, which are bounded by the vocabularies, and stream what each run's documents
   get from it back, one row a run; the rows of the documents add these up.

Neither tokenizer has a token that goes on over the start of a run of spaces after another character, so texts are cut into
units there, and each distinct unit is tokenized once and kept (MOST_UNITS a worker). Tests hold this against whole texts.

Rules, and what is defined for odd input:
- Token bytes: A's entries byte-level decoded; B's pieces in UTF-8 with U+2581 as space and <0xHH> as that byte. Texts that
  are null or empty, or whose joined A or B bytes differ from space + text (U+2581 in the text, for instance), have no
  tokens: all zeros, and an empty groups_sha256. Names of special tokens within texts are plain text.
- Each row of the input gives one row: repeated rows, ties and null ids stay. Several pairs may be a B id's highest.
- Texts of any length are taken whole; a task holds one text and its links.
- Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that a task collects before it sorts them into runs; parts that B ids are dealt to; records that one group merges.
RUN_LINKS, RADIX, GROUP_RECORDS = 2_000_000, 16, 8_000_000
#: Distinct units, and bytes of their groups' text, that a worker keeps.
MOST_UNITS, MOST_UNIT_BYTES = 150_000, 48_000_000
#: Characters of texts whose new units are tokenized together.
TOGETHER = 2_000_000

_ODD = re.compile(r" (?:\s|\Z)")
#: Where a unit begins: a run of spaces after another character. Within other white space it is one space before a word.
_BREAK = re.compile(r"(?<! ) (?=\S)|(?<=\S) (?=\s)")


def units(text: str) -> list[str]:
    """space + text in parts, each without the space that it begins with."""
    if text[0] != " " and not _ODD.search(text):
        return text.split(" ")
    return _BREAK.split(f"x {text}")[1:]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones are themselves, others follow from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """The units that a worker knows: number of tokens, groups and links of each, its links, and its groups as text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [bytes(letters[c] for c in self.a.id_to_token(i)) for i in range(self.size_a)]
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        shown = [f"{i}{end}" for size, ends in ((self.size_a, ",|"), (self.size_b, ",;")) for i in range(size) for end in ends]
        self.shown = np.array(shown, object)  # by 2 * id + whether the token ends its group's side; those of B follow
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.n_bytes = 0
        self.numbers = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; n_a is -1 where the bytes differ
        self.links = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keeps the most used units, half as many and as many bytes as may be kept."""
        size = np.array([len(t) for t in self.texts])
        order = np.argsort(-self.uses, kind="stable")[: MOST_UNITS // 2]
        kept = np.sort(order[np.cumsum(size[order]) <= MOST_UNIT_BYTES // 2])
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.texts = [self.texts[k] for k in kept.tolist()]
        self.n_bytes = int(size[kept].sum())
        n = self.numbers[kept, 3]
        self.links = self.links[np.repeat(self.first[kept] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        self.numbers, self.uses, self.first = self.numbers[kept], self.uses[kept], np.cumsum(n) - n

    def learn(self, lists: list[list[str]]) -> None:
        if len(self.known) > MOST_UNITS or self.n_bytes > MOST_UNIT_BYTES:
            self.forget_rare()
        new = list(set().union(*lists).difference(self.known))
        if not new:
            return
        ids_a = [e.ids for e in self.a.encode_batch_fast([f" {u}" for u in new], add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        whole = "".join([f" {u}" for u in new]).encode()
        if all(b"".join(map(of.__getitem__, chain.from_iterable(ids))) == whole for of, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            fine = list(range(len(new)))
        else:
            same = lambda of, ids, u: b"".join(map(of.__getitem__, ids)) == f" {u}".encode()
            fine = [k for k, u in enumerate(new) if same(self.bytes_a, ids_a[k], u) and same(self.bytes_b, ids_b[k], u)]
            ids_a, ids_b = [[ids[k] for k in fine] for ids in (ids_a, ids_b)]
        numbers = np.full((len(new), 4), -1, np.int64)
        numbers[:, 1:] = 0
        texts = [b""] * len(new)
        links = np.zeros(0, np.uint64)
        if fine:
            sizes = [np.fromiter(map(len, ids), np.int64, len(fine)) for ids in (ids_a, ids_b)]
            a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in zip((ids_a, ids_b), sizes, strict=True))
            end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
            stops = end_a[np.cumsum(sizes[0]) - 1]  # where units end
            cuts = np.sort(np.concatenate([end_a, end_b]), kind="stable")
            both = cuts[1:] == cuts[:-1]
            ends, cuts = cuts[1:][both], cuts[np.concatenate([[True], ~both])]
            # between two cuts lies one overlap of one A token with one B token
            links = (b[np.searchsorted(end_b, cuts)] * self.size_a + a[np.searchsorted(end_a, cuts)]).astype(np.uint64)
            by_unit = [np.diff(np.searchsorted(x, stops, "right"), prepend=0) for x in (ends, cuts)]
            numbers[fine] = np.stack([*sizes, *by_unit], axis=1)
            group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
            sequence = np.zeros(len(a) + len(b), np.int64)
            sequence[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + np.diff(group_a, append=-1).astype(bool)
            sequence[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (self.size_a + b) + np.diff(group_b, append=-1).astype(bool)
            shown = self.shown[sequence].tolist()
            at = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])]).tolist()
            for k, x, y in zip(fine, at[:-1], at[1:], strict=True):
                texts[k] = "".join(shown[x:y]).encode()
        start = len(self.links) + np.cumsum(numbers[:, 3]) - numbers[:, 3]
        self.known.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        self.texts += texts
        self.n_bytes += sum(map(len, texts))
        self.numbers, self.links, self.first = np.concatenate([self.numbers, numbers]), np.concatenate([self.links, links]), np.concatenate([self.first, start])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def of(self, parts: list[str]) -> tuple[np.ndarray, str, np.ndarray]:
        """The four numbers of a text of these units, its groups' digest, and its links."""
        at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        np.add.at(self.uses, at, 1)
        numbers = self.numbers[at]
        if (numbers[:, 0] < 0).any():
            return np.zeros(4, np.int64), "", np.zeros(0, np.uint64)
        text = b"".join(map(self.texts.__getitem__, at.tolist()))
        n = numbers[:, 3]
        own = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return numbers.sum(axis=0), hashlib.sha256(text[:-1]).hexdigest(), self.links[own]


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _packed(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(c.tobytes() for c in columns), 1)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    """Columns of equal length."""
    raw = zstandard.decompress(data)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


#: A run has pairs (pair, number of documents, times) and docs (document's place among the run's, times); the row of part -1
#: has the documents of the runs with the same name.
RUNS = "run string, part int, records long, pairs binary, docs binary, ids array<long>, numbers array<long>, digests array<string>"


def runs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The corpus as runs; see the module's step 1."""

    def flushed(ids, numbers, digests, links):
        name = uuid.uuid4().hex
        size = aligner(path_a, path_b).size_a
        rows = [(name, -1, len(ids), None, None, ids, np.concatenate(numbers).tolist(), digests)]
        n = np.array([len(x) for x in links])
        keys = np.concatenate(links)
        shift = np.uint64(max(1, int(len(n) - 1).bit_length()))  # a pair of ids and a place take far fewer than 64 bits
        keys = (keys << shift) | np.repeat(np.arange(len(n), dtype=np.uint64), n)
        keys.sort()
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(begin, append=len(keys))
        pair, doc = keys[begin] >> shift, keys[begin] & ((np.uint64(1) << shift) - np.uint64(1))
        part = (pair // np.uint64(size)) % np.uint64(RADIX)
        for k in range(RADIX):
            own = np.flatnonzero(part == k)
            if len(own):
                p, t = pair[own], times[own]
                first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                pairs = _packed(p[first].astype("<u8"), np.diff(first, append=len(p)).astype("<u4"), np.add.reduceat(t, first).astype("<u8"))
                rows.append((name, k, len(own), pairs, _packed(doc[own].astype("<u4"), t.astype("<u4")), None, None, None))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
        names = ["run", "part", "records", "pairs", "docs", "ids", "numbers", "digests"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def made(batches):
        held: tuple = ([], [], [], [])
        n_links = 0
        for rows in _together(batches):
            own = aligner(path_a, path_b)
            lists = [units(t) if t else [] for _, t in rows]
            own.learn(lists)
            for (doc_id, _), parts in zip(rows, lists, strict=True):
                found = own.of(parts) if parts else (np.zeros(4, np.int64), "", np.zeros(0, np.uint64))
                for x, to in zip((doc_id, *found), held, strict=True):
                    to.append(x)
                n_links += len(found[2])
                if n_links >= RUN_LINKS:
                    yield flushed(*held)
                    held, n_links = ([], [], [], []), 0
        if held[0]:
            yield flushed(*held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, RUNS)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(doc_id, text) rows, as many at a time as have TOGETHER characters."""
    for batch in batches:
        rows, held = [], 0
        for k in range(batch.num_rows):
            rows.append((batch[0][k].as_py(), batch[1][k].as_py()))
            held += len(rows[-1][1] or "")
            if held >= TOGETHER:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows


def _merged(packed: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, times) in order of pairs, from the pairs of many runs, by a heap over their heads."""

    def head(data):
        pair, _, times = _unpacked(data, "<u8", "<u4", "<u8")
        for at in range(0, len(pair), 4096):
            yield from zip(pair[at : at + 4096].tolist(), times[at : at + 4096].tolist(), strict=True)

    last, total = None, 0
    for pair, times in heapq.merge(*map(head, packed)):
        if pair != last:
            if last is not None:
                yield last, total
            last, total = pair, 0
        total += times
    if last is not None:
        yield last, total


def _dealt(rows: DataFrame) -> DataFrame:
    """The runs with their group: parts of more than GROUP_RECORDS records have several, and a run goes to one of them."""
    sizes = rows.groupBy("part").agg(F.ceil(F.sum("records") / GROUP_RECORDS).cast("int").alias("groups"))
    return rows.join(F.broadcast(sizes), "part").withColumn("group", F.pmod(F.xxhash64("run"), "groups").cast("int"))  # RADIX rows


def pair_counts(dealt: DataFrame, size_a: int) -> DataFrame:
    """(part, pair, times, best): how often each pair is linked in the corpus, and whether no pair of its B id is more often."""

    def counted(batches):
        of, held = None, []

        def out():
            pairs = _merged(held)
            while block := [x for _, x in zip(range(65_536), pairs, strict=False)]:
                p, t = zip(*block, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([of[0]] * len(p), pa.int32()), pa.array(p, pa.int64()), pa.array(t, pa.int64())], ["part", "pair", "times"])

        for batch in batches:
            for part, group, pairs in zip(*(batch[c].to_pylist() for c in ("part", "group", "pairs")), strict=True):
                if (part, group) != of:
                    if held:
                        yield from out()
                    of, held = (part, group), []
                held.append(pairs)
        if held:
            yield from out()

    runs_of = dealt.select("part", "group", "pairs").repartition("part", "group").sortWithinPartitions("part", "group")
    counts = runs_of.mapInArrow(counted, "part int, pair long, times long").groupBy("part", "pair").agg(F.sum("times").alias("times"))
    counts = written(counts, "counts").withColumn("b", F.expr(f"pair div {size_a}"))
    best = counts.groupBy("b").agg(F.max("times").alias("most"))
    return counts.join(best, "b").select("part", "pair", "times", (F.col("times") == F.col("most")).alias("best"))


def contributions(dealt: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, sums, bests): what the links of one part give to each document of a run, in the order of its documents."""

    def given(batches):
        of, held, known = None, [], None
        for batch in batches:
            parts, groups, kinds = (batch[c].to_numpy() for c in ("part", "group", "kind"))
            change = (parts[1:] != parts[:-1]) | (groups[1:] != groups[:-1]) | (kinds[1:] != kinds[:-1])
            cuts = [0, *(1 + np.flatnonzero(change)).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if (parts[x], groups[x]) != of:
                    of, held, known = (parts[x], groups[x]), [], None
                rows = batch.slice(x, y - x)
                if kinds[x] == 0:
                    held.append([rows[c].to_numpy(zero_copy_only=False) for c in ("pair", "times", "best")])
                    continue
                if known is None:
                    known = [np.concatenate(c) for c in zip(*held, strict=True)]
                    order = np.argsort(known[0])
                    known = [c[order] for c in known]
                out = []
                for run, pairs, docs in zip(*(rows[c].to_pylist() for c in ("run", "pairs", "docs")), strict=True):
                    pair, n_docs, _ = _unpacked(pairs, "<u8", "<u4", "<u8")
                    doc, times = _unpacked(docs, "<u4", "<u4")
                    at = np.repeat(np.searchsorted(known[0], pair.astype(np.int64)), n_docs)
                    times = times.astype(np.int64)
                    sums, bests = np.zeros((2, int(doc.max()) + 1), np.int64)
                    np.add.at(sums, doc, times * known[1][at])
                    np.add.at(bests, doc, times * known[2][at])
                    out.append((run, sums, bests))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), *(pa.array([r[k] for r in out], pa.list_(pa.int64())) for k in (1, 2))], ["run", "sums", "bests"])

    groups = dealt.select("part", "groups").distinct()
    groups = groups.select("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    known = counts.join(F.broadcast(groups), "part")  # a row a group: one for GROUP_RECORDS records
    both = known.select("part", "group", F.lit(0).alias("kind"), "pair", "times", "best", *(F.lit(None).cast(k).alias(c) for c, k in (("run", "string"), ("pairs", "binary"), ("docs", "binary"))))
    none = [F.lit(None).cast(k).alias(c) for c, k in (("pair", "long"), ("times", "long"), ("best", "boolean"))]
    both = both.unionByName(dealt.select("part", "group", F.lit(1).alias("kind"), *none, "run", "pairs", "docs"))
    both = both.repartition("part", "group").sortWithinPartitions("part", "group", "kind")
    return both.mapInArrow(given, "run string, sums array<long>, bests array<long>")


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs; see the module's rules."""
    rows = written(runs(docs, path_a, path_b), "runs")
    dealt = _dealt(rows.where("part >= 0").select("run", "part", "records", "pairs", "docs"))
    counts = written(pair_counts(dealt, aligner(path_a, path_b).size_a), "pair-counts")
    given = contributions(dealt, counts)

    def summed(batches):
        """One run after the other: its documents come first, then what they get."""
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    if held:
                        yield out(*held)
                    held = (row, np.zeros((2, len(row["ids"])), np.int64))
                else:
                    for k, of in enumerate(("bests", "sums")):
                        held[1][k, : len(row[of])] += row[of]
        if held:
            yield out(*held)

    def out(row, given):
        numbers = np.array(row["numbers"], np.int64).reshape(-1, 4).T
        columns = [pa.array(row["ids"], pa.int64()), *(pa.array(c) for c in (*numbers, *given)), pa.array(row["digests"], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    long_list = "array<long>"
    none = [F.lit(None).cast(long_list).alias(c) for c in ("sums", "bests")]
    of_docs = rows.where("part = -1").select("run", F.lit(0).alias("kind"), "ids", "numbers", "digests", *none)
    none = [F.lit(None).cast(k).alias(c) for c, k in (("ids", long_list), ("numbers", long_list), ("digests", "array<string>"))]
    both = of_docs.unionByName(given.select("run", F.lit(1).alias("kind"), *none, "sums", "bests"))
    both = both.repartition("run").sortWithinPartitions("run", "kind").drop("kind")
    return both.mapInArrow(summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
