"""Hard negatives by an inverted multi-index: two codebooks of half vectors form cells, which a heap visits by their bounds.

The halves of all vectors are assigned to the nearest of CODES centres each; a pair of centres is a cell. For a query, a
centre's bound is its inner product with the query's half, plus the half's length times the centre's radius, and a cell's
bound is the sum of its two. No row of the cell scores more, so cells are visited in falling order of bounds (a heap over
the two sorted lists, each pop of which pushes the next of either list) until no cell that is left can change a result:
1. A first visit goes to the best cells, until SEED rows are in reach, and leaves a floor for each window of the query:
   the score of the last row that it would return.
2. The second visit goes on where the first stopped and ends at the first cell whose bound is below every floor; then the
   windows are certified. Cells whose least possible score lies above every window are passed over.
So results are those of a comparison with all rows. The centres are fitted on at most SAMPLE rows, the first by the hash of
their id; they decide how many cells are visited and never what is found. All rows are indexed.

Rules, and what is defined for odd input:
- Rows with a null vec_id, label or vector, with a null or non-finite component, or with a component that isn't within
  +-LARGEST after scaling, take no part, and neither do vectors of another length than most have (of two lengths that are
  equally frequent, the greater stays). Of rows with the same vec_id that with the least (label, vector) takes part.
- Where vec_id is divisible by 7 the label becomes (label + 1) % 10. Components become floor(256 * x); a score is the
  integer inner product. Higher scores come first, of equal ones smaller vec_id.
- Anchors have a vec_id that is divisible by 50. Positives: the first POSITIVES other rows of the anchor's label, or all if
  there are fewer. Negatives: the first NEGATIVES rows of another label within 50 to 95 percent of the positive's score.
  An anchor without positives, and a positive without negatives, gives no rows.
- Equal vectors of one label are kept only as often as a result can name them (POSITIVES + 1), those with the least ids.
- Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Centres of each half; rows that they are fitted on, at most.
CODES, SAMPLE = 32, 16_384
#: Rows in the cells of the first visit.
SEED = 2048
#: Rows of a cell that one group holds; larger cells are dealt over more groups.
BLOCK = 4096
POSITIVES, NEGATIVES = 5, 3
LARGEST = 2**26
_LEAST, _MOST = -(2**62), 2**62

ROWS = "vec_id long, label long, q binary"


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q holds the scaled components as little-endian 32-bit numbers."""
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))

    def scaled(batches):
        for batch in batches:
            lists = batch[2]
            lengths = np.diff(lists.offsets.to_numpy())
            values = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null is a NaN here
            bad = np.concatenate([[0], np.cumsum(~(np.abs(values) <= LARGEST))])
            ends = np.cumsum(lengths)
            good = np.flatnonzero((bad[ends] == bad[ends - lengths]) & (lengths > 0))
            whole = np.where(np.abs(values) <= LARGEST, values, 0).astype("<i4").tobytes()
            q = [whole[4 * (ends[k] - lengths[k]) : 4 * ends[k]] for k in good]
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(good)), batch[1].take(pa.array(good)), pa.array(q, pa.binary())], ["vec_id", "label", "q"])

    rows = written(rows.mapInArrow(scaled, ROWS), "vectors")
    usual = rows.groupBy(F.length("q").alias("size")).agg(F.count("*").alias("n")).agg(F.max_by("size", F.struct("n", "size")).alias("size")).first()["size"]
    rows = rows.where(F.length("q") == F.lit(usual))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")


def matrix(column) -> np.ndarray:
    """The vectors of a binary column."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<i4").reshape(len(column), -1).astype(np.float64)


def centres(points: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """The means of n clusters of points, by Lloyd's iterations from points spread over the input's order."""
    found = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(points, found)[0]
        sums, counts = np.zeros_like(found), np.bincount(own, minlength=len(found))
        np.add.at(sums, own, points)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def nearest(points: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest centre and its distance."""
    square = (to**2).sum(axis=1) - 2 * points @ to.T
    own = square.argmin(axis=1)
    return own, np.sqrt(((points - to[own]) ** 2).sum(axis=1))


class Index(NamedTuple):
    """What a query needs to find its cells: of fixed size, whatever the number of rows."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray

    def visits(self, q: np.ndarray, most: float) -> Iterator[tuple[float, int]]:
        """(bound, cell) in falling order of bounds, by the multi-sequence heap. Empty cells are left out, and those where
        every score is above `most`."""
        halves = np.split(q, [self.books[0].shape[1]])
        sides, lows = [], []
        for half, book, radius in zip(halves, self.books, self.radii, strict=True):
            middle, spread = book @ half, np.linalg.norm(half) * radius
            order = np.argsort(-(middle + spread), kind="stable")
            sides.append((order, (middle + spread)[order]))
            lows.append(middle - spread)
        (first, upper), (second, lower) = sides
        heap, width = [(-(upper[0] + lower[0]), 0, 0)], len(second)
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < width:
                heapq.heappush(heap, (-(upper[i] + lower[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):  # each cell is pushed once: by its left neighbour, those of the first column by the one above
                heapq.heappush(heap, (-(upper[i + 1] + lower[0]), i + 1, 0))
            cell = int(first[i]) * width + int(second[j])
            if self.counts[cell] and lows[0][first[i]] + lows[1][second[j]] - 1 <= most:  # 1: more than what rounding can change
                yield 1 - bound, cell


def indexed(vectors: DataFrame) -> tuple[DataFrame, Index]:
    """The rows of `vectors` with the cell and block of each, as a table, and the index."""
    kept = F.row_number().over(Window.partitionBy("q", "label").orderBy("vec_id"))
    vectors = vectors.withColumn("copy", kept).where(F.col("copy") <= POSITIVES + 1).drop("copy")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").toArrow()
    points = matrix(sample.column("q").combine_chunks()) if sample.num_rows else np.zeros((1, 2))
    middle = points.shape[1] // 2
    books = tuple(centres(half, CODES) for half in (points[:, :middle], points[:, middle:]))

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch[2])
                codes = [nearest(half, book) for half, book in zip((x[:, :middle], x[:, middle:]), books, strict=True)]
                extra = [pa.array(codes[0][0].astype(np.int32)), pa.array(codes[1][0].astype(np.int32)), pa.array(codes[0][1]), pa.array(codes[1][1])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["vec_id", "label", "q", "i", "j", "from_i", "from_j"])

    rows = written(vectors.mapInArrow(coded, f"{ROWS}, i int, j int, from_i double, from_j double"), "coded")
    radii = []
    for code, book in zip("ij", books, strict=True):
        radius = np.zeros(len(book))
        for r in rows.groupBy(code).agg(F.max(f"from_{code}").alias("most")).collect():  # a row a centre
            radius[r[code]] = r["most"]
        radii.append(radius)
    cell = F.col("i") * len(books[1]) + F.col("j")
    sizes = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in sizes.collect():  # a row a cell
        counts[r["cell"]] = r["n"]
    dealt = rows.select("vec_id", "label", "q", cell.alias("cell")).join(F.broadcast(sizes), "cell")  # CODES ** 2 rows at most
    block = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / BLOCK)).cast("int")
    return dealt.select("cell", block.alias("block"), "vec_id", "label", "q"), Index(books, tuple(radii), counts)


def _requests(queries: DataFrame, index: Index, rest: bool) -> DataFrame:
    """(cell, block, vec_id, label, q, floors, tops): a row for each block of each cell that a query of (vec_id, label, q,
    lows, tops, floors) visits, on its first visit or on the rest."""

    def visited(batches):
        for batch in batches:
            at, cells, blocks = [], [], []
            lows, tops, floors = (batch[c].to_pylist() for c in (3, 4, 5))
            for k, q in enumerate(matrix(batch[2]) if batch.num_rows else ()):
                if not lows[k]:
                    continue
                least, floor, seen = min(lows[k]), min(floors[k]), 0
                for bound, cell in index.visits(q, max(tops[k])):
                    first = seen < SEED
                    if bound < (least if first else floor) or (not first and not rest):
                        break
                    seen += index.counts[cell]
                    if first != rest:
                        n = -(-index.counts[cell] // BLOCK)
                        at += [k] * n
                        cells += [cell] * n
                        blocks += range(n)
            own = [batch[c].take(pa.array(at, pa.int64())) for c in (0, 1, 2, 5, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(blocks, pa.int32()), *own], ["cell", "block", "vec_id", "label", "q", "floors", "tops"])

    return queries.select("vec_id", "label", "q", "lows", "tops", "floors").mapInArrow(visited, f"cell int, block int, {ROWS}, floors array<long>, tops array<long>")


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


FOUND = "anchor_id long, slot int, found_id long, score long"


def _answers(requests: DataFrame, rows: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, slot, found_id, score): for each request and window its k best rows of one block."""

    def answer(held: pa.Table, asked: pa.RecordBatch):
        ids, labels = held["vec_id"].to_numpy(), held["label"].to_numpy()
        own = matrix(held["q"].combine_chunks())
        for at in range(0, asked.num_rows, 256):
            part = asked.slice(at, 256)
            anchors = part["vec_id"].to_numpy()
            scores = _scores(matrix(part["q"]), own)
            fits = (labels == part["label"].to_numpy()[:, None]) == same
            fits &= ids != anchors[:, None]
            floors, tops = part["floors"].to_pylist(), part["tops"].to_pylist()
            for slot in range(max(map(len, floors))):
                low, top = (np.array([w[slot] if slot < len(w) else out for w in of])[:, None] for of, out in ((floors, _MOST), (tops, _LEAST)))
                inside = np.where(fits & (scores >= low) & (scores <= top), scores, _LEAST)
                best = np.argsort(-inside, axis=1, kind="stable")[:, :k]  # the block's rows are in order of ids
                value = np.take_along_axis(inside, best, 1)
                who, place = np.nonzero(value > _LEAST)
                if len(who):
                    columns = (anchors[who], np.full(len(who), slot, np.int32), ids[best[who, place]], value[who, place])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "slot", "found_id", "score"])

    def answers(batches):
        held, of, parts = None, None, []
        for batch in batches:
            cells, blocks, kinds = (batch[c].to_numpy() for c in ("cell", "block", "kind"))
            change = (cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])
            cuts = [0, *(1 + np.flatnonzero(change)).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                group, part = (cells[a], blocks[a]), batch.slice(a, b - a)
                if group != of:
                    held, of, parts = None, group, []
                if kinds[a] == 0:
                    parts.append(part)
                elif parts:
                    if held is None:
                        held = pa.Table.from_batches(parts).sort_by("vec_id")
                    yield from answer(held, part)

    none = F.lit(None).cast("array<long>")
    both = rows.select("cell", "block", F.lit(0).alias("kind"), "vec_id", "label", "q", none.alias("floors"), none.alias("tops"))
    both = both.unionByName(requests.withColumn("kind", F.lit(1)))
    both = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return both.mapInArrow(answers, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window, with their place."""
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "found_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def search(queries: DataFrame, rows: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """(anchor_id, slot, found_id, score, place): for each of `queries` (vec_id, label, q, lows, tops) and each window
    (lows[slot] to tops[slot]) the k best rows of the same label, or of others, itself aside."""
    queries = written(queries.withColumn("floors", F.col("lows")), "queries")
    seeds = written(_first(_answers(_requests(queries, index, False), rows, same, k), k), "seeds")
    last = seeds.where(F.col("place") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("last"))
    raised = queries.join(last.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left")
    floors = F.transform("lows", lambda low, slot: F.coalesce(F.col("last")[slot], low))
    rest = _answers(_requests(raised.withColumn("floors", floors), index, True), rows, same, k)
    return _first(seeds.drop("place").unionByName(rest), k)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see the module's rules."""
    vectors = written(quantised(embeddings), "rows")
    rows, index = indexed(vectors)
    anchors = vectors.where(F.col("vec_id") % 50 == 0)
    whole = F.array(F.lit(_LEAST + 1)), F.array(F.lit(_MOST))
    positives = search(anchors.withColumns({"lows": whole[0], "tops": whole[1]}), rows, index, True, POSITIVES)
    positives = written(positives.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("place") - 1).alias("slot")), "positives")
    score = F.col("positive_score")
    low, top = F.ceil(score * 50 / F.lit(100)).cast("long"), F.floor(score * 95 / F.lit(100)).cast("long")
    windows = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", low.alias("low"), top.alias("top")))).alias("w"))  # POSITIVES at most
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    asked = asked.select("vec_id", "label", "q", F.col("w.low").alias("lows"), F.col("w.top").alias("tops"))
    negatives = search(asked, rows, index, False, NEGATIVES).join(positives, ["anchor_id", "slot"])
    return negatives.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
