"""Similarity join of documents on word 4-grams by count-vector R-trees, every link confirmed on full sets.

A set's members are hashed into GROUPS groups; the number of members in each group is the set's point. The overlap of two
sets is at most the sum over the groups of the smaller count, and that of two boxes of points at most the sum of the smaller
of their greatest counts. An R-tree packs points that are near each other into leaves of FAN, leaves into boxes and so on;
a join of the tree with itself goes down only where the bound still allows a similarity of 0.85, and of the points the
same is asked. What survives is verified on the full sets.

One tree over all documents would be joined with itself in time that grows with the square of their number, as points of
unlike texts of one length lie close together. So there is a forest: a set of n members is a point in the tree of each of
its first n - ceil(0.85 n) + 1 members, in one order of all members. If two sets are linked the two prefixes share a
member, so every link is within a tree. The order puts members that a bounded sample of documents shows to be frequent
(passages that many texts share) last; it decides how large trees get, not what is found.

Rules, and what is defined for odd input:
- Words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case. A document's set holds its distinct
  runs of four words; with fewer words the whole sequence is the one member. Whole texts count.
- A null or empty text, or one of white space only, has an empty set and is linked with nothing.
- Links: 100 * |intersection| >= 85 * |union|. A component's id is the smallest doc_id that links reach, its own included.
- Each distinct (doc_id, set) gives a row, so repeated rows give one. Rows with the same doc_id and different sets are
  linked by their sets alone. Rows with a null doc_id are linked with nothing and have a null component.
- Other columns of the input are not read. An empty table gives an empty result.
Set members are 64-bit hashes of four word hashes; equal sets are found by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, components, drop_written, mixed, written

WORDS, PERCENT = 4, 85
#: Coordinates of a point; children of a box.
GROUPS, FAN = 64, 16
#: The finer points, which bound the pairs that the tree leaves, have a group for each member up to FINE groups, and beyond
#: it one for each IN_GROUP members.
IN_GROUP, FINE = 4, 1024
#: Trees of a class that tell whether a pair comes out of another one; with more trees than that it may come out again.
FIRST_KEYS = 32
#: Documents of the sample that shows which members are frequent, how many of them have such a member at least, and how many are kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 4000, 8, 100_000
#: Points of one tree in one group; those of larger trees are dealt by size, then over more groups.
BLOCK = 2048
#: Documents whose ids are broadcast to pick their texts, at most; about 60 bytes each.
MOST_IDS = 500_000
#: Pairs of boxes or points whose bounds are summed at once.
TOGETHER = 8192

_MULTIPLIERS = [np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0x9FB21C651E98DF25)]
SIGNATURES = "doc_id long, n_shingles long, digest binary, prefix array<long>, unit int, counts binary, fine binary"


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted 64-bit members of a text's set."""
    words = text.lower().split()  # of bytes: A-Z, and the six white space characters
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), WORDS)] if words else [], np.uint64)
    h = hashes.of(words)
    return np.unique(mixed(sum(h[i : len(h) - WORDS + 1 + i] * m for i, m in enumerate(_MULTIPLIERS))))


def prefix(members: np.ndarray, frequent: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The first members, of which linked sets share one: those that aren't frequent first, each by its hash. `marks` has
    the first 20 bits of the frequent ones."""
    n = len(members) - -(-PERCENT * len(members) // 100) + 1
    last = marks[(members >> np.uint64(44)).astype(np.int64)]
    if last.any():
        asked = members[last]
        last[last] = frequent[np.minimum(np.searchsorted(frequent, asked), len(frequent) - 1)] == asked
        return np.concatenate([members[~last], members[last]])[:n]
    return members[:n]


def point(members: np.ndarray) -> tuple[int, np.ndarray]:
    """(unit, counts): the members in each group, in units that fit a byte, rounded up, so that bounds stay bounds."""
    counts = np.bincount((members % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    unit = 1 + (int(counts.max()) - 1) // 255
    return unit, (-(-counts // unit)).astype(np.uint8)


def fine_point(members: np.ndarray) -> bytes:
    """The members in each of so many groups (a power of two of GROUPS) that one holds one on average at most, or IN_GROUP
    where there are FINE groups already; empty if a count passes a byte."""
    groups = GROUPS
    while groups * IN_GROUP < len(members) or groups < min(len(members), FINE):
        groups *= 2
    counts = np.bincount((members % np.uint64(groups)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """The columns of SIGNATURES for each row."""
    marks = np.zeros(1 << 20, bool)
    marks[(frequent >> np.uint64(44)).astype(np.int64)] = True

    def signed(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                members = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", hashes)
                if len(members):
                    unit, counts = point(members)
                    rows.append((doc_id, len(members), xxhash.xxh128_digest(members.tobytes()), prefix(members, frequent, marks).view(np.int64), unit, counts.tobytes(), fine_point(members)))
                else:
                    rows.append((doc_id, 0, b"", np.array([], np.int64), 1, b"", b""))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_shingles", "digest", "prefix", "unit", "counts", "fine"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(signed, SIGNATURES)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, members array<long>) of each row of (doc_id, text)."""

    def sets(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", hashes) for t in batch[1]]
            digests = [xxhash.xxh128_digest(h.tobytes()) for h in found]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(digests, pa.binary()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], ["doc_id", "digest", "members"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(sets, "doc_id long, digest binary, members array<long>")


def sets_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, members) of the classes in `pairs`, as a table. Up to MOST_IDS documents are picked out where they stand."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = written(classes.select("cls", "doc_id", "digest").join(wanted, "cls", "left_semi"), "wanted")
    ids = wanted.select("doc_id").distinct()
    texts = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(ids) if wanted.count() <= MOST_IDS else ids, "doc_id", "left_semi")
    sets = shingle_sets(texts).join(F.broadcast(wanted) if wanted.count() <= MOST_IDS else wanted, ["doc_id", "digest"])  # an id may have other texts as well
    sets = written(sets.select("cls", "members"), "sets")
    drop_written(wanted)
    return sets


def frequent_members(docs: DataFrame) -> np.ndarray:
    """Members that FREQUENT documents or more of a sample of about SAMPLE have, the MOST_FREQUENT most frequent at most;
    sorted."""
    every = max(1, docs.count() // SAMPLE)
    some = shingle_sets(docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)))
    counts = some.select(F.explode("members").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    keys = counts.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).select("key").toArrow().column("key").to_numpy()
    return np.sort(keys.astype(np.int64).view(np.uint64))


def forest(classes: DataFrame) -> DataFrame:
    """(key, met, cls, n, unit, counts, central): the points of each tree that has several; met: the number of its points,
    central: how many others the class meets over all trees.

    Of two linked sets the smaller one, of n members, has 2 * 0.85 / 1.85 * n in common with the other at least, so the member
    that they share stands even in its first n - ceil(1.7 / 1.85 * n) + 1: trees where no set is so early are left out."""
    keys = classes.select("cls", "n_shingles", F.posexplode("prefix").alias("pos", "key"))
    early = F.col("pos") <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * (2 * PERCENT) / (100 + PERCENT) - 1e-9)
    shared = keys.groupBy("key").agg(F.count("*").alias("met"), F.max(early).alias("early")).where("met > 1 and early").select("key", "met")
    points = keys.select("cls", "key").join(shared, "key").join(classes.select("cls", F.col("n_shingles").alias("n"), "unit", "counts"), "cls")
    return points.withColumn("central", F.sum("met").over(Window.partitionBy("cls")))  # a class has as many rows as its prefix


def fits(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of at least n and m members may be linked if they have at most `overlap` in common."""
    return (100 + PERCENT) * overlap >= PERCENT * (n + m)


class Points:
    """The columns of points as arrays."""

    def __init__(self, rows: pa.Table):
        self.cls, self.n = rows.column("cls").to_numpy(), rows.column("n").to_numpy()
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).reshape(-1, GROUPS)
        self.counts = counts * rows.column("unit").to_numpy().astype(np.int32)[:, None]
        self.fine = rows.column("fine").to_pylist() if "fine" in rows.column_names else [b""] * rows.num_rows
        self.groups = np.array([len(f) for f in self.fine], np.int64)
        self.key = rows.column("key").to_numpy()
        if "keys" in rows.column_names:
            sizes = pc.list_value_length(rows.column("keys")).to_numpy()
            self.keys = np.full((rows.num_rows, FIRST_KEYS), np.iinfo(np.int64).max)
            self.keys[np.arange(FIRST_KEYS) < sizes[:, None]] = pc.list_flatten(rows.column("keys")).to_numpy()

    def overlap(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most how many members i and j have in common."""
        out = [np.zeros(0, np.int64)]
        for at in range(0, len(i), TOGETHER):
            out.append(np.minimum(self.counts[i[at : at + TOGETHER]], self.counts[j[at : at + TOGETHER]]).sum(axis=1))
        return np.minimum(np.concatenate(out), np.minimum(self.n[i], self.n[j]))

    def fine_overlap(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same by the finer points, at the smaller number of their groups; no bound where one is missing or has GROUPS."""
        out = np.full(len(i), np.iinfo(np.int64).max)
        groups = np.minimum(self.groups[i], self.groups[j])
        for g in np.unique(groups[groups > GROUPS]):
            at = np.flatnonzero(groups == g)
            own, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            # groups are by remainder, so they fold
            folded = np.stack([np.frombuffer(self.fine[p], np.uint8).reshape(-1, g).sum(axis=0, dtype=np.int32) for p in own])
            x, y, step = place[: len(at)], place[len(at) :], max(1, TOGETHER * GROUPS // int(g))
            for k in range(0, len(at), step):
                out[at[k : k + step]] = np.minimum(folded[x[k : k + step]], folded[y[k : k + step]]).sum(axis=1)
        return out

    def fits_size(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sized = 100 * np.minimum(self.n[i], self.n[j]) >= PERCENT * np.maximum(self.n[i], self.n[j])
        return i[sized], j[sized]

    def once(self, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Each pair of classes once, where they meet in the tree of the smallest key."""
        i, j = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        a, b = np.minimum(self.cls[i], self.cls[j]), np.maximum(self.cls[i], self.cls[j])
        order = np.lexsort((self.key[i], b, a))
        a, b = a[order], b[order]
        order = order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(order) else order
        return i[order], j[order]

    def met_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs of one tree also share a tree of a smaller key, as far as their first keys tell."""
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), TOGETHER):
            part = slice(at, at + TOGETHER)
            x, y, key = self.keys[i[part]], self.keys[j[part]], self.key[i[part]]
            for k in range(FIRST_KEYS):
                out[part] |= (x[:, k] < key) & (x[:, k, None] == y).any(axis=1)
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those pairs that may be linked, and how alike they are at most, in thousandths."""
        i, j = self.fits_size(i, j)
        overlap = self.overlap(i, j)
        kept = fits(overlap, self.n[i], self.n[j])
        i, j, overlap = i[kept], j[kept], overlap[kept]
        overlap = np.minimum(overlap, self.fine_overlap(i, j))
        kept = fits(overlap, self.n[i], self.n[j])
        i, j, overlap = i[kept], j[kept], overlap[kept]
        return i, j, 1000 * overlap // (self.n[i] + self.n[j] - overlap)


class Tree:
    """An R-tree packed over the points [a, b), which are in order of components and sizes."""

    def __init__(self, points: Points, a: int, b: int, component: np.ndarray):
        self.points, self.at, self.component = points, a, component[a:b]
        n = points.n[a:b]
        # (greatest counts, least size, greatest size, least component, greatest component) of the boxes of each level
        self.levels = [(points.counts[a:b], n, n, self.component, self.component)]
        while len(self.levels[-1][1]) > 1:
            low = self.levels[-1]
            starts = np.arange(0, len(low[1]), FAN)
            most, least = np.maximum.reduceat, np.minimum.reduceat
            self.levels.append((most(low[0], starts, axis=0), least(low[1], starts), most(low[2], starts), least(low[3], starts), most(low[4], starts)))

    def _open(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of boxes may hold a link between different components."""
        counts, least, most, first, last = self.levels[level]
        apart = (first[i] != last[j]) | (first[j] != last[i])
        sized = (100 * most[i] >= PERCENT * least[j]) & (100 * most[j] >= PERCENT * least[i])
        at = np.flatnonzero(apart & sized)
        kept = []
        for part in np.split(at, range(TOGETHER, len(at), TOGETHER)):
            overlap = np.minimum(counts[i[part]], counts[j[part]]).sum(axis=1)
            kept.append(part[fits(np.minimum(overlap, np.minimum(most[i[part]], most[j[part]])), least[i[part]], least[j[part]])])
        return np.concatenate(kept)

    def joined(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points, each once, whose leaves the bounds don't keep apart."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                kept = (i < j) & (self.component[i] != self.component[j])
                yield self.at + i[kept], self.at + j[kept]
                continue
            kept = self._open(level, i, j)
            i, j = i[kept], j[kept]
            size = len(self.levels[level - 1][1])
            for at in range(0, len(i), TOGETHER // FAN):
                x, y = (FAN * of[at : at + TOGETHER // FAN, None, None] for of in (i, j))
                x, y = (z.ravel() for z in np.broadcast_arrays(x + np.arange(FAN)[:, None], y + np.arange(FAN)))
                kept = (x < size) & (y < size) & (x <= y)
                stack.append((level - 1, x[kept], y[kept]))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in which no run of equal `keys` is cut, with the places where the runs begin, and the end."""

    def begins(rows: pa.Table) -> np.ndarray:
        k = np.stack([rows.column(c).to_numpy() for c in keys])
        return np.concatenate([[0], 1 + np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)), [rows.num_rows]])

    held = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            at = begins(held)
            if len(at) > 2:
                yield held.slice(0, at[-2]), at[:-1]
                held = held.slice(at[-2])
    if held is not None:
        yield held, begins(held)


PAIRS = "a long, b long, alike long"


def _pairs(a: np.ndarray, b: np.ndarray, alike: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (a, b, alike)], ["a", "b", "alike"])


def leader_pairs(points: DataFrame) -> DataFrame:
    """First candidates: each point of a tree with the tree's most central one, where the bound allows a link. Large trees
    have several, each for a part of the points."""

    def pairs(batches):
        for rows, begins in _whole_groups(batches, ["key", "block"]):
            own = Points(rows)
            lead = np.repeat(begins[:-1], np.diff(begins))
            i, j, alike = own.near(lead[lead != np.arange(len(lead))], np.flatnonzero(lead != np.arange(len(lead))))
            yield _pairs(own.cls[i], own.cls[j], alike)

    block = F.pmod(F.xxhash64("cls"), F.ceil(F.col("met") / (16 * BLOCK))).cast("long")
    dealt = points.select("key", block.alias("block"), "central", "cls", "n", "unit", "counts").repartition("key", "block")
    return dealt.sortWithinPartitions("key", "block", F.desc("central"), "cls").mapInArrow(pairs, PAIRS)


def _dealt(points: DataFrame) -> DataFrame:
    """The points of trees with (zone, low, high, own). Trees of more than BLOCK points are dealt into zones by size: linked
    sizes lie in one step of 1 / 0.85 or in two that follow, so a point is in the zone of its step and visits the next.
    Zones of more than BLOCK points are dealt into blocks, which meet two at a time."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")
    sized = points.withColumn("step", step)
    few = sized.where(F.col("met") <= BLOCK).withColumns({"zone": F.lit(-1), "blocks": F.lit(1).cast("long")})
    many = sized.where(F.col("met") > BLOCK).withColumn("zone", F.explode(F.array("step", F.col("step") + 1)))
    zones = many.groupBy("key", "zone").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    rows = few.unionByName(many.join(zones, ["key", "zone"]))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")


def tree_pairs(points: DataFrame, labels: DataFrame, classes: DataFrame, best: bool) -> DataFrame:
    """Candidates: pairs of points of one tree, in different components so far, that the join of the tree with itself leaves.
    With `best`, of each point the most alike, among those that are compared together. Trees whose points are all in one
    component drop out first."""

    def pairs(batches):
        for rows, begins in _whole_groups(batches, ["first", "zone", "low", "high"]):
            own = Points(rows)
            component, step, zone, side, low, high, key = (rows.column(c).to_numpy() for c in ("component", "step", "zone", "own", "low", "high", "key"))
            trees = np.union1d(begins, 1 + np.flatnonzero(key[1:] != key[:-1]))
            held, n_held = [], 0
            for a, b in zip(trees[:-1].tolist(), trees[1:].tolist(), strict=True):
                if b - a <= FAN:  # one leaf
                    i, j = np.triu_indices(b - a, 1)
                    found = [(a + i, a + j)]
                else:
                    found = Tree(own, a, b, component).joined()
                for i, j in found:
                    kept = component[i] != component[j]
                    if low[a] != high[a]:  # pairs within one of the two blocks meet where the block meets itself
                        kept &= side[i] != side[j]
                    if zone[a] >= 0:  # visitors meet each other in their own zone
                        kept &= (step[i] == zone[a]) | (step[j] == zone[a])
                    held.append(own.fits_size(i[kept], j[kept]))
                    n_held += len(held[-1][0])
                    if n_held > 64 * TOGETHER:
                        held = [own.once(held)]
                        n_held = len(held[0][0])
                        if n_held > 32 * TOGETHER:
                            yield candidates(own, held)
                            held, n_held = [], 0
            if n_held:
                yield candidates(own, [own.once(held)])

    def candidates(own, held):
        i, j, alike = own.near(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        a, b = np.minimum(own.cls[i], own.cls[j]), np.maximum(own.cls[i], own.cls[j])
        if best:
            a, b, alike = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([alike, alike])
            order = np.lexsort((b, -alike, a))
            order = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(order) else order
            return _pairs(a[order], b[order], alike[order])
        kept = ~own.met_before(i, j)  # a pair comes out of the first tree that it shares
        return _pairs(a[kept], b[kept], alike[kept])

    labels = labels.select(F.col("node").alias("cls"), "component")
    rows = points.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    ends = F.min("component").alias("least"), F.max("component").alias("most"), F.min("cls").alias("first")
    open_keys = rows.groupBy("key").agg(*ends).where("least < most").select("key", "first")
    rows = rows.join(open_keys, "key")
    dealt = _dealt(rows)
    dealt = dealt.select("first", "key", "zone", "low", "high", "own", "step", "cls", "component", "n", "unit", "counts")
    if not best:  # where every pair comes out, not the best alone
        keys = rows.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS).alias("keys"))  # of one prefix
        dealt = dealt.join(classes.select("cls", "fine"), "cls").join(keys, "cls")
    # trees of one group of copies mostly have the same least class: they are joined together, so most pairs meet once
    dealt = dealt.repartition("first", "zone", "low", "high").sortWithinPartitions("first", "zone", "low", "high", "key", "component", "n", "cls")
    return dealt.mapInArrow(pairs, PAIRS)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that hold on full sets, as (a, b). A class of repeated rows may have its set several times."""
    first = pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("members").alias("x")), "a")
    both = first.join(sets.select(F.col("cls").alias("b"), F.col("members").alias("y")), "b")
    met = F.size(F.array_intersect("x", "y"))
    return both.where(100 * met >= PERCENT * (F.size("x") + F.size("y") - met)).select("a", "b").distinct()


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    sets = sets_of(pairs, classes, docs)
    links = written(confirmed(pairs, sets), "confirmed")
    drop_written(sets)
    return links


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each distinct (doc_id, set) of docs; see the module's rules.

    1. A pass over a sample's texts shows frequent members, one over all texts leaves the point and the prefix of each.
    2. Equal sets become one class (a partial aggregate), and classes become points of the trees of their prefix.
    3. Each class is confirmed against the leader of a tree that it is most alike to, then, after components are formed,
       against its best partner in another one. So a group of copies of any size comes together from few pairs.
    4. Every pair that the trees leave between different components is confirmed, so no link is left out.
    """
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, frequent_members(docs)), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "n_shingles", "unit", "counts", "fine", "prefix")).alias("first")
    classes = full.groupBy("digest").agg(first).select("digest", "first.*")
    clashes = classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("clash"))
    named = F.when(F.col("clash"), -1 - F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")).otherwise(F.col("doc_id"))
    classes = written(classes.join(clashes, "doc_id", "left").withColumn("cls", named), "classes")
    points = written(forest(classes), "points")

    lead = leader_pairs(points).groupBy("b").agg(F.max_by("a", F.struct("alike", -F.col("a"))).alias("a"))
    lead = written(lead.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "leaders")
    links = _links(lead, classes, docs)
    labels, tested, used = components(links), lead, [points, lead, links]
    for best in (True, False):
        rest = tree_pairs(points, labels, classes, best)
        if best:
            rest = rest.groupBy("a").agg(F.max_by("b", F.struct("alike", -F.col("b"))).alias("b"))
        rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = written(rest.join(tested, ["a", "b"], "left_anti"), "candidates")
        more = _links(rest, classes, docs)
        used += [rest, more]
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
        tested = tested.unionByName(rest)
    for table in used:  # what follows reads signatures, classes and labels alone
        drop_written(table)

    found = classes.select("digest", "doc_id", "cls").join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left")
    found = found.withColumn("component", F.coalesce("component", "cls"))
    # a component's name is its least class, which isn't its least doc_id if it is the negative name of a clash
    renamed = found.where("component < 0")
    least = renamed.groupBy("component").agg(F.min("doc_id").alias("least"))
    by_set = found.where("component >= 0").select("digest", F.col("component").alias("least")).unionByName(renamed.join(least, "component").select("digest", "least"))
    has_set = F.expr("n_shingles > 0 and doc_id is not null")
    out = signed.select("doc_id", "n_shingles", F.when(has_set, F.col("digest")).alias("digest")).distinct()
    return out.join(by_set, "digest", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
