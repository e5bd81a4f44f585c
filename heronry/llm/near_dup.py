"""Near-duplicate documents: MinHash with tensored banding, every link confirmed on full shingle sets.

Tensored banding takes two small collections of half keys, A_1..A_n and B_1..B_n, each made of `width` minhashes, and
forms a table key from every pair (A_i, B_j): n * n tables from 2 * n * width minhashes. Two documents meet in a table if
some A and some B agree, so a half key that no other document has can be left out before the pairs are formed.

Rules, and what is defined for odd input:
- Words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case. A document's set holds its distinct
  runs of five words; with fewer words the whole sequence is the one member. Whole texts count.
- A null or empty text, or one of white space only, has an empty set and is linked with nothing.
- Links: 100 * |intersection| >= 75 * |union|. A component's id is the smallest doc_id in it.
- Each distinct (doc_id, set) gives a row, so repeated rows give one. Rows with the same doc_id and different sets are
  linked by their sets alone. Rows with a null doc_id are linked with nothing: null component, kept.
- Other columns of the input are not read. An empty table gives an empty result.
Set members are 64-bit hashes of five word hashes; equal sets are found by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, components, drop_written, mixed, quoted, small_batches, without_ids, written

#: Half keys a collection, minhashes a half key: 100 tables from 40 minhashes. A pair at similarity 0.75 meets in at least
#: one table with probability 0.9995, at 0.8 with 0.9999.
HALVES, WIDTH = 10, 2
#: Beside the half keys a sketch goes with each document: its members are dealt into BINS by their first bits, and each bin
#: gives a byte of its least member. Of two sketches the share of equal bytes estimates the similarity, like a sample
#: without replacement of as many members as bins are taken. Candidates need an estimate of at most DEVIATIONS standard
#: deviations below 0.75: 0.64 for long documents, 0.67 for a hundred words, more for few.
BINS, DEVIATIONS = 256, 4.0
#: Members of one table key that are compared by one group; larger keys are dealt over more groups.
BLOCK = 1024
#: Members of one table key beyond which those that are still in different components are compared by their rarest members
#: (rare_keys) and no longer all with all. Both find the same links; from about this size on the former is faster.
OVERFULL = 4 * BLOCK
PERCENT = 75

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SEEDS = np.random.default_rng(20).integers(0, 2**63, 2 * HALVES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted 64-bit members of a text's set."""
    words = text.lower().split()  # of bytes: A-Z, and the six white space characters
    if len(words) < 5:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 5)] if words else [], np.uint64)
    h = hashes.of(words)
    return np.unique(mixed(sum(h[i : len(h) - 4 + i] * m for i, m in enumerate(_MULTIPLIERS))))


def minhashes(members: np.ndarray) -> np.ndarray:
    """The smallest image of the set under each hash function, in pieces of bounded size."""
    least = np.full(len(_SEEDS), 2**64 - 1, np.uint64)
    for at in range(0, len(members), 4096):
        h = members[at : at + 4096, None] * _SEEDS
        least = np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0))
    return least


def sketch(members: np.ndarray) -> np.ndarray:
    """A byte of the least member of each bin, 0 for an empty one; members are sorted."""
    bins = (members >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    least = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out = np.zeros(BINS, np.uint8)
    out[bins[least]] = members[least] % np.uint64(255) + np.uint64(1)
    return out


SIGNATURES = "doc_id long, n_shingles long, digest binary, halves array<long>, brief binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    fold = mixed(np.arange(2 * HALVES, dtype=np.uint64) + np.uint64(77))
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
            members = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", hashes)
            if len(members):
                least = mixed(minhashes(members))
                half = fold.copy()
                for k in range(WIDTH):
                    half = mixed(half ^ least[k::WIDTH])
                rows.append((doc_id, len(members), xxhash.xxh128_digest(members.tobytes()), half.view(np.int64), sketch(members).tobytes() + half.astype("<u4").tobytes()))
            else:
                rows.append((doc_id, 0, b"", np.array([], np.int64), b""))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_shingles", "digest", "halves", "brief"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, halves, brief) of each row; brief is its sketch, then four bytes of each half key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_signatures, SIGNATURES)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(digest, members array<long>) of each row of (doc_id, text)."""

    def sets(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", hashes) for t in batch[0]]
            digests = [xxhash.xxh128_digest(h.tobytes()) for h in found]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], ["digest", "members"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(sets, "digest binary, members array<long>")


def table_keys(classes: DataFrame) -> DataFrame:
    """(cls, key, met, at, n_shingles, brief): a row for each table (`at`: its number) in which the class may meet another
    one, with the number of classes that have its key."""
    halves = classes.select("cls", F.posexplode("halves").alias("i", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    halves = halves.join(shared, "half")
    half = F.struct("i", "half")
    own = halves.groupBy("cls").agg(F.collect_list(F.when(F.col("i") < HALVES, half)).alias("a"), F.collect_list(F.when(F.col("i") >= HALVES, half)).alias("b"))
    keys = own.select("cls", F.explode("a").alias("x"), "b").select("cls", "x", F.explode("b").alias("y"))
    keys = keys.select("cls", F.xxhash64("x.half", "y.half").alias("key"), (F.col("x.i") * HALVES + F.col("y.i") - HALVES).alias("at"))
    shared = keys.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    return keys.join(shared, "key").join(classes.select("cls", "n_shingles", "brief"), "cls")


def _brief(signature: bytes, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The sketches, and parts of the half keys, of n briefs."""
    both = np.frombuffer(signature, np.uint8).reshape(n, -1)
    return both[:, :BINS], np.ascontiguousarray(both[:, BINS:]).view("<u4")


def _near(n: np.ndarray, m: np.ndarray | int, sketches: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How alike, in thousandths, those are that may be linked with one of m shingles each; 0 for others. Sizes must lie within
    3 : 4, and sketches must be alike enough."""
    taken = ((sketches > 0) | (own > 0)).sum(axis=1)
    alike = ((sketches == own) & (own > 0)).sum(axis=1) / taken
    union = (n + m) / 1.75  # of sets that are 0.75 alike
    deviation = np.sqrt(0.75 * 0.25 / taken * np.clip(1 - taken / union, 0, 1))
    near = (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (alike >= 0.749 - DEVIATIONS * deviation)
    return np.where(near, 1 + (999 * alike).astype(np.int64), 0)


def _first_table(halves: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The first table in which each meets the other: that of the first A and the first B that agree."""
    same = (halves == own).reshape(len(halves), 2, HALVES).argmax(axis=2)
    return same[:, 0] * HALVES + same[:, 1]


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in which no run of equal first `keys` columns is cut, with the places where the runs begin, and the end."""

    def begins(rows: pa.Table) -> np.ndarray:
        k = np.stack([rows.column(c).to_numpy() for c in range(keys)])
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


#: Pairs whose sketches are compared at once.
TOGETHER = 8192

PAIRS = "a long, b long, alike long"


def _pairs_batch(a: np.ndarray, b: np.ndarray, alike: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, alike)], ["a", "b", "alike"])


class _Members:
    """The columns of members of table keys as arrays."""

    def __init__(self, rows: pa.Table):
        self.cls, self.n = (rows.column(c).to_numpy() for c in ("cls", "n_shingles"))
        self.sketches, self.halves = _brief(b"".join(rows.column("brief").to_pylist()), rows.num_rows)

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How alike the members i and j are, as _near() tells."""
        out = [np.zeros(0, np.int64)]
        for at in range(0, len(i), TOGETHER):
            x, y = i[at : at + TOGETHER], j[at : at + TOGETHER]
            out.append(_near(self.n[x], self.n[y], self.sketches[x], self.sketches[y]))
        return np.concatenate(out)


def leader_pairs(rows: DataFrame) -> DataFrame:
    """First candidates: each member of a table key with the leader of its key (of its block, in a large key). The leader is
    the member that meets most others over all tables: in a group of varied copies, one near its centre."""

    def pairs(batches):
        for rows, begins in _whole_groups(batches, 2):
            members = _Members(rows)
            lead, all_of_them = np.repeat(begins[:-1], np.diff(begins)), np.arange(rows.num_rows)
            other = np.flatnonzero(lead != all_of_them)
            alike = members.alike(lead[other], other)
            found = alike > 0
            yield _pairs_batch(members.cls[lead[other]][found], members.cls[other][found], alike[found])

    block = F.pmod(F.xxhash64("cls"), F.ceil(F.col("met") / (16 * BLOCK)))
    central = rows.groupBy("cls").agg((-F.sum("met")).alias("place"))
    dealt = rows.join(central, "cls").select("key", block.cast("long").alias("block"), "place", "cls", "n_shingles", "brief").repartition("key", "block")
    return dealt.sortWithinPartitions("key", "block", "place", "cls").mapInArrow(pairs, PAIRS)


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of keys that classes of different components have, with the component of each."""
    rows = rows.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    open_keys = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    return rows.join(open_keys.select("key"), "key")


def rare_keys(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, key, met, at) for classes of (cls, n_shingles) that meet in over-full tables: a key for each of their rarest
    shingles, `at` is -1.

    Shingles are put in order by the number of these classes that have them. Two sets of which one has n members have at
    least 0.75 n in common if they are linked, so the first n - ceil(0.75 n) + 1 of the one and those of the other share a
    shingle: no link between these classes is lost. A passage that unlike texts share is frequent and comes last, so it no
    longer brings them together. The rows grow with the texts of these classes.
    """
    tokens = sets.join(classes, "cls").select("cls", "n_shingles", F.explode("members").alias("key"))
    shared = tokens.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    ranked = F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared")
    listed = tokens.join(shared, "key").groupBy("cls", "n_shingles").agg(ranked)
    # shingles that no other class has come first and need no row
    first = F.size("shared") - F.ceil(F.col("n_shingles") * PERCENT / 100) + 1
    keys = listed.select("cls", F.explode(F.slice("shared", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("x")).select("cls", "x.key")
    met = keys.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    return keys.join(met, "key").withColumn("at", F.lit(-1))


def remaining_pairs(rows: DataFrame, labels: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """Other candidates: pairs that meet in a table and are in different components so far, each in the first table that
    its members share.

    A key's members are dealt into blocks, and blocks meet two at a time, so no task holds a whole large key. Keys whose
    members are all in one component drop out first; what is left of over-full keys meets by rare_keys() instead.
    Comparisons stay inside the tasks, and candidates alone come out; with `best`, of each member the one that is most alike,
    among those that are compared together.
    """

    def pairs(batches):
        for rows, begins in _whole_groups(batches, 3):
            members = _Members(rows)
            component, at, side = (rows.column(c).to_numpy() for c in ("component", "at", "own"))
            low, high = (rows.column(c).to_numpy() for c in ("low", "high"))
            found, n_found = [], 0
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                if low[a] == high[a]:
                    i, j = np.triu_indices(b - a, 1)
                else:
                    left = side[a:b] == low[a]
                    i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(left), np.flatnonzero(~left), indexing="ij"))
                apart = component[a + i] != component[a + j]
                found.append((a + i[apart], a + j[apart]))
                n_found += len(found[-1][0])
                if n_found > 8 * TOGETHER:
                    yield candidates(members, at, found)
                    found, n_found = [], 0
            yield candidates(members, at, found)

    def candidates(members, at, found):
        i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        for keep in (
            lambda: 100 * np.minimum(members.n[i], members.n[j]) >= PERCENT * np.maximum(members.n[i], members.n[j]),
            lambda: (at[i] < 0) | (_first_table(members.halves[i], members.halves[j]) == at[i]),
        ):
            kept = keep() if len(i) else np.zeros(0, bool)
            i, j = i[kept], j[kept]
        alike = members.alike(i, j)
        i, j, alike = i[alike > 0], j[alike > 0], alike[alike > 0]
        a, b = members.cls[i], members.cls[j]
        if not best:
            return _pairs_batch(np.minimum(a, b), np.maximum(a, b), alike)
        a, b, alike = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([alike, alike])
        order = np.lexsort((b, -alike, a))
        first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])] if len(order) else order
        return _pairs_batch(a[first], b[first], alike[first])

    labels = labels.select(F.col("node").alias("cls"), "component")
    overfull = rows.where(F.col("met") > OVERFULL)
    rows = _open(rows.where(F.col("met") <= OVERFULL), labels)
    if not overfull.isEmpty():
        classes = _open(overfull, labels).groupBy("cls").agg(F.first("n_shingles").alias("n_shingles"), F.first("brief").alias("brief"))
        classes = written(classes, "overfull")
        rare = _open(written(rare_keys(classes.select("cls", "n_shingles"), sets), "rare"), labels)
        rows = rows.unionByName(rare.join(classes, "cls"))
    blocks = F.ceil(F.col("met") / BLOCK).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cls", "at", "n_shingles", "component", "brief")
    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(pairs, PAIRS)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that hold on full sets, as (a, b)."""
    first = pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("members").alias("x")), "a")
    both = first.join(sets.select(F.col("cls").alias("b"), F.col("members").alias("y")), "b")
    met = F.size(F.array_intersect("x", "y"))
    return both.where(100 * met >= PERCENT * (F.size("x") + F.size("y") - met)).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each distinct (doc_id, set) of docs; see the module's rules.

    1. One pass over the texts leaves a signature of about 600 bytes a document, as a table.
    2. Equal sets become one class (a partial aggregate, so thousands of copies cost nothing).
    3. Half keys that one class alone has are dropped; the rest form table keys.
    4. Each class is confirmed against its best leader; components are formed.
    5. Each class is confirmed against its best candidate in another component, and components are formed again: this
       merges what belongs together from few pairs. Then every candidate that still lies between different components is
       confirmed, so none is left out.
    """
    with small_batches(docs.sparkSession):
        signed = written(signatures(docs), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "halves", "brief")).alias("first")).select("digest", "first.*")
    clashes = classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("clash"))
    named = F.when(F.col("clash"), -1 - F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")).otherwise(F.col("doc_id"))
    classes = classes.join(clashes, "doc_id", "left").withColumn("clash", F.coalesce("clash", F.lit(False))).withColumn("cls", named)
    classes = written(classes, "classes")
    rows = written(table_keys(classes), "keys")

    first = leader_pairs(rows).groupBy("b").agg(F.max_by("a", F.struct("alike", -F.col("a"))).alias("a"))
    first = written(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first")
    met = rows.select("cls").distinct().join(classes.select("cls", "doc_id", "digest"), "cls")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(met.select("doc_id").distinct(), "doc_id")
    sets = shingle_sets(texts).groupBy("digest").agg(F.first("members").alias("members"))  # an id may have other texts as well
    with small_batches(docs.sparkSession):
        sets = written(sets.join(met.select("cls", "digest"), "digest").select("cls", "members"), "sets")
    links = written(confirmed(first, sets), "confirmed")
    labels = components(links)

    tested, used = first, [rows, first, sets, links]
    for best in (True, False):
        rest = remaining_pairs(rows, labels, sets, best)
        if best:
            rest = rest.groupBy("a").agg(F.max_by("b", F.struct("alike", -F.col("b"))).alias("b"))
        rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = written(rest.join(tested, ["a", "b"], "left_anti"), "rest")
        more = written(confirmed(rest, sets), "confirmed")
        used += [rest, more]
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
        tested = tested.unionByName(rest)
    for table in used:  # what follows reads signatures, classes and labels alone
        drop_written(table)

    found = classes.select("digest", "doc_id", "cls").join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left")
    found = found.withColumn("component", F.coalesce("component", "cls"))
    # a component's id is its least doc_id, unless a class without the name of its own doc_id, which is negative, is in it
    renamed = found.where("component < 0")
    least = renamed.groupBy("component").agg(F.min("doc_id").alias("least"))
    by_set = found.where("component >= 0").select("digest", F.col("component").alias("least")).unionByName(renamed.join(least, "component").select("digest", "least"))
    has_set = F.expr("n_shingles > 0 and doc_id is not null")
    out = signed.select("doc_id", "n_shingles", F.when(has_set, F.col("digest")).alias("digest")).distinct()
    out = out.join(by_set, "digest", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns: of each component the document that gives it its id. Of rows with the
    same doc_id at most one stays (that with the least text); rows with a null doc_id all stay.

    The texts are not shuffled as long as the ids that go are few enough for without_ids() to broadcast them.
    """
    verdicts = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    verdicts = written(verdicts, "verdicts")
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    once = without_ids(docs, verdicts.where("not kept").select("doc_id").unionByName(repeated))
    again = docs.join(repeated.join(verdicts.where("kept"), "doc_id", "left_semi"), "doc_id", "left_semi").select(quoted(docs.columns))
    again = again.groupBy("doc_id").agg(F.min_by(F.struct(*quoted(docs.columns)), F.coalesce("text", F.lit(""))).alias("row"))
    return once.unionByName(again.select("row.*"))
