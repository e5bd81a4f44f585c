import random

import numpy as np
import pytest

from heronry.llm import ngram_join
from heronry.llm.common import WordHashes
from heronry.llm.ngram_join import Points, Tree, fine_point, linked, point, shingles

from .helpers import clashing, docs_of, odd_texts, words


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[k : k + 4]) for k in range(len(w) - 3)])


def brute(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                met = len(sets[a] & sets[b])
                if 100 * met >= 85 * (len(sets[a]) + len(sets[b]) - met):
                    up[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return {(i, len(s), least.get(root(k)) if i is not None else None) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def found(df):
    rows = [tuple(r) for r in linked(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_texts(seed):
    rng = random.Random(seed)
    base = [words(rng, rng.choice([2, 3, 4, 9, 40, 90, 200])) for _ in range(30)]
    cloud = words(rng, 110)  # copies of which some are linked with few others
    texts = base + [changed(rng, rng.choice(base), rng.randrange(4)) for _ in range(50)] + [changed(rng, cloud, rng.randrange(5)) for _ in range(60)] + [cloud.upper()] * 9
    passage = words(rng, 50)
    texts += [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(40)] + odd_texts()
    rng.shuffle(texts)
    return [(7 * i % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block, fan", [(2048, 16), (9, 2)])
def test_equals_all_pairs(spark, monkeypatch, block, fan):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FAN", fan)
    rows = some_texts(block)
    assert found(clashing(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]))) == brute(rows)


def test_equals_all_pairs_in_a_drifting_chain_and_with_frequent_members(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)  # nearly all members of copies are put last
    rng = random.Random(5)
    w = words(rng, 130).split()
    rows = []
    for k in range(40):  # each is linked with the next ones only
        w[3 * k % 130] = f"turn{k}"
        rows.append((100 - k, " ".join(w)))
    rows += [(200 + k, " ".join(w[:n])) for k, n in enumerate(range(60, 131, 3))]  # sizes at the edge of 0.85
    assert found(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])) == brute(rows)


def test_repeated_and_null_ids(spark):
    rng = random.Random(6)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(5, a), (5, a), (5, b), (2, b), (9, changed(rng, a, 1)), (None, a), (None, b), (None, a), (7, None), (7, None), (3, "one two"), (4, "ONE  two")]
    got = found(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]))
    n, m = len(shingle_set(a)), len(shingle_set(b))
    assert (5, n, 5) in got and (9, len(shingle_set(rows[4][1])), 5) in got and (5, m, 2) in got and (2, m, 2) in got
    assert (None, n, None) in got and (7, 0, 7) in got and (4, 1, 3) in got and (3, 1, 3) in got
    assert found(docs_of(spark, [])) == set()


def test_tree_leaves_every_pair_that_the_bound_allows(monkeypatch):
    monkeypatch.setattr(ngram_join, "FAN", 3)
    monkeypatch.setattr(ngram_join, "TOGETHER", 64)
    rng = random.Random(8)
    hashes = WordHashes()
    base = [words(rng, rng.choice([30, 80, 200])) for _ in range(12)]
    sets = [shingles(changed(rng, rng.choice(base), rng.randrange(6)).encode(), hashes) for _ in range(150)]
    sets.sort(key=len)
    own = Points.__new__(Points)
    own.cls, own.n = np.arange(150), np.array([len(s) for s in sets])
    own.counts = np.stack([point(s)[0] * point(s)[1].astype(np.int32) for s in sets])
    own.fine = [fine_point(s) for s in sets]
    own.groups = np.array([len(f) for f in own.fine])
    component = np.array([k // 40 for k in range(150)])
    got = {(int(x), int(y)) for i, j in Tree(own, 0, 150, component).joined() for x, y in zip(i, j, strict=True)}
    i, j = np.triu_indices(150, 1)
    apart = component[i] != component[j]
    i, j, _ = own.near(i[apart], j[apart])
    assert len(i) and {(int(x), int(y)) for x, y in zip(i, j, strict=True)} <= got
    for x, y in zip(i, j, strict=True):
        assert len(np.intersect1d(sets[x], sets[y])) <= own.overlap(np.array([x]), np.array([y]))[0]


def test_points_of_long_sets_stay_bounds():
    rng = np.random.default_rng(3)
    members = np.unique(rng.integers(0, 2**63, 60_000).astype(np.uint64))
    unit, counts = point(members)
    assert unit > 1 and (unit * counts.astype(int) >= np.bincount((members % np.uint64(64)).astype(int), minlength=64)).all()


def test_finer_points_are_bounds():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 9000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, k, replace=False)) for k in (5, 400, 900, 1500, 3000, 8000, 8500)]
    own = Points.__new__(Points)
    own.fine = [fine_point(s) for s in sets]
    own.groups = np.array([len(f) for f in own.fine])
    assert own.groups[0] == 64 and own.groups[-1] == 4096
    i, j = np.triu_indices(len(sets), 1)
    for x, y, most in zip(i, j, own.fine_overlap(i, j), strict=True):
        assert len(np.intersect1d(sets[x], sets[y])) <= most
        assert most <= min(len(sets[x]), len(sets[y])) or min(own.groups[x], own.groups[y]) == 64
    assert fine_point(np.arange(0, 300 * 2**20, 2**20, dtype=np.uint64)) == b""  # one group holds all


def test_a_pair_comes_out_of_the_first_tree_that_it_shares():
    top = np.iinfo(np.int64).max
    own = Points.__new__(Points)
    trees = {-5: (1, 2), 3: (1, 2, 3), 8: (1, 2, 3), 9: (2, 3)}  # the classes of each tree
    own.key, own.cls = (np.array(x) for x in zip(*((key, c) for key, of in trees.items() for c in of), strict=True))
    own.keys = np.full((len(own.cls), ngram_join.FIRST_KEYS), top)
    for row, c in enumerate(own.cls):
        shared = [key for key, of in trees.items() if c in of]
        own.keys[row, : len(shared)] = shared
    i, j = np.triu_indices(len(own.cls), 1)
    one = own.key[i] == own.key[j]
    i, j = i[one], j[one]
    kept = ~own.met_before(i, j)
    first = {(1, 2): -5, (1, 3): 3, (2, 3): 3}
    assert len(i) == 8 and {(own.cls[x], own.cls[y]): own.key[x] for x, y in zip(i[kept], j[kept], strict=True)} == first and kept.sum() == 3
    x, y = own.once([(i[::-1], j[::-1])])  # in whatever order trees come, the smallest key stands for the pair
    assert {(own.cls[a], own.cls[b]): own.key[a] for a, b in zip(x, y, strict=True)} == first


def test_short_sets_have_finer_points_too():
    members = np.random.default_rng(5).integers(0, 2**63, 150).astype(np.uint64)
    assert len(fine_point(members)) == 256
