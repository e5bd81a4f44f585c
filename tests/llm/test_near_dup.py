import random
from collections import defaultdict

import numpy as np
import pytest

from heronry.llm import near_dup
from heronry.llm.common import components
from heronry.llm.near_dup import _near, keep_one_of_each, near_duplicates, sketch

from .helpers import clashing, docs_of, odd_texts, words


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute(rows):
    """Component of each row of (doc_id, text), by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            met = len(sets[a] & sets[b])
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * met >= 75 * (len(sets[a]) + len(sets[b]) - met):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for k in range(len(rows)):
        if rows[k][0] is not None:
            least[root(k)].append(rows[k][0])
    return {(i, len(s), min(least[root(k)]) if least[root(k)] else None) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}


def varied(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def found(df):
    return {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()}


def test_equals_all_pairs(spark):
    rng = random.Random(3)
    base = [words(rng, rng.choice([3, 12, 60, 150])) for _ in range(30)]
    cloud = words(rng, 120)  # a cloud of copies, some of them linked with a few others only
    texts = base + [varied(rng, rng.choice(base[:20]), rng.randrange(4)) for _ in range(40)] + [varied(rng, cloud, rng.randrange(7)) for _ in range(60)] + [cloud.upper()] * 20
    texts += odd_texts()
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    assert found(clashing(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]))) == brute(rows)


@pytest.mark.parametrize("overfull", [10**6, 12])
def test_many_blocks_of_a_key(spark, monkeypatch, overfull):
    """Keys of many more members than a block holds: copies in a cloud, and texts that share a passage without being alike;
    compared block by block, and by their rarest shingles."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "TOGETHER", 50)
    monkeypatch.setattr(near_dup, "OVERFULL", overfull)
    rng = random.Random(7)
    cloud, passage = words(rng, 100, 5000), words(rng, 60, 5000)
    texts = [varied(rng, cloud, rng.randrange(8)) for _ in range(120)] + [passage + " " + words(rng, rng.choice([15, 30, 60]), 9000) for _ in range(120)]
    rows = list(enumerate(texts))
    assert found(docs_of(spark, texts)) == brute(rows)


def test_rare_keys_lose_no_link(spark):
    """Every pair that is alike shares one of its rarest shingles; texts with nothing but a passage in common share none."""
    rng = random.Random(8)
    passage = words(rng, 60, 5000)
    texts = [passage + " " + words(rng, 40, 10**6) for _ in range(40)]
    texts += [varied(rng, rng.choice(texts), rng.randrange(1, 5)) for _ in range(60)] + [words(rng, k, 30) for k in (1, 2, 5, 6, 8)]
    sets = {k: [hash(x) for x in shingle_set(t)] for k, t in enumerate(texts)}
    sets[200] = sets[4][:]
    rows = spark.createDataFrame(list(sets.items()), "cls long, members array<long>")
    keys = near_dup.rare_keys(rows.selectExpr("cls", "cast(size(members) as long) n_shingles"), rows).collect()
    meet = defaultdict(set)
    for r in keys:
        meet[r["key"]].add(r["cls"])
    assert all(r["met"] == len(meet[r["key"]]) and r["at"] == -1 for r in keys)
    pairs = {(a, b) for group in meet.values() for a in group for b in group if a < b}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))}
    assert alike and alike <= pairs
    assert not any(a < b < 40 for a, b in pairs)


def test_repeated_and_null_ids(spark):
    rng = random.Random(4)
    a, b = words(rng, 30), words(rng, 30)
    rows = [(5, a), (5, a), (5, b), (2, b), (None, a), (9, a + " more"), (9, a + " more")]
    assert found(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])) == brute(rows)


def test_other_texts_of_an_id_do_not_stand_in(spark):
    rng = random.Random(6)
    rows = []
    for k in range(12):  # 100 + k stands with a text of its own and with one that goes by the smaller id k
        own, other = words(rng, 60), words(rng, 60)
        both = [(100 + k, own), (100 + k, other)]
        rows += (both if k % 2 else both[::-1]) + [(k, other), (200 + k, varied(rng, own, 1)), (300 + k, varied(rng, other, 1))]
    assert found(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])) == brute(rows)


def test_no_rows(spark):
    assert near_duplicates(docs_of(spark, [])).count() == 0
    assert keep_one_of_each(docs_of(spark, [])).count() == 0


def test_one_of_each_stays(spark):
    rng = random.Random(5)
    a, b = words(rng, 40), words(rng, 40)
    df = docs_of(spark, [a, a, varied(rng, a, 1), b, b, None, "", a], [8, 3, 4, 7, 7, 1, 2, None])
    stays = keep_one_of_each(df)
    assert stays.columns == df.columns
    assert sorted((r["doc_id"] for r in stays.collect()), key=str) == [1, 2, 3, 7, None]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(300, 299), (299, 299), (None, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_whose_ids_rise_along_them(spark):
    starts = {0: (300, 1), 10_000: (5000, 1), 20_000: (3000, 3), 30_000: (3000, 5)}  # nodes, and to how many next ones each is linked
    links = [(at + i, at + i + k) for at, (n, reach) in starts.items() for i in range(n) for k in range(1, reach + 1) if i + k < n]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {at + i: at for at, (n, _) in starts.items() for i in range(n)}


def test_sketch_filter_keeps_what_is_alike():
    rng = np.random.default_rng(1)
    for size in (1, 4, 7, 20, 150, 3000):
        for _ in range(60):
            members = np.unique(rng.integers(0, 2**64, 2 * size, dtype=np.uint64))
            rng.shuffle(members)
            common = -(-3 * size // 4)  # 0.75 alike: the rest of the union is dealt to the two sides
            rest = members[common:size]
            half = len(rest) // 2
            a, b = np.sort(np.concatenate([members[:common], rest[:half]])), np.sort(np.concatenate([members[:common], rest[half:]]))
            assert _near(np.array([len(b)]), len(a), sketch(b)[None], sketch(a))[0] > 0
            if size >= 150:
                c = np.sort(np.concatenate([members[: size // 2], members[size : size + size // 2]]))
                assert _near(np.array([len(c)]), len(a), sketch(c)[None], sketch(a))[0] == 0
