import random
import zlib

import numpy as np

from heronry.llm.quality import BINS, FEATURES, RIDGE, STATISTICS, WIDTH, pooled, score, statistics

from .helpers import clashing, docs_of, odd_texts, words


def _corpus(n=360):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = words(rng, rng.randrange(30, 200))
        if not good:
            t = rng.choice([t.upper().replace(" ", "!! "), " ".join(w + "###" for w in t.split()), " ".join(t.split()[:5] * 20)])
        texts.append(t)
        labels.append((i, int(good)))
    return texts, labels


def test_learns_and_holds_out(spark):
    texts, labels = _corpus()
    rows = score(clashing(docs_of(spark, texts)), clashing(spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
    assert len(rows) == len(texts)
    y = dict(labels)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.95


def test_labels_held_out_change_nothing(spark):
    texts, labels = _corpus(150)
    df = docs_of(spark, texts)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    one, two = (dict((r["doc_id"], round(r["score"], 9)) for r in score(df, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, flipped))
    assert one == two


def test_odd_input(spark):
    texts = odd_texts() * 2
    ids = [None, *range(len(texts) - 1)]
    for labels in ([], [(0, None), (None, 1)], [(k, 1) for k in range(8)], [(k, k % 2) for k in range(16)]):
        rows = score(docs_of(spark, texts, ids), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
        assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert score(docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_pieces():
    assert statistics(b"").tolist() == [0.0] * STATISTICS
    assert np.isfinite(statistics(b"\n \n")).all() and np.isfinite(statistics(b"x" * 3_000_000)).all()
    x, y = pooled(np.arange(5.0), np.array([4, 4, 4, 4, 4]), np.array([0, 3, 1, 4, 4]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and len(x) == 3


def _risen(at, n, good):
    """Isotonic regression by its min-max formula, with the mean place and the share, half a case of each kind added, of every
    level."""
    mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
    size = range(len(n))
    level = [max(min(mean(a, b) for b in size if b >= i) for a in size if a <= i) for i in size]
    knots, values = [], []
    for v in sorted({round(x, 12) for x in level}):
        one = [i for i in size if round(level[i], 12) == v]
        knots.append((at[one] * n[one]).sum() / n[one].sum())
        values.append((good[one].sum() + 0.5) / (n[one].sum() + 1))
    return np.array(knots), np.maximum.accumulate(values)


def test_equals_one_machine(spark):
    texts, labels = _corpus(400)
    rng = random.Random(5)
    labels = [(i, q if rng.random() < 0.85 else 1 - q) for i, q in labels]  # noise, so that shares fall and are pooled
    texts += odd_texts()
    found = {r["doc_id"]: r["score"] for r in score(docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    x = np.array([statistics((t or "").encode()) for t in texts])
    y = np.array([q for _, q in labels], float)
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i, _ in labels])
    learned = x[: len(y)][fold == 0]
    deviation = learned.std(axis=0)
    deviation[deviation <= 1e-9] = 1.0
    z = np.clip((x - learned.mean(axis=0)) / deviation, -8, 8)
    of = np.random.default_rng(11)  # the operator's own frequencies: they are drawn, not learned
    frequencies = of.normal(size=(STATISTICS, FEATURES)) / (WIDTH * np.sqrt(STATISTICS))
    z = np.sqrt(2 / FEATURES) * np.cos(z @ frequencies + of.uniform(0, 2 * np.pi, FEATURES))
    z = np.hstack([z, np.ones((len(z), 1))])
    # ridge as plain least squares with a row for each penalty
    penalties = np.diag(np.sqrt([RIDGE] * FEATURES + [1e-6]))
    a = np.vstack([z[: len(y)][fold == 0], penalties])
    weights = np.linalg.lstsq(a, np.concatenate([y[fold == 0], np.zeros(FEATURES + 1)]), rcond=None)[0]
    raw = z @ weights
    other, hits = raw[: len(y)][fold == 2], y[fold == 2]
    place = np.floor(np.clip(other, -0.5, 1.5) * BINS / 2)
    bins = [place == b for b in np.unique(place)]
    knots, values = _risen(*(np.array(v) for v in ([other[b].mean() for b in bins], [b.sum() for b in bins], [hits[b].sum() for b in bins])))
    assert 2 < len(values) < len(bins)
    wanted = np.interp(raw, knots, values)
    assert np.allclose([found[i] for i in range(len(texts))], wanted, atol=1e-6)
