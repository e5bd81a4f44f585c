import random

import numpy as np
from pyspark.sql import functions as F

from heronry.llm.toxicity import fit, fitted, graded_by_other_half, score, without_toxic

from .helpers import clashing, docs_of, odd_texts, words


def _corpus(n=500):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 120), 3000).split()
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["Idiot,", "scum", "lowei" + rng.choice("abcdefgh") * 3]))
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    return texts, labels


def test_learns_words_and_stems(spark):
    texts, labels = _corpus()
    texts += ["all is well here", "you " + "loweizzz", words(random.Random(9), 20_000, 3000), "IDIOT!"]
    df = clashing(docs_of(spark, texts))
    out = score(df, fit(df, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert set(out.columns) == set(df.columns) | {"toxic_probability", "expected_severity", "toxic"}
    rows = {r["doc_id"]: r for r in out.collect()}
    assert np.mean([rows[i]["toxic"] == bool(t) for i, t in labels]) > 0.98
    assert [rows[500 + k]["toxic"] for k in range(4)] == [False, True, False, True]
    assert all(0 <= r["expected_severity"] <= 3 and 0 <= r["toxic_probability"] <= 1 for r in rows.values())


def test_thresholds_are_ordered_and_gradient_rises():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(6) < 0.3) for _ in range(400)]
    grades = np.array([min(3, len(r)) for r in rows])
    w, t = fitted(rows, grades, 6)
    assert (np.diff(t) > 0).all() and (w > 0).all()


def test_fit_is_a_maximum():
    """No coordinate, moved either way, raises the penalised likelihood, which is written here anew."""
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(5) < 0.4) for _ in range(300)]
    grades = np.array([min(3, max(0, len(r) - 1 + int(rng.integers(-1, 2)))) for r in rows])
    w, t = fitted(rows, grades, 5, steps=3000)

    def likelihood(w, t):
        out = 0.0
        for r, g in zip(rows, grades, strict=True):
            above = [1.0, *(1 / (1 + np.exp(t[k] - w[r].sum())) for k in range(3)), 0.0]
            out += np.log(above[g] - above[g + 1]) * 0.5 / ((grades > 0).sum() if g else (grades == 0).sum())
        return out - 5e-4 / 2 * (w**2).sum()

    best = likelihood(w, t)
    for k in range(8):
        for move in (-0.1, 0.1):
            v, u = w.copy(), t.copy()
            (v if k < 5 else u)[k if k < 5 else k - 5] += move
            assert likelihood(v, u) < best + 1e-6


def test_grades_come_from_the_other_half():
    rows = [np.array(r, np.int64) for r in ([0], [0, 1], [0, 1, 2], [3], [0], [0, 1], [0, 1, 2], [3], [], [0])]
    toxic = np.array([True] * 3 + [False] + [True] * 3 + [False] * 3)
    half = np.array([0, 0, 0, 0, 1, 1, 1, 1, 0, 1])
    grades = graded_by_other_half(rows, toxic, half, 4)
    assert (grades[~toxic] == 0).all() and list(grades[:3]) == list(grades[4:7]) == [1, 2, 3]
    turned = toxic.copy()
    turned[half == 0] = [True, True, True, True, False]  # labels of the own half change no grade of a row that stays toxic
    assert (graded_by_other_half(rows, turned, half, 4)[:3] == grades[:3]).all()


def test_rows_that_were_not_learned_from(spark):
    """Labels of even ids are learned, odd ids judged."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = score(docs, fit(docs, labels.where("doc_id % 2 = 0"))).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").where("doc_id % 2 = 1").collect()
    caught = sum(r["toxic"] and r["label"] for r in rows)
    precision, recall = caught / sum(r["toxic"] for r in rows), caught / sum(r["label"] for r in rows)
    print(len(rows), precision, recall)
    assert precision > 0.93 and recall > 0.88
    grades = {g: np.mean([r["expected_severity"] for r in rows if r["label"] == g]) for g in (0, 1)}
    assert grades[1] > 1.3 > 0.5 > grades[0]


def test_filter_and_odd_input(spark):
    texts, labels = _corpus(300)
    texts += odd_texts() + [texts[0]]
    df = docs_of(spark, texts, [*range(len(texts) - 2), None, 0])
    out = without_toxic(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert out.columns == df.columns
    stays = {r["doc_id"] for r in out.collect()}
    assert set(range(300, 300 + len(odd_texts()) - 1)) | {None} <= stays
    for some in ([], [(0, 0), (1, 0)], [(0, 1)], [(10**6, 1), (None, 1), (2, None)]):
        rows = score(df.select("doc_id", "text"), fit(df, spark.createDataFrame(some, "doc_id long, toxic int"))).collect()
        assert len(rows) == len(texts)
        assert all(r["toxic"] == (some == [(0, 1)]) for r in rows)
    none = docs_of(spark, [])
    assert score(none, fit(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
