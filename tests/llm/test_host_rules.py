import random
import re
from collections import Counter

from heronry.llm.host_rules import verdicts

from .helpers import clashing, docs_of, odd_texts, words


def measure(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(1)
    part = words(rng, 12)
    texts = odd_texts() + [f"{part} {words(rng, 9)} {part}\n{part}\n\n{part}\n x \n x ", "a b c d e f g h " * 9, "# * $ \x1c \x85 \xa0 <|>", "x\n" * 30 + words(rng, 80)]
    rows = {r["doc_id"]: r for r in verdicts(clashing(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        r, wanted = rows[i], measure(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == wanted
        assert r["base_failed"] == (wanted[0] < 20 or 100 * wanted[4] > 30 * wanted[0])
        assert not (r["base_failed"] and r["kept"])


def test_bad_hosts_are_rejected_and_small_ones_spared(spark):
    rng = random.Random(2)
    good = lambda: words(rng, 50)
    rows = [("bad", "too short") for _ in range(60)] + [("bad", good()) for _ in range(3)] + [("tiny", "too short"), ("tiny", good())]
    rows += [(f"h{k}", good() if rng.random() < 0.9 else "short") for k in range(12) for _ in range(40)] + [(None, good())]
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in verdicts(df).collect()}
    assert len(out) == len(rows)
    for i, (host, _) in enumerate(rows):
        assert out[i]["rejected"] == (host == "bad")
        assert out[i]["kept"] == (not out[i]["base_failed"] and host != "bad")


def test_no_rows(spark):
    assert verdicts(docs_of(spark, [])).count() == 0


def test_prior_by_hand(spark):
    """Three hosts of 100, 100 and 200 rows with 90, 10 and 40 failures: mean 0.35, variance between hosts 0.1025, of which
    chance gives 0.00170625, so the prior weighs 0.125 / 0.10079375 rows."""
    from heronry.llm.host_rules import hosts

    rows = [(host, k < failed) for host, n, failed in (("a", 100, 90), ("b", 100, 10), (None, 200, 40)) for k in range(n)]
    got = {r["host"]: r for r in hosts(spark.createDataFrame(rows, "host string, bad boolean"), "bad").collect()}
    weight = 0.125 / 0.10079375
    for host, n, failed in (("a", 100, 90), ("b", 100, 10), (None, 200, 40)):
        assert abs(got[host]["prior_a"] - 0.35 * weight) < 1e-5 and abs(got[host]["prior_b"] - 0.65 * weight) < 1e-5
        assert abs(got[host]["rate"] - (failed + 0.35 * weight) / (n + weight)) < 1e-6
        assert got[host]["rejected"] == (host == "a")
