import math
import random
import zlib
from collections import Counter

import public_tokenizers

from heronry.llm.lattice_lm import Pieces, piece_log10, score, word_counts, written

from .helpers import clashing, docs_of, odd_texts, words

PATH = public_tokenizers.path("piece_bpe_32k.model")


def tokens(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


def brute_sum(word, p, end=0):
    """Sum over all segmentations, by trying every split of every length."""
    text, total = "▁" + word, {0: 1.0}
    for stop in range(1, len(text) + 1):
        total[stop] = sum(total[start] * 10 ** p.log10.get(text[start:stop], -math.inf) for start in range(stop))
        total[stop] += total[stop - 1] * math.prod(10 ** p.bytes10[b] for b in text[stop - 1].encode())
    return math.log10(total[len(text)])


def test_equals_brute_force(spark):
    rng = random.Random(1)
    texts = odd_texts() + [words(rng, rng.randrange(1, 60)) + " the Quick brown fox émigré 中" for _ in range(60)]
    df = clashing(docs_of(spark, texts))
    train = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            train.update(tokens(t))
            train[None] += 1
    n, v = sum(train.values()), len(train)
    log10 = piece_log10(written(word_counts(df), "test"), PATH)
    pieces = Pieces(PATH, log10)
    pieces.log10 = {k: x / math.log(10) for k, x in pieces.log.items()}
    pieces.bytes10 = {k: x / math.log(10) for k, x in pieces.bytes.items()}
    used = [x for x in log10 if x > -math.inf]
    assert abs(sum(10**x for x in used) - 1) < 1e-9
    for most_common in (0, 40, 10**6):
        rows = {r["doc_id"]: r for r in score(df, PATH, most_common).collect()}
        assert len(rows) == len(texts)
        for i, t in enumerate(texts):
            z, r = [*tokens(t), None], rows[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(z), sum(train[w] > 0 for w in z), n)
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
            assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in z), rel_tol=1e-9)
            if len(z) < 200:
                assert math.isclose(r["score"], sum(brute_sum(w, pieces) for w in z[:-1]) + pieces.end, rel_tol=1e-9)


def test_null_ids_and_no_rows(spark):
    rows = score(docs_of(spark, ["a b", "a b", None], [None, 4, 4]), PATH).collect()
    assert len(rows) == 3 and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert score(docs_of(spark, []), PATH).count() == 0
