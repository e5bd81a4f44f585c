"""Small inputs that every operator must stand, and what the tables look like."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside, as further columns of the input
CLASHES = {"words": "x", "score": 1.5, "rank": 3, "component": 9, "spans": "y", "tokens": "z", "host": "h", "key": 1, "hashes": 2, "row": 5, "toxic": 7, "rules": "r"}


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


def odd_texts(seed=1):
    """Null, empty, white space alone, one word, non-Latin letters, repeats, and a very long text."""
    rng = random.Random(seed)
    long = words(rng, 60_000, 50_000)
    return [None, "", " \n\t ", "one", "Ünïcödé ΣΑΣ 中文 é́ <|endoftext|> İx", "a a a a a a a a a a a a a a a a a a a a a a a a", long, words(rng, 40), words(rng, 40)]
