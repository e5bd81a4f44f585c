"""The whole pipeline against the same steps without Spark, on documents where every step has work to do."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .helpers import CLASHES, DOCS, clashing, odd_texts, words
from .test_near_dup import varied
from .test_secrets import base_spans

ITEM = "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from a wall"


def _folder(spark, tmp_path):
    rng = random.Random(1)
    texts, toxic, kept = [], {}, []

    def add(text, stays=True):
        texts.append(text)
        if stays:
            kept.append(len(texts) - 1)
        return len(texts) - 1

    for _ in range(60):
        toxic[add(words(rng, 60, 5000))] = 0
    for _ in range(30):
        w = words(rng, 60, 5000).split()
        w[rng.randrange(60)] = rng.choice(["idiot", "scum!"])
        toxic[add(" ".join(w), False)] = 1
    copied = words(rng, 80, 5000)
    add(copied)
    for _ in range(5):
        add(varied(rng, copied, 1), False)
    add(words(rng, 40, 5000) + ". " + ITEM + ". " + words(rng, 40, 5000), False)
    secret = add(words(rng, 40, 5000) + " token = 0123456789abcdef0123456789abcdef")
    long = add(words(rng, 4000, 5000))
    add("")
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").selectExpr("doc_id", "1 as quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts, kept, secret, long


def test_run(spark, tmp_path):
    texts, kept, secret, long = _folder(spark, tmp_path)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in rows}) == kept
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids[r["doc_id"]] = ids.get(r["doc_id"], b"") + r["ids"]
    for i in kept:
        text = texts[i]
        for _, s, e in base_spans(text)[:1]:
            text = text[:s] + "[secret]" + text[e:]
        wanted = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert ids[i] == b"".join(x.to_bytes(4, "little") for x in wanted)
    assert sum(r["doc_id"] == long for r in rows) > 1 and base_spans(texts[secret])


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    _folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_stand_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and very long texts, further columns with names that stages use inside."""
    _folder(spark, tmp_path)
    texts = odd_texts()
    rows = [(i, t, None if i % 2 else "en", None, None) for i, t in enumerate(texts)] + [(None, None, None, None, None), (None, "a b c", "en", "s", 5), (3, "one", "en", "s", 3), (20, texts[7], "en", "s", 5)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    ids = [{r["doc_id"] for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES:
        at = f"{tmp_path}/stage-{len(ids)}"
        stage(spark, docs, str(tmp_path)).write.parquet(at)
        columns, docs = docs.columns, spark.read.parquet(at)
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert len(ids) > 5 or (docs.columns == columns and set(CLASHES) <= set(columns))
    # nothing is toxic or leaked here; of the two copies the one with the greater id goes
    assert ids[0] == ids[1] == ids[2] | {20} and ids[2] == ids[3] == ids[4] == ids[5] and 20 not in ids[2]
    lengths = {r["doc_id"]: r["n"] for r in docs.where("doc_id is not null").groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert lengths[0] == lengths[1] == 1 and lengths[6] > 60_000
