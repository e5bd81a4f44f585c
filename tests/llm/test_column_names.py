"""Columns of the input that have dots, spaces and back ticks in their names, or those that operators use inside."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heronry.llm import alignment, chat_format, decontamination, host_rules, lattice_lm, near_dup, ngram_join, packing, quality, secrets, toxicity, warc

from .helpers import docs_of, words

NAMES = ["a.b", "with space", "tick`ed", "_heronry_found", "new", "found", "wanted", "low", "cls", "key", "label", "row", "spans", "_heronry_p"]


def odd(df):
    return df.withColumns({n: F.lit(k) for k, n in enumerate(NAMES) if n not in df.columns}).withColumn("deep", F.struct(*(F.lit(k).alias(f"f{k}") for k in range(30))))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [words(rng, 60) for _ in range(12)]
    texts += [texts[0], "password = hunter2hunter2 " + texts[1], None, "", "vile filth " + words(rng, 20)]
    return docs_of(spark, texts)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("bound", [500_000, 0])
def test_secrets(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(secrets, "MOST_CANDIDATES", bound)
    assert rows_of(secrets.digest(odd(docs))) == rows_of(secrets.digest(docs))
    clean = secrets.redacted(odd(docs))
    assert clean.columns == odd(docs).columns and clean.dtypes == odd(docs).dtypes
    assert rows_of(clean.select(docs.columns)) == rows_of(secrets.redacted(docs))
    assert clean.where("text like '%[secret]%' and n_chars = length(text)").count() == 1


def test_texts_without_what_a_rule_asks_for_stay_where_they_are(spark, docs, monkeypatch):
    monkeypatch.setattr(secrets, "MOST_CANDIDATES", 0)
    rows = secrets.digest(docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "Union" in plan
    joined = plan[plan.index("Join LeftOuter") :]
    assert "Filter" in joined and "Contains" in joined.replace("contains", "Contains")


@pytest.mark.parametrize("of", [
    lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("sequence_id", "offset"),
    lambda d: host_rules.verdicts(d).select("doc_id", "n_words", "kept"),
    lambda d: near_dup.near_duplicates(d),
    lambda d: ngram_join.linked(d),
    lambda d: lattice_lm.score(d, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "base_score"),
    lambda d: alignment.aligned(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
])
def test_operators_that_read_documents(docs, of):
    assert rows_of(of(odd(docs))) == rows_of(of(docs))


def test_operators_that_read_documents_and_labels(spark, docs):
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k > 13)) for k in range(17)], "doc_id long, quality int, toxic int")
    assert rows_of(quality.score(odd(docs), labels).select("doc_id", "predicted")) == rows_of(quality.score(docs, labels).select("doc_id", "predicted"))
    model = toxicity.fit(odd(docs), labels)
    scored = toxicity.score(odd(docs), model)
    assert set(odd(docs).columns) < set(scored.columns) and scored.count() == 17
    assert rows_of(toxicity.without_toxic(odd(docs), labels).select(docs.columns)) == rows_of(toxicity.without_toxic(docs, labels))


def test_other_tables(spark, docs):
    items = spark.createDataFrame([(1, docs.first()["text"])], "item_id long, text string")
    assert rows_of(decontamination.contained_items(odd(docs), odd(items))) == rows_of(decontamination.contained_items(docs, items))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert rows_of(warc.archived(odd(pages))) == rows_of(warc.archived(pages))
    talk = docs.select((F.col("doc_id") % 3).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    assert rows_of(chat_format.formatted(odd(talk))) == rows_of(chat_format.formatted(talk))


def test_stages_keep_all_columns(spark, docs, sf_dir):
    kept = odd(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, kept, sf_dir)
        assert found.columns == kept.columns and found.count() > 10, name
    again = odd(docs).unionByName(odd(docs).where("doc_id = 3"))
    assert near_dup.keep_one_of_each(again).columns == again.columns and near_dup.keep_one_of_each(again).count() == 15
