import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from heronry.llm import packing
from heronry.llm.common import BATCH_ROWS, small_batches, written
from heronry.llm.packing import WordIds, encoded, fill, pack, plan, segments

from .helpers import clashing, docs_of, odd_texts, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark):
    rng = random.Random(1)
    texts = odd_texts() + [words(rng, rng.randrange(1, 900)) for _ in range(60)] + ["It's 10,000.5 ½ª 'tis ''s  don't!!"] * 3
    texts += ["".join(chr(rng.choice([rng.randrange(32, 383), rng.randrange(32, 127), 10])) for _ in range(300)) for _ in range(40)]
    tokenizer = Tokenizer.from_file(PATH)
    rows = pack(clashing(docs_of(spark, texts)), PATH).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    whole, sequences = {i: [] for i in ids}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        part = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(whole[r["doc_id"]]) and len(part) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        whole[r["doc_id"]] += part
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert whole == ids
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 2048) + 1


def test_long_texts_in_segments(monkeypatch):
    """Texts of many segments, plain or not, and a store that starts anew, give what the tokenizer gives for the whole text."""
    rng = random.Random(3)
    tokenizer = Tokenizer.from_file(PATH)
    plain = words(rng, 3000, 2000) + " " + "x" * 5000 + " don't 12,5 " + words(rng, 300)
    odd = " ".join(rng.choice([*"Σς é é中文İ", "<|endoftext|>", "word", "ΑΣ", "12", "\u0301", "\u00a0", "a<|", "|>b"]) for _ in range(4000))
    texts = [plain, odd, plain.upper(), odd.replace(" ", ""), "", "short", plain[:900]]
    monkeypatch.setattr(packing, "SEGMENT", 1000)
    monkeypatch.setattr(packing, "MOST_WORDS", 1500)
    assert len(list(segments(plain, 1000))) > 10 and len(list(segments(odd, 1000))) > 3
    store = WordIds(tokenizer)
    for _ in range(2):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encoded(texts, store)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(store) < 5000


def test_a_text_above_the_segment(spark):
    rng = random.Random(4)
    text = words(rng, 250_000, 30_000) + " ſ中 " + words(rng, 10)
    assert len(text) > packing.SEGMENT
    rows = pack(docs_of(spark, [text, text.replace("中", "")]), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    for i, t in enumerate([text, text.replace("中", "")]):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_no_rows(spark):
    assert pack(docs_of(spark, []), PATH).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_closest(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
    space = rng.randrange(1, 90)
    sums = {sum(x * n for x, n in zip(counts, times, strict=True)) for times in itertools.product(*(range(n + 1) for n in counts.values()))}
    found = fill(counts, space)
    assert all(n <= counts[x] for x, n in found)
    assert sum(x * n for x, n in found) == max(s for s in sums if s <= space)


def test_plan_covers_each_rank_once():
    rng = random.Random(2)
    histogram = {rng.randrange(1, 65): rng.randrange(1, 500) for _ in range(40)} | {64: 11}
    seen, filled = {x: set() for x in histogram}, {}
    for length, first, repeats, sequence, offset in plan(histogram, 64).tolist():
        for k in range(repeats):
            assert first + k not in seen[length]
            seen[length].add(first + k)
            filled.setdefault(sequence + k, []).append((offset, length))
    assert {x: len(s) for x, s in seen.items()} == histogram
    assert all(max(s) == len(s) - 1 for s in seen.values())
    for parts in filled.values():
        assert sum(n for _, n in parts) <= 64 and sorted(o for o, _ in parts) == list(itertools.accumulate([0] + [n for _, n in sorted(parts)][:-1]))


def test_few_texts_at_once(spark, monkeypatch):
    """Whole texts come to the worker in small batches, and the session's own setting is back afterwards."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    def kept(df, what):
        seen.extend(r["n"] for r in spark.range(3000).coalesce(1).mapInArrow(sizes, "n long").collect())
        return written(df, what)

    before = spark.conf.get(key)
    monkeypatch.setattr(packing, "written", kept)
    rows = pack(docs_of(spark, ["some words"] * 20), PATH).collect()
    assert len(rows) == 20 and sum(seen) == 3000 and max(seen) <= BATCH_ROWS and spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), small_batches(spark, 7):
        assert spark.conf.get(key) == "7"
        raise ZeroDivisionError
    assert spark.conf.get(key) == before
