import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heronry.llm import alignment
from heronry.llm.alignment import aligned, units

from .helpers import clashing, docs_of, odd_texts, words

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    """GPT-like byte letters, by the rule in words: printable Latin-1 is itself, the rest follows from 256 on."""
    out, k = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + k)] = b
            k += 1
    return out


def brute(texts):
    """The rows of the contract from whole texts, token by token."""
    a_of, b_of = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_of.encode_special_tokens = True
    letters = byte_of()
    rows, links_of = [], []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        in_a = [bytes(letters[c] for c in a_of.id_to_token(i)) for i in a]
        in_b = []
        for i in b:
            p = b_of.id_to_piece(i)
            in_b.append(bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode())
        if not text or b"".join(in_a) != whole or b"".join(in_b) != whole:
            rows.append((0, 0, 0, 0, ""))
            links_of.append([])
            continue
        links, groups, i, j, at_a, at_b, group = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a):
            if len(links) == 0 or links[-1] != (i, j):
                links.append((i, j))
            if not group[0] or group[0][-1] != i:
                group[0].append(i)
            if not group[1] or group[1][-1] != j:
                group[1].append(j)
            end_a, end_b = at_a + len(in_a[i]), at_b + len(in_b[j])
            if end_a <= end_b:
                at_a, i = end_a, i + 1
            if end_b <= end_a:
                at_b, j = end_b, j + 1
            if end_a == end_b:
                groups.append(group)
                group = ([], [])
        shown = ";".join(",".join(str(a[x]) for x in g[0]) + "|" + ",".join(str(b[x]) for x in g[1]) for g in groups)
        rows.append((len(a), len(b), len(groups), len(links), hashlib.sha256(shown.encode()).hexdigest()))
        links_of.append([(b[y], a[x]) for x, y in links])
    counts = Counter(x for links in links_of for x in links)
    most = defaultdict(int)
    for (b, _), n in counts.items():
        most[b] = max(most[b], n)
    return [(*r[:4], sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), r[4]) for r, links in zip(rows, links_of, strict=True)]


STRANGE = [" x", "  x  y ", "a\n  b \n\n c\t d", "x   ", " ", "\n", "don't I'LL <s> </s> <unk> <|endoftext|> <0x0A>", "▁ under", "a ▁b", "é ́x ﬁ 　 z \xa0 q", "中文字 混 合  文", "12 345,678.90 -- ** || \x1c y \x1c \n z \x85 w", "​   a ﻿", "nul \x00 here"]


def check(spark, texts, df=None):
    df = docs_of(spark, texts) if df is None else df
    got = {r["doc_id"]: tuple(r)[1:] for r in aligned(df, *PATHS).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        assert got[k] == w, (k, texts[k] and texts[k][:80])


def test_equals_whole_texts(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(alignment, "MOST_UNITS", 300)  # the store starts anew again and again
    monkeypatch.setattr(alignment, "TOGETHER", 2000)
    monkeypatch.setattr(alignment, "RUN_LINKS", 700)
    monkeypatch.setattr(alignment, "GROUP_RECORDS", 300)  # parts have several groups
    marks = ["the", "of", " ", "\n", "\t ", "  ", "'s", ", ", "Ünï", "中", "7", "▁", "\xa0", "é", "\x1f"]
    noise = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    prose = [words(rng, rng.randrange(1, 80), 60) for _ in range(60)]
    texts = odd_texts()[:6] + STRANGE + noise + prose + prose[:7]
    check(spark, texts, clashing(docs_of(spark, texts)))


@pytest.mark.parametrize("table", ["documents"])
def test_equals_whole_texts_of_the_tables(spark, sf_dir, table):
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(rows)))
    check(spark, [r["text"] for r in rows])


def test_long_text_repeated_rows_null_ids_and_an_empty_table(spark):
    long = odd_texts()[6]
    frame = docs_of(spark, [long, "a b", "a b", None, "", "a b"], [0, 1, 1, 2, None, None])
    got = sorted(map(repr, (tuple(r) for r in aligned(frame, *PATHS).collect())))
    want = [(i, *r) for i, r in zip([0, 1, 1, 2, None, None], brute([long, "a b", "a b", None, "", "a b"]), strict=True)]
    assert got == sorted(map(repr, want))
    assert aligned(docs_of(spark, []), *PATHS).collect() == []


def test_units_put_together_are_the_text():
    for text in [*STRANGE, "a b c", "x"]:
        assert "".join(f" {u}" for u in units(text)) == " " + text
