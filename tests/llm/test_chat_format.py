import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from heronry.llm.chat_format import N, TURN, Model, _decoded, fit, formatted, parse, seen, transcript_lines

from .helpers import clashing, words

TURNS = "conv_id long, turn long, role string, text string"


def _conversations(n=60):
    rng = random.Random(1)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(2, 9)):
            role = "user" if t % 2 == 0 else "assistant"
            text = words(rng, rng.randrange(5, 20)) + "?" if role == "user" else "\n".join(words(rng, 30) + "." for _ in range(rng.randrange(2, 6)))
            rows.append((c, t, role, text))
    return rows


def test_recovers_roles(spark):
    rows = _conversations()
    found = formatted(clashing(spark.createDataFrame(rows, TURNS))).collect()
    roles = {(c, t): r for c, t, r, _ in rows}
    starts = [r for r in found if r["line_no"] % TURN == 0]
    assert np.mean([r["role"] == roles[r["conv_id"], r["line_no"] // TURN] for r in starts]) > 0.97
    assert len(starts) > 0.9 * len(rows)
    assert all(r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>\n" for r in found)


def test_best_path_is_that_of_all_paths():
    rng = np.random.default_rng(2)
    model = Model({("step", int(a), int(b)): int(n) for a, b, n in rng.integers(0, N, (40, 3))} | {("0", s, k): int(rng.integers(1, 9)) for s in range(N) for k in range(4)})
    emissions = [model.emission(int(rng.integers(4)), 1, 1) for _ in range(4)]

    def total(path):
        return model.start[path[0]] + sum(e[s] for e, s in zip(emissions, path, strict=True)) + sum(model.step[a, b] for a, b in zip(path, path[1:], strict=False))

    best = max(product(range(N), repeat=4), key=total)
    assert np.isclose(total(_decoded(emissions, model, -1, best[-1])), total(best))


def test_blocks_change_nothing(spark):
    lines = transcript_lines(spark.createDataFrame(_conversations(12), TURNS))
    model = fit(lines)
    numbered = lines.selectExpr("1L as conv_id", f"conv_id * 1000 * {TURN} + line_no as line_no", "text")  # one long conversation
    whole = parse(numbered, model, 1 << 60).collect()
    parts = parse(numbered, model, 3 * TURN).collect()
    at = lambda rows: {r["line_no"]: (r["role"], r["text"]) for r in rows if not r["continues"]}
    assert len(parts) >= len(whole) and at(whole) == {k: v for k, v in at(parts).items() if k in at(whole)} | {k: v for k, v in at(whole).items() if at(parts).get(k) != v}
    assert {k: v[0] for k, v in at(whole).items()} == {k: v[0] for k, v in at(parts).items()}


def test_markers():
    assert [seen(x)[0] for x in ("User: hi", "### Assistant:", "<|system|>", "Q: what", "A: this", "a cat sat", "users: x", "[user] yes")] == [2, 3, 1, 2, 3, 0, 0, 2]
    assert seen("Human: hello")[3] == "hello"


def test_ids_of_any_type_and_turns_of_any_length(spark):
    rows = spark.createDataFrame(_conversations(6), TURNS)
    wanted = {(int(r["conv_id"]), r["line_no"], r["role"]) for r in formatted(rows, fit(transcript_lines(rows))).collect()}
    for kind in ("smallint", "decimal(20,0)", "double"):
        df = rows.withColumn("conv_id", F.col("conv_id").cast(kind))
        lines = transcript_lines(rows).withColumn("conv_id", F.col("conv_id").cast(kind))  # the same styles, which follow hashes
        assert {(int(r["conv_id"]), r["line_no"], r["role"]) for r in parse(lines, fit(lines, 2 * TURN), 256 * TURN).collect()} == wanted
        assert formatted(df).schema["conv_id"].dataType == df.schema["conv_id"].dataType
    long = spark.createDataFrame([(1, 0, "user", "\n" * (1 << 20) + "end"), (1, 1, "assistant", "yes")], TURNS)
    at = transcript_lines(long).agg(F.count_distinct("line_no").alias("n"), F.count("*").alias("rows"), F.max(F.when(F.col("role") == "user", F.col("line_no"))).alias("last")).first()
    assert at["n"] == at["rows"] and at["last"] < TURN


def test_unmarked_turns(spark):
    """The only turns that need more than their marker. These texts have no more structure than lengths and ends of lines."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    bare = turns.where(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(100)) < 15).collect()
    found = {(r["conv_id"], r["line_no"] // TURN): r["role"] for r in formatted(turns).collect() if r["line_no"] % TURN == 0}
    got = [found.get((r["conv_id"], r["turn"])) == r["role"] for r in bare]
    starts = [(r["conv_id"], r["turn"]) in found for r in bare]
    print(len(bare), np.mean(starts), np.mean(got))
    assert np.mean(starts) > 0.4 and np.mean(got) > 0.35


def test_odd_input(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", None), (1, 0, None, ""), (1, 0, None, ""), (2, 1, "robot", "User:"), (3, 0, "user", "long " * 50_000)]
    found = formatted(spark.createDataFrame(rows, TURNS)).collect()
    assert {r["conv_id"] for r in found} == {None, 1, 2, 3} and sum(r["n_lines"] for r in found) == len(rows)
    assert formatted(spark.createDataFrame([], TURNS)).count() == 0


def test_lines_with_one_number_are_held_in_pieces(spark, monkeypatch):
    """Turns without a number share a block; it is cut by counted lines, and the roles found are those of one piece."""
    from heronry.llm import chat_format

    rows = spark.createDataFrame([(c % 2, None if c % 2 else t, r, x) for c, t, r, x in _conversations(30)], TURNS)
    lines = transcript_lines(rows)
    model = fit(lines, 256 * TURN)
    ordered = chat_format._ordered(lines, 256 * TURN)
    assert ordered.groupBy("conv_id", "block").count().count() == 2
    whole = parse(lines, model, 256 * TURN)
    want = sorted((r["conv_id"], r["line_no"], r["role"], r["text"]) for r in whole.where("not continues").collect())
    n = whole.agg(F.sum("n_lines")).first()[0]
    monkeypatch.setattr(chat_format, "PIECE", 7)
    ordered = chat_format._ordered(lines, 256 * TURN)
    assert ordered.groupBy("conv_id", "block").count().agg(F.max("count")).first()[0] == 7
    parts = parse(lines, model, 256 * TURN)
    assert parts.agg(F.sum("n_lines")).first()[0] == n == lines.count()
    got = sorted((r["conv_id"], r["line_no"], r["role"]) for r in parts.where("not continues").collect())
    assert got == sorted(w[:3] for w in want)
