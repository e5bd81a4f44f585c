"""Quality rules by host, with DataFrame functions alone.

Each document is measured and held against rules of its own. Failures are then counted by host (the column source), and
each host's rate is shrunk towards that of all hosts by a beta prior, whose two parameters are fitted to the hosts by the
method of moments. A host whose rate is above one half, even two standard deviations of its posterior lower, is rejected
with all its documents.

What is defined for odd input:
- A null text has no words. Repeated rows count and are returned as often as they stand there; null ids are kept.
- Rows with a null host form one host. A host of few rows stays near the common rate.
- Positions are words; windows are compared by 64-bit hashes. Whole texts count.
- Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, WORD_CHAR, WORD_GAP, written

WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
#: A host's documents may fail at this rate, and its posterior must lie so many standard deviations above it.
MOST_FAILING, DEVIATIONS = 0.5, 2.0
SYMBOLS = r"[#*$%&|<>]"


def _covered(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more: hashes are sorted beside their places, those with an equal
    neighbour give the places, and each place adds the words that the one before doesn't cover."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        repeated = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
        places = F.sort_array(F.transform(repeated, lambda e: e["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("words"))
        step = lambda a, p: F.struct(p.alias("last"), (a["words"] + F.least(F.lit(WINDOW), p - a["last"])).alias("words"))
        return F.aggregate(places, start, step, lambda a: a["words"])

    return F.get(F.transform(F.array(ordered), count), 0)  # the sorted array is made once, and then looked up


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row, without a shuffle."""
    rows = docs.select("doc_id", F.col(host).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(GAP_CHARS))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, WORD_GAP)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD_CHAR)))
    symbols = F.length("text") - F.length(F.regexp_replace("text", SYMBOLS + "+", ""))
    rows = rows.select("doc_id", "host", words.alias("words"), lines.alias("lines"), symbols.cast("long").alias("n_symbols"))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    rows = rows.withColumn("windows", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    repeated = F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0).cast("long")).otherwise(_covered(F.col("windows")))
    return rows.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
    )


BASE_FAILED = f"(n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words)"


def hosts(measured: DataFrame, failed: str = BASE_FAILED) -> DataFrame:
    """(host, n, n_failed, prior_a, prior_b, rate, rejected): the shrunk failure rate of each host, and the verdict."""
    failures = F.sum(F.expr(failed).cast("long"))
    by_host = written(measured.groupBy("host").agg(F.count("*").alias("n"), failures.alias("n_failed")), "hosts")
    n, f = F.sum("n"), F.sum("n_failed")
    squares = F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n"))
    row = by_host.agg(n.alias("n"), (f / n).alias("m"), (squares / n).alias("s"), F.count("*").alias("k")).first()  # sums over hosts
    m = row["m"] or 0.0
    varies, chance, alone = (row["s"] or 0.0) - m * m, m * (1 - m) * row["k"] / (row["n"] or 1), m * (1 - m)
    # without more variance than chance gives, the prior weighs as much as all rows
    strength = (alone - varies) / (varies - chance) if chance < varies < alone else float(row["n"] or 0)
    prior_a, prior_b = m * strength + 1e-6, (1 - m) * strength + 1e-6
    total = F.col("n") + prior_a + prior_b
    rate = (F.col("n_failed") + prior_a) / total
    low = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (total + 1))
    return by_host.withColumns({"prior_a": F.lit(prior_a), "prior_b": F.lit(prior_b), "rate": rate, "rejected": low > MOST_FAILING})


def verdicts(docs: DataFrame, host: str = "source", failed: str = BASE_FAILED) -> DataFrame:
    """The measures of each row with base_failed, the host's rate and rejected, and kept. The texts are read once; only
    measures are shuffled. The join leaves the choice between broadcast and shuffle to the measured number of hosts."""
    measured = written(measures(docs, host), "measures")
    by_host = hosts(measured, failed).select(F.col("host").alias("of"), "rate", "rejected")
    rows = measured.join(by_host, F.col("host").eqNullSafe(F.col("of"))).drop("of").withColumn("base_failed", F.expr(failed))
    return rows.withColumn("kept", ~(F.col("base_failed") | F.col("rejected")))
