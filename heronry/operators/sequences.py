"""Sequences of events of a key, in order and within a time, that nothing unwanted interrupts.

The state of the search is how late a sequence of the steps so far can have begun. It is carried along the key's time line
in buckets (see timelines): a row that is step k takes over the state of the latest row that is step k - 1. A later row can
use every beginning that an earlier one can, so the latest is enough, and no pairs of rows are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timelines import DAY, as_of, quoted


def sequences(df: DataFrame, key: str, at: str, tie: str, steps: list[Column], within: int, without: Column | None = None, bucket: int = DAY) -> DataFrame:
    """The rows of df that end a sequence, with began_at and began_tie: rows of one `key`, in the order of `at` (microseconds)
    and `tie`, that fulfil `steps` one after the other, at most `within` from the first to the last, and between the two no
    row that fulfils `without`. Of the sequences that a row ends, that with the latest beginning is shown.

    A row should fulfil one of the steps at most; one that fulfils several counts for each, and follows itself. `at` and `tie`
    together should differ between a key's rows, else rows of a tie come in any order. Rows with a null time are left out;
    null keys form a key of their own. An empty table gives an empty result.
    """
    names = [f"_step_{k}" for k in range(len(steps))]
    rows = df.withColumns({**{n: F.coalesce(s, F.lit(False)) for n, s in zip(names, steps, strict=True)}, "_stop": F.lit(False) if without is None else F.coalesce(without, F.lit(False))})
    place = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
    rows = rows.withColumn("_began", F.when(F.col(names[0]), place))
    for k in range(1, len(steps)):
        # only rows of the two steps say anything here; all others go along with what they carry
        rows = as_of(rows, key, at, tie, F.when(F.col(names[k - 1]), F.col("_began")), bucket)
        rows = rows.withColumn("_began", F.when(F.col(names[k]), F.col("as_of"))).drop("as_of")
    rows = as_of(rows, key, at, tie, F.when(F.col("_stop"), place), bucket)
    ends = rows.where(F.col(names[-1]) & F.col("_began").isNotNull() & (F.col(at) - F.col("_began.at") <= within))
    ends = ends.where(F.col("as_of").isNull() | (F.col("as_of") < F.col("_began")))
    return ends.select(*quoted(df.columns), F.col("_began.at").alias("began_at"), F.col("_began.tie").alias("began_tie"))
