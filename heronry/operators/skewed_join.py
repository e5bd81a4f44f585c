"""Equi-join that salts the keys that are too frequent, and them alone.

The rows of the large side are counted by key in the tasks first; the keys with more than `most` rows are the heavy ones.
They can't be more than the rows over `most`, so their table is small, and it is broadcast only when counted so. A heavy
key's rows on the large side are dealt over as many groups as it takes to have about `most` each; its rows on the other
side are copied to each of them. All other keys are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one group may have; heavy keys that are broadcast.
MOST, MOST_HEAVY = 1_000_000, 100_000


def heavy_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """(key, groups) of the keys with more than `most` rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    return counts.where(F.col("_rows") > most).select(key, F.ceil(F.col("_rows") / most).cast("int").alias("_groups"))


def skewed_join(large: DataFrame, other: DataFrame, key: str, how: str = "inner", most: int = MOST, salt: Column | None = None) -> DataFrame:
    """large joined with other on `key`, which the result has once; `how` is inner, left, left_semi or left_anti.

    `salt` (a value that differs between the rows of a key) deals heavy keys' rows; it must not change if a task runs again, so
    it is a hash of the row unless given. Rows that are equal in all columns then stay together: give a salt that parts them
    if a key has very many. The rows are those of the plain join: repeated rows count as often as they stand, null keys meet
    nothing. Other columns of the two sides must have different names.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"can't join {how}: the copies of the other side would come out")
    heavy = heavy_keys(large, key, most)
    first = heavy.limit(MOST_HEAVY + 1).collect()
    small = F.broadcast(large.sparkSession.createDataFrame(first, heavy.schema)) if len(first) <= MOST_HEAVY else heavy
    quoted = ["`" + c.replace("`", "``") + "`" for c in large.columns]
    dealt = large.join(small, key, "left")
    row = F.xxhash64(*quoted) if salt is None else F.xxhash64(salt)
    dealt = dealt.withColumn("_salt", F.when(F.col("_groups").isNull(), 0).otherwise(F.pmod(row, F.col("_groups"))).cast("int")).drop("_groups")
    copies = other.join(small, key, "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_groups", F.lit(1)) - 1))).drop("_groups")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")
