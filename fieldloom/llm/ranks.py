"""Positions within groups of any size, without sorting a group in one task.

A window partitioned by a hot key sorts a third of all rows in one task.  Here each group is cut
into ordered chunks; chunk totals (few rows) are summed over the chunks before, and only the rows of
one chunk are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], chunk: str, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows before this one, in its group.

    Rows of a group are ordered by ``chunk`` (a column) and then by ``order``; with an amount of 1
    this is the rank from 0.
    """
    df = df.withColumn("_amount", amount)
    totals = df.groupBy(*keys, chunk).agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, chunk, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    for k in [*keys, chunk]:
        totals = totals.withColumnRenamed(k, f"_k_{k}")
    within = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_own", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, chunk]]
    out = own.join(totals, same, "left").withColumn(name, F.col("_before") + F.col("_own"))
    return out.drop("_amount", "_own", "_before", *[f"_k_{k}" for k in [*keys, chunk]])


def chunk_count(rows: int, most: int = 20_000) -> int:
    """Chunks for a hashed chunk number: about 2,000 rows of a group of all rows in each, and at most ``most`` chunk totals a group."""
    return min(max(16, rows // 2_000), most)
