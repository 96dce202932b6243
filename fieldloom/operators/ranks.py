"""Row numbers within groups of any size: ordered ranges of rows, and the numbers of rows in the ranges before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep


#: So many rows are numbered by one window, as a single task can sort them all, whatever the groups.
FEW = 200_000


def ranked(df: DataFrame, by: list[str], order: list[str], number: str, total: str) -> DataFrame:
    """Adds ``number``, from 1 in ``order`` within each group ``by``, and ``total``, the group's rows (both long).

    Rows are dealt to ranges of (group, order), so that no task sorts a whole group; the ranges' numbers of rows,
    few, are summed.  Rows that are equal in ``order`` may be numbered either way.  The rows are written first: they are
    counted, sampled for the ranges and read again.
    """
    df = keep(df)
    if df.count() <= FEW:
        group = Window.partitionBy(*by)
        return df.withColumn(number, F.row_number().over(group.orderBy(*order)).cast("long")).withColumn(total, F.count("*").over(group))
    # sorted within its range, a row's number there is that of the increasing id
    spread = keep(df.repartitionByRange(*[F.col(c) for c in [*by, *order]]).sortWithinPartitions(*by, *order).withColumn("_place", F.monotonically_increasing_id()))
    spread = spread.withColumn("_part", F.shiftright("_place", 33))
    counts = keep(spread.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first")))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_range"), (before - F.col("_first") + 1).alias("_before"), F.sum("_n").over(group).alias(total))
    same = [F.col("_part") == F.col("_range")] + [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    return spread.join(keep(counts), same).withColumn(number, F.col("_before") + F.col("_place")).select(*df.columns, number, total)
