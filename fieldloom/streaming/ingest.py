"""Measurements that arrive over time: the row-wise rules on a stream, appended to Parquet by dataset.

Flags, substitutions and unit conversions look at one row and small rule tables only, so they run on a
streaming DataFrame as they are.  Identifiers number the keys of a whole dataset; they are made when the
dataset is built from what was ingested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules


def harmonise_rows(long: DataFrame, dictionary: DataFrame, conversions: dict[str, rules.Conversion], substitutions: list[tuple[str, str, str | None]] = ()) -> DataFrame:
    """Long rows (dataset_id, taxon_name, trait_name, unit_in, value_type, value) with value, unit and error."""
    df = rules.substitute(long.withColumn("value", F.lower("value")), list(substitutions))
    df = rules.with_dictionary(df, dictionary).withColumn("error", rules.value_error())
    df = rules.convert_units(df, conversions).withColumn("error", rules.range_error(F.col("error")))
    return df.select(*long.columns, "unit", "error")


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Starts writing harmonised rows, all that is available, and returns the query."""
    return stream.writeStream.format("parquet").partitionBy("dataset_id").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def build_batches(
    stream: DataFrame, columns: dict[str, list[str]], programs: dict[str, dict], path: str, checkpoint: str, definitions: dict, conversions: dict, schema: dict | None = None, taxa: DataFrame | None = None,
) -> StreamingQuery:
    """Builds the datasets of a stream of rows (dataset_id, _row, cells), a micro-batch at a time, into the database at ``path``.

    A batch's rows are kept by dataset and batch; the datasets that it touches are built from all rows they have so far, and
    their partitions are overwritten.  A batch that is replayed overwrites its own rows and changes nothing else.
    """
    from ..plans import incremental

    kept = "_row long, cells map<string, string>, dataset_id string, batch long"

    def build(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("_row", "cells", "dataset_id", F.lit(number).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "batch").parquet(f"{path}/_rows")
        touched = sorted(r[0] for r in batch.select("dataset_id").distinct().collect() if r[0] in programs)
        if touched:
            now = spark.read.schema(kept).parquet(f"{path}/_rows").filter(F.col("dataset_id").isin(touched)).drop("batch")
            incremental.update(now, columns, {d: programs[d] for d in touched}, path, definitions, conversions, schema, taxa, partial=True)

    return stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
