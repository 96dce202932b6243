"""Builds that do only what has changed: a fingerprint of each dataset's rows, program and configuration.

A database on disk keeps the fingerprints that it was built from.  An update compares them with those of now, builds the
datasets that differ (in one plan, see ``compilation``), overwrites their partitions and deletes those of datasets that
are gone; all others' files stay as they are.  Fingerprints are written last: an update that fails is done again by the
next one, and one that is repeated changes nothing.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, taxonomy
from ..sources import program as prog
from ..sources.tables import file_system, read_database
from . import compilation

STATE = "_fingerprints"


@dataclass(frozen=True)
class Changes:
    """Datasets that an update built, deleted, and left as they were."""

    built: list[str]
    gone: list[str]
    kept: list[str]


def data_fingerprints(rows: DataFrame) -> dict[str, str]:
    """A text for the rows (dataset_id, _row, cells) of each dataset, the same if names, values and order are.

    One line a dataset comes to the driver.
    """
    one = F.xxhash64("_row", F.map_keys("cells"), F.map_values("cells"))
    found = rows.groupBy("dataset_id").agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(one.cast("decimal(20,0)")).alias("s"))
    return {r["dataset_id"]: f"{r['n']} {r['x']} {r['s']}" for r in found.collect()}


def table_fingerprint(df: DataFrame | None) -> str:
    """The same for a table, whatever the order of its rows."""
    if df is None:
        return ""
    one = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(one.cast("decimal(20,0)")).alias("s")).first()
    return f"{df.columns} {r['n']} {r['x']} {r['s']}"


def fingerprints(rows: DataFrame, columns: dict[str, list[str]], programs: dict[str, dict], definitions: dict, conversions: dict[str, rules.Conversion], schema: dict | None = None, taxa: DataFrame | None = None) -> dict[str, str]:
    """Each dataset's fingerprint: of its rows, its program, and of what all datasets share."""
    data, listed = data_fingerprints(rows), table_fingerprint(taxa)
    shared = json.dumps([definitions, {k: repr(c) for k, c in conversions.items()}, schema, listed], sort_keys=True, default=str)
    text = lambda d, p: json.dumps([data.get(d), columns.get(d), p, shared], sort_keys=True, default=str)
    return {d: hashlib.sha256(text(d, p).encode()).hexdigest() for d, p in programs.items()}


def known_fingerprints(spark: SparkSession, path: str) -> dict[str, str]:
    """What the database at a path was built from; nothing if there is none."""
    files, where = file_system(spark, f"{path}/{STATE}")
    if not files.exists(where):
        return {}
    return {r["dataset_id"]: r["fingerprint"] for r in spark.read.parquet(f"{path}/{STATE}").collect()}


def _delete_partitions(spark: SparkSession, table: str, datasets: list[str]) -> None:
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for d in datasets:
        files, where = file_system(spark, f"{table}/dataset_id={escape(d)}")
        files.delete(where, True)


def update(
    rows: DataFrame, columns: dict[str, list[str]], programs: dict[str, dict], path: str, definitions: dict, conversions: dict[str, rules.Conversion],
    schema: dict | None = None, taxa: DataFrame | None = None, partial: bool = False,
) -> Changes:
    """Brings the database at ``path`` (see ``sources.tables.write_database``) up to date with rows and programs.

    With ``partial``, rows and programs are some datasets' only; the others of the database stay.
    """
    spark = rows.sparkSession
    now, before = fingerprints(rows, columns, programs, definitions, conversions, schema, taxa), known_fingerprints(spark, path)
    built = sorted(d for d in now if now[d] != before.get(d))
    gone = [] if partial else sorted(d for d in before if d not in now)
    changes = Changes(built, gone, sorted(d for d in now if d not in built))
    if not built and not gone:
        return changes
    if built:
        own = rows.join(spark.createDataFrame([(d,) for d in built], "dataset_id string"), "dataset_id", "left_semi")
        db = compilation.compile_datasets(spark, own, columns, {d: programs[d] for d in built}, definitions, conversions, schema, taxa)
        for name, table in db.tables.items():
            if "dataset_id" in table.columns:
                table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(f"{path}/{name}")
                # a dataset that has no rows there any more has no partition that was overwritten
                have = {r[0] for r in table.select("dataset_id").distinct().collect()}
                _delete_partitions(spark, f"{path}/{name}", [d for d in built if d in before and d not in have])
    for name in compilation.TABLES:
        _delete_partitions(spark, f"{path}/{name}", gone)
    names = read_database(spark, path)["traits"].select("taxon_name")
    if taxa is not None:
        listed = taxa.withColumn("_list", F.monotonically_increasing_id())
        names = taxonomy.taxa_table(names, listed, "_list").drop("_list")
    names.distinct().write.mode("overwrite").parquet(f"{path}/taxa")
    state = {**before, **now} if partial else now
    spark.createDataFrame(sorted(state.items()), "dataset_id string, fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{STATE}")
    return changes


def update_folder(spark: SparkSession, folder: str, path: str, definitions: dict, conversions: dict[str, rules.Conversion], schema: dict | None = None, taxa: DataFrame | None = None, multi_line: bool = True) -> Changes:
    """Brings the database at ``path`` up to date with the datasets of a folder."""
    found = prog.discover(folder)
    programs = {d: prog.read_program(Path(folder, d, "metadata.yml")) for d in found}
    files = {d: str(Path(folder, d, "data.csv")) for d in found}
    headers = {d: compilation.read_header(p) for d, p in files.items()}
    rows = compilation.canonical_cells(compilation.read_cells(spark, files, headers, multi_line))
    return update(rows, headers, programs, path, definitions, conversions, schema, taxa)
