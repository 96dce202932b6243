"""Reading and writing tables: CSV as text with missing tokens, canonical text of typed columns, databases on disk."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import number_text, to_number
from ..plans.database import TABLES, Database
from . import scratch
from .program import to_bibtex

#: Texts that stand for a missing value.
MISSING_TOKENS = ["", "NA"]
YAML_MISSING = [".na", ".na.character"]
#: Tables of the plain-text form of a database.
PLAINTEXT_TABLES = ["traits", "locations", "contexts", "methods", "excluded_data", "taxonomic_updates", "taxa", "contributors"]


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV with all columns as text; missing tokens are null; ``_row`` is the order in the file.

    Without ``multi_line`` quoted texts can't have line ends, and large files are read in parts.
    """
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("inferSchema", False).csv(path)
    out = df.select(*[F.when(~F.col(f"`{c}`").isin(MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return out.withColumn("_row", F.monotonically_increasing_id())


def in_file_order(rows: DataFrame) -> DataFrame:
    """Adds ``_row``, from 0 in each file, to rows as scanned with _path, _block and _id, and written.

    ``_id`` is Spark's increasing id of the scan: rows of a block are numbered one after another; blocks, few, are summed.
    """
    blocks = rows.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("_path").alias("_p"), F.col("_block").alias("_b"), "_first", before.alias("_before"))
    out = rows.join(blocks, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return out.withColumn("_row", F.col("_before") + F.col("_id") - F.col("_first")).drop("_p", "_b", "_first", "_before")


def scan_places() -> list:
    """Columns of a scan that tell where its rows stand; see ``in_file_order``."""
    return [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")]


def corrupt_rows(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """(file, row, record) of the rows of CSV files that don't fit their header: longer, shorter, or badly quoted.

    ``row`` is the row's number in its file, from 1 after the header; all files have the first one's header.  The scan
    is permissive and distributed: no row stops it, and without ``multi_line`` large files are read in parts.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    names = spark.read.options(header=True, multiLine=multi_line, escape='"').csv(path).columns
    schema = ", ".join([*[f"c{k} string" for k in range(len(names))], "_corrupt_record string"])
    rows = spark.read.schema(schema).options(**options).csv(path)
    # all columns are read, as those that aren't would not be checked
    seen = F.coalesce(*[F.col(f"c{k}") for k in range(len(names))]).isNotNull() if names else F.lit(False)
    rows = scratch.keep(rows.select(*scan_places(), F.col("_corrupt_record").alias("record"), seen.alias("_seen")))
    return in_file_order(rows).filter("record is not null").select(F.col("_path").alias("file"), (F.col("_row") + 1).alias("row"), "record")


def canonical_text(df: DataFrame, skip: tuple[str, ...] = ("_row",)) -> DataFrame:
    """Texts as typed reading would print them.

    A column whose texts are all numbers is printed with 15 digits, one of all clock times as HH:MM:SS, one of
    all T, F, TRUE and FALSE as TRUE and FALSE; others stay.  One aggregation decides for all columns.
    """
    columns = [c for c in df.columns if c not in skip]
    if not columns:
        return df
    col = lambda c: F.col(f"`{c}`")
    clock, logical = r"^\d{1,2}:\d{2}(:\d{2})?$", ["T", "F", "TRUE", "FALSE"]
    tests = {"n": lambda c: to_number(col(c)).isNotNull(), "t": lambda c: col(c).rlike(clock), "l": lambda c: col(c).isin(logical)}
    found = df.agg(*[F.coalesce(F.bool_and(F.when(col(c).isNotNull(), test(c))), F.lit(False)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, test in tests.items()]).first()
    new = {}
    for i, c in enumerate(columns):
        if found[f"l{i}"]:
            new[c] = F.when(col(c).isin(["T", "TRUE"]), "TRUE").when(col(c).isNotNull(), "FALSE")
        elif found[f"n{i}"]:
            new[c] = number_text(to_number(col(c)))
        elif found[f"t{i}"]:
            full = F.when(F.size(F.split(col(c), ":")) == 2, F.concat(col(c), F.lit(":00"))).otherwise(col(c))
            new[c] = F.when(F.length(full) == 7, F.concat(F.lit("0"), full)).otherwise(full)
    return df.withColumns(new) if new else df


def write_plaintext(db: Database, path: str, one_file: bool = False) -> None:
    """A database as CSV tables (missing values are empty), YAML documents, ``sources.bib`` and ``build_info.md``.

    Each table is a folder of parts, which all executors write; with ``one_file``, for small databases, one CSV file.
    All go to the store of ``path``; the documents are small and written by the driver.
    """
    spark = next(iter(db.tables.values())).sparkSession
    files, top = file_system(spark, path)
    files.delete(top, True)
    for name in PLAINTEXT_TABLES:
        if name in db.tables:
            target = f"{path}/{name}.csv"
            table = db[name].coalesce(1) if one_file else db[name]
            table.write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(f"{target}.parts" if one_file else target)
            if one_file:
                parts = file_system(spark, f"{target}.parts/part-*.csv")[1]
                files.rename(files.globStatus(parts)[0].getPath(), file_system(spark, target)[1])
                files.delete(parts.getParent(), True)
    for name in ("definitions", "schema", "metadata"):
        write_document(spark, f"{path}/{name}.yml", yaml.safe_dump(getattr(db, name), sort_keys=False, allow_unicode=True))
    write_document(spark, f"{path}/sources.bib", "\n".join(to_bibtex(s) for s in {s["key"]: s for s in _entries(db.sources)}.values()))
    write_document(spark, f"{path}/build_info.md", "".join(f"- {k}: {v}\n" for k, v in db.build_info.items()))


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, whatever store that is in, and the path there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file of the store."""
    files, where = file_system(spark, path)
    out = files.create(where, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def _entries(sources: dict) -> list[dict]:
    """All bibliography entries of one dataset's sources or of several datasets'."""
    found = []
    for s in sources.values():
        if isinstance(s, dict):
            found += [s] if "key" in s else _entries(s)
    return found


def write_database(db: Database, path: str) -> None:
    """A database as one Parquet folder per table, cut by dataset where the table has one."""
    for name, table in db.tables.items():
        writer = table.write.mode("overwrite")
        (writer.partitionBy("dataset_id") if "dataset_id" in table.columns else writer).parquet(f"{path}/{name}")


def read_database(spark: SparkSession, path: str) -> Database:
    tables = {}
    for name, columns in TABLES.items():
        try:
            table = spark.read.option("basePath", f"{path}/{name}").schema(", ".join(f"`{c}` string" for c in columns)).parquet(f"{path}/{name}")
            tables[name] = table.select(*columns)
        except Exception as error:  # a table that the database hasn't got
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return Database(tables)
