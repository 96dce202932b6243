"""Tables written in the middle of a job, in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one where a local session sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that isn't used yet; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/fieldloom/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def rule_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of a program's rules.  It comes from the driver, but Spark doesn't know its size, and would shuffle all
    measurements by its few keys for a join: it is sent to all tasks instead."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def keep(df: DataFrame, absent: Iterable[str] = ()) -> DataFrame:
    """``df`` written once and read back: lineage ends here, nothing is held in memory, and sizes are known.

    Columns ``absent`` hold nothing but nulls: they aren't written, so that rows are short and their code is small.
    """
    path, absent = new_path(df.sparkSession), set(absent)
    written = df.drop(*absent)
    written.write.parquet(path)
    out = df.sparkSession.read.schema(written.schema).parquet(path)
    if not absent & set(df.columns):
        return out
    return out.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in absent else F.col(f"`{f.name}`") for f in df.schema])
