"""Tables written in the middle of a job, in the folder that all executors share.

A written table cuts lineage like ``checkpoint()`` does, but it also gives Catalyst exact sizes for
its join choices and is computed once.  The folder is ``spark.checkpoint.dir``; where a session
leaves that unset (tests on one machine), a temporary folder is used and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session, from ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns it as read back.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldloom/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    _written.append(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Paths that this process wrote, in order.
_written: list[str] = []


def written() -> int:
    """How many tables were written so far; see ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int) -> None:
    """Deletes the tables written after ``since`` (of ``written``) but the last: those of a step whose result that is."""
    jvm = spark.sparkContext._jvm
    for path in _written[since:-1]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _written[since:-1]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
