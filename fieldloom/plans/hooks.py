"""Custom steps of a dataset as a short list of Spark SQL expressions; program text is never executed as code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked


def apply_steps(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Applies steps in order: filter, with (name: expression), select, rename, distinct, group_row_number, group_id."""
    for step in steps:
        ((kind, what),) = step.items()
        if kind == "filter":
            df = df.filter(what)
        elif kind == "with":
            df = df.withColumns({name: F.expr(text) for name, text in what.items()})
        elif kind == "select":
            df = df.select(*what)
        elif kind == "rename":
            df = df.withColumnsRenamed(what)
        elif kind == "distinct":
            df = df.dropDuplicates(what or None)
        elif kind == "group_row_number":
            df = df.withColumn(what["name"], F.row_number().over(Window.partitionBy(*what["by"]).orderBy(*what["order"])))
        elif kind == "group_id":
            groups = ranked(df.select(*what["by"]).distinct(), [], what["by"], what["name"], "_groups").drop("_groups")
            df = df.join(groups, what["by"])
        else:
            raise ValueError(f"no such step: {kind}")
    return df
