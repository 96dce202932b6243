"""Keeping the columns of an input apart from those that an operator makes, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but the needed ones renamed, and a function that gives an operator's result their names back.

    That takes the result and the names of columns to add; an added column replaces one of the input.
    """
    names = {c: c if c in needed else f"carried_{k}" for k, c in enumerate(docs.columns)}

    def back(out: DataFrame, *added: str) -> DataFrame:
        return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in added], *added)

    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), back
