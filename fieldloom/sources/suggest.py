"""What a program can be filled with from the data: names of traits, rows of locations, values of contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import program as prog


def values_of(df: DataFrame, column: str) -> DataFrame:
    """The different texts of a column, without missing ones."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def rows_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """The different rows of some columns; missing values count as one value."""
    return df.select(*columns).distinct()


def add_traits_from(program: dict, df: DataFrame, long_column: str | None = None, columns: list[str] | None = None) -> dict:
    """Maps the trait names of a long table's column, or the given columns (all, if none are) of a wide one."""
    names = [r[0] for r in values_of(df, long_column).orderBy(long_column).collect()] if long_column else columns or [c for c in df.columns if c != "_row"]
    return prog.add_traits(program, names)


def add_locations_from(program: dict, df: DataFrame, name: str, columns: list[str]) -> dict:
    """Locations from the different rows of a name column and property columns."""
    rows = rows_of(df.filter(F.col(name).isNotNull()), [name, *columns]).orderBy(name).collect()
    return prog.add_locations(program, [r.asDict() for r in rows], name)


def add_contexts_from(program: dict, df: DataFrame, columns: list[str], overwrite: bool = False) -> dict:
    """A context for each column, with its different texts."""
    return prog.add_contexts(program, {c: [str(r[0]) for r in values_of(df, c).orderBy(c).collect()] for c in columns}, overwrite)
