"""Wide and long layouts, entity-attribute-value tables, conforming to a column list."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TraitMap:
    """How one column (wide) or trait name (long) of the raw data becomes a trait."""

    var_in: str
    trait_name: str | None
    unit_in: str | None = None
    methods: str | None = None
    overrides: dict = field(default_factory=dict)


def column_or_constant(columns: list[str], text: str | None, vocabulary: tuple[str, ...] = ()) -> Column:
    """A column of that name, unless the text is a vocabulary term; else the text itself."""
    if text is not None and text in columns and text not in vocabulary:
        return F.col(f"`{text}`").cast("string")
    return F.lit(text).cast("string")


def wide_to_long(df: DataFrame, maps: list[TraitMap], keep: list[str], vocabulary: tuple[str, ...] = ()) -> DataFrame:
    """One row per row and trait map, in the order of the maps: trait_index, trait_name, unit_in, methods, value.

    Values that are null stay (they are flagged later).  Several maps may read one column.  A map's
    overrides and unit replace the columns they name, by a column of the data (nulls included) or by a constant.
    """
    maps = [m for m in maps if m.trait_name is not None]
    if lost := [m.var_in for m in maps if m.var_in not in df.columns]:
        raise ValueError(f"mapped columns are not in the data: {lost}")
    fields = sorted({k for m in maps for k in m.overrides})
    one = lambda k, m: F.struct(
        F.lit(k).alias("trait_index"),
        F.lit(m.trait_name).alias("trait_name"),
        (F.col("unit_in").cast("string") if m.unit_in is None and "unit_in" in df.columns else column_or_constant(df.columns, m.unit_in, vocabulary)).alias("unit_in"),
        F.lit(m.methods).cast("string").alias("methods"),
        F.col(f"`{m.var_in}`").cast("string").alias("value"),
        *[(column_or_constant(df.columns, m.overrides[f], vocabulary) if f in m.overrides else F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")).alias(f) for f in fields],
    )
    rest = [c for c in keep if c not in fields]
    long = df.select(*rest, F.explode(F.array(*[one(k, m) for k, m in enumerate(maps)])).alias("_one"))
    return long.select(*rest, "_one.*")


def map_long(df: DataFrame, maps: list[TraitMap], trait: str, vocabulary: tuple[str, ...] = ()) -> DataFrame:
    """Rows of long data whose trait is mapped, with the map's names, units, methods and overrides."""
    known = [m for m in maps if m.trait_name is not None]
    spark = df.sparkSession
    first = {m.var_in: k for k, m in reversed(list(enumerate(known)))}  # of several maps of one name, the first
    table = spark.createDataFrame([(k, m.var_in, m.trait_name, m.unit_in, m.methods) for k, m in enumerate(known) if first[m.var_in] == k], "trait_index int, _var string, _trait string, _unit string, _methods string")
    out = df.join(table, F.col(trait) == F.col("_var"))
    for name in sorted({k for m in known for k in m.overrides}):
        value = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        chain = None
        for k, m in enumerate(known):
            if name in m.overrides:
                new = column_or_constant(df.columns, m.overrides[name], vocabulary)
                chain = chain.when(F.col("trait_index") == k, new) if chain is not None else F.when(F.col("trait_index") == k, new)
        out = out.withColumn(name, chain.otherwise(value))
    unit = F.coalesce("_unit", "unit_in") if "unit_in" in df.columns else F.col("_unit")
    for k, m in enumerate(known):
        if m.unit_in is not None and m.unit_in in df.columns and m.unit_in not in vocabulary:
            unit = F.when(F.col("trait_index") == k, F.col(f"`{m.unit_in}`").cast("string")).otherwise(unit)
    return out.withColumns({"trait_name": F.col("_trait"), "unit_in": unit, "methods": F.col("_methods")}).drop("_var", "_trait", "_unit", "_methods")


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns, as text; those that are lacking are null."""
    return df.select(*[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def to_eav(df: DataFrame, keys: list[str], properties: list[str], name: str = "property") -> DataFrame:
    """One row per row and property; nulls stay."""
    return df.select(*keys, *[F.col(p).cast("string").alias(p) for p in properties]).unpivot(keys, properties, name, "value")


def from_eav(df: DataFrame, keys: list[str], properties: list[str], name: str = "property") -> DataFrame:
    """One column per property; the properties are given, so that the data isn't read to find them."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == p, F.col("value"))).alias(p) for p in properties])


def list_to_rows(spark, items: dict) -> DataFrame:
    """(key, value) rows of a flat mapping."""
    return spark.createDataFrame([(str(k), None if v is None else str(v)) for k, v in items.items()], "key string, value string")


def records_to_rows(spark, records: list[dict]) -> DataFrame:
    """Rows of a list of mappings, all text; what is missing, empty or a list of nothing is null."""
    names = list(dict.fromkeys(k for r in records for k in r))
    one = lambda v: None if v in (None, [None], [], ".na", ".na.character") else str(v)
    return spark.createDataFrame([tuple(one(r.get(n)) for n in names) for r in records], ", ".join(f"`{n}` string" for n in names))


def rows_to_records(df: DataFrame) -> list[dict]:
    """Mappings of the rows of a small (configuration) table."""
    return [r.asDict() for r in df.collect()]


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by ``order``, with all its columns (aggregation, no sort of a group)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(*keys, "_first.*")
