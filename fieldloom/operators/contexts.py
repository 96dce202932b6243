"""Contexts and locations: value mapping, ids of combined keys, and tables that link ids to what they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pad_id, paste
from .ids import dense_id

#: Categories in the order in which ids are made.
CATEGORIES = ["plot_context", "treatment_context", "entity_context", "temporal_context", "method_context"]
#: Properties that come first in the locations table.
FIRST_PROPERTIES = ["description", "latitude (deg)", "longitude (deg)"]
CONTEXT_COLUMNS = "dataset_id string, context_property string, category string, var_in string, find string, value string, description string, rule int"


def values_from_data(df: DataFrame, column: str, row: str = "_row") -> DataFrame:
    """Different non-null texts of a column in order of appearance: (value, first)."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.min(row).alias("first"))


def map_contexts(df: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>_mapped`` for each context column: the value that its rule gives for the text there.

    A rule's ``find`` is its value if absent; the first rule for a text counts.
    """
    for c in columns:
        table = rules.filter(F.col("var_in") == c).select("dataset_id", F.coalesce("find", "value").alias("_find"), F.col("value").alias("_v"), "rule")
        table = table.groupBy("dataset_id", "_find").agg(F.min_by(F.struct("_v"), "rule")["_v"].alias(f"{c}_mapped")).withColumnRenamed("dataset_id", "_d")
        df = df.join(table, (F.col("dataset_id") == F.col("_d")) & (F.col(c).cast("string") == F.col("_find")), "left").drop("_d", "_find")
    return df


def context_ids(df: DataFrame, category: str, mapped: list[str], source: DataFrame | None = None) -> DataFrame:
    """Adds ``<category>_id``: sorted padded number of the combined values (missing ones as NA); null if all are missing."""
    known = F.coalesce(*[F.col(c) for c in mapped]).isNotNull()
    return dense_id(df, paste(mapped, "_"), f"{category}_id", ["dataset_id"], where=known, source=source)


def context_links(df: DataFrame, category: str, mapped: dict[str, str], row: str = "_row") -> DataFrame:
    """(dataset_id, context_property, value, link_id, link_vals): ids in which each value takes part, by first appearance.

    ``mapped`` gives the property of each mapped column.
    """
    link = f"{category}_id"
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("context_property"), F.col(c).alias("value")) for c, p in mapped.items()]))
    return linked(df.select("dataset_id", row, F.col(link).alias("id"), each.alias("e")).select("dataset_id", row, "id", "e.*"), link, row)


def linked(rows: DataFrame, link: str, row: str) -> DataFrame:
    """The same from rows (dataset_id, ``row``, id, context_property, value)."""
    rows = rows.filter("value is not null and id is not null")
    first = rows.groupBy("dataset_id", "context_property", "value", "id").agg(F.min(row).alias("first"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "id"))), lambda x: x["id"]), ", ")
    return first.groupBy("dataset_id", "context_property", "value").agg(ids.alias("link_vals")).withColumn("link_id", F.lit(link))


def contexts_table(rules: DataFrame, links: DataFrame) -> DataFrame:
    """The contexts table: rules with the ids that use them; values that are missing go, equal values are one row."""
    rows = rules.filter("value is not null").groupBy("dataset_id", "context_property", "category", "value").agg(F.min_by("description", "rule").alias("description"))
    return rows.join(links, ["dataset_id", "context_property", "value"], "left").select("dataset_id", "context_property", "category", "value", "description", "link_id", "link_vals")


def locations_table(properties: DataFrame) -> DataFrame:
    """(dataset_id, location_id, location_name, location_property, value) from rows without the id.

    Locations are numbered in order of their names.
    """
    return dense_id(properties, F.col("location_name"), "location_id", ["dataset_id"]).select("dataset_id", "location_id", "location_name", "location_property", "value")


def property_order(column: str = "location_property"):
    """Sort key of properties: description, latitude, longitude, the others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in FIRST_PROPERTIES]), F.col(column)), F.lit(0)), F.lit(len(FIRST_PROPERTIES) + 1))


def attach_locations(df: DataFrame, locations: DataFrame) -> DataFrame:
    """Adds location_id by name; null for species and where the entity type is missing."""
    names = locations.select("dataset_id", F.col("location_name").alias("_name"), F.col("location_id").alias("_id")).distinct().withColumnRenamed("dataset_id", "_d")
    out = df.join(names, F.col("dataset_id").eqNullSafe(F.col("_d")) & F.col("location_name").eqNullSafe(F.col("_name")), "left")
    return out.withColumn("location_id", F.when(F.col("entity_type") != "species", F.col("_id"))).drop("_d", "_name", "_id")


def override_by_location(df: DataFrame, locations: DataFrame, fields: list[str]) -> DataFrame:
    """Row attributes replaced by location properties of the same name, where the location has them."""
    wide = locations.filter(F.col("location_property").isin(fields)).groupBy("dataset_id", "location_id").agg(*[F.max(F.when(F.col("location_property") == f, F.col("value"))).alias(f"_{f}") for f in fields])
    wide = wide.withColumnRenamed("dataset_id", "_d").withColumnRenamed("location_id", "_l")
    out = df.join(wide, (F.col("dataset_id") == F.col("_d")) & (F.col("location_id") == F.col("_l")), "left")
    return out.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop("_d", "_l", *[f"_{f}" for f in fields])


def numbered(df: DataFrame, by: list[str], order: list, name: str):
    """Padded row number within a group of bounded size."""
    window = Window.partitionBy(*by)
    return df.withColumn(name, pad_id(F.row_number().over(window.orderBy(*order)), F.count("*").over(window)))
