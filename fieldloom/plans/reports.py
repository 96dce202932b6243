"""Queries of the per-dataset report; each is one DataFrame of counts, shares, limits or names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import to_number
from ..operators.ranks import ranked


def trait_counts(df: DataFrame, trait: str, taxon: str) -> DataFrame:
    """Taxa, records and records per taxon (2 digits, half to even) of each trait."""
    out = df.groupBy(trait).agg(F.count_distinct(taxon).alias("taxa"), F.count("*").alias("records"))
    return out.withColumn("records_per_taxon", F.bround(F.col("records") / F.col("taxa"), 2))


def median_records_per_taxon(df: DataFrame, trait: str, taxon: str) -> DataFrame:
    return trait_counts(df, trait, taxon).agg(F.median("records_per_taxon").alias("median_records_per_taxon"))


def location_counts(df: DataFrame, locations: DataFrame, key: str) -> DataFrame:
    """Records of each location beside its details; both sides stay."""
    return df.groupBy(key).agg(F.count("*").alias("records")).join(locations, key, "full")


def excluded_counts(df: DataFrame, trait: str, error: str) -> DataFrame:
    return df.filter(F.col(error).isNotNull()).groupBy(trait, error).agg(F.count("*").alias("records"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of the total of each value."""
    counts = df.groupBy(column).agg(F.count("*").alias("records"))
    return counts.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy()))


def compare_counts(study: DataFrame, everything: DataFrame, column: str) -> DataFrame:
    """Counts of values in a study beside those of all studies; each value of all studies has a row."""
    own, total = (d.groupBy(column).agg(F.count("*").alias(n)) for d, n in ((study, "study"), (everything, "total")))
    return own.join(total, column, "right").fillna(0, ["study"])


def outliers(df: DataFrame, by: list[str], value: str, tie: list[str], low: float = 2.5, high: float = 97.5) -> DataFrame:
    """Rows whose position in their group, in percent, is below ``low`` or above ``high``."""
    df = ranked(df, by, [value, *tie], "_place", "_of")
    return df.withColumn("percentile", F.col("_place") / F.col("_of") * 100).drop("_place", "_of").filter((F.col("percentile") < low) | (F.col("percentile") > high))


def limits(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count(value).alias("records"))


def name_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """Names that changed, with the edit distance."""
    changed = df.select(old, new).filter(F.col(old) != F.col(new)).distinct()
    return changed.withColumn("distance", F.levenshtein(old, new).cast("long"))


def located(locations: DataFrame, keys: list[str]) -> DataFrame:
    """Locations with both coordinates as numbers: keys, latitude, longitude."""
    value = lambda p: F.max(F.when(F.col("location_property") == p, to_number(F.col("value"))))
    wide = locations.groupBy(*keys).agg(value("latitude (deg)").alias("latitude"), value("longitude (deg)").alias("longitude"))
    return wide.filter("latitude is not null and longitude is not null")


def outlier_share(df: DataFrame, by: list[str], value: str, tie: list[str]) -> DataFrame:
    """The share of rows of each group that lie more than 2.5 percent from the middle's ends, in percent."""
    total = df.groupBy(*by).agg(F.count("*").alias("_all"))
    far = outliers(df, by, value, tie).groupBy(*by).agg(F.count("*").alias("_far"))
    return total.join(far, by, "left").select(*by, (F.coalesce("_far", F.lit(0)) / F.col("_all") * 100).alias("outlier_share"))


def unmatched_taxa(names: DataFrame, taxa: DataFrame, columns: list[str]) -> DataFrame:
    """Different names with columns of the taxa table, empty where the table hasn't got them."""
    return names.select("taxon_name").distinct().join(taxa.select("taxon_name", *columns), "taxon_name", "left").fillna("", columns)


def undescribed(metadata: DataFrame) -> DataFrame:
    """(key, value) rows of a program's descriptions that are still to be written."""
    return metadata.filter(F.col("value") == "unknown")


def unaligned_values(excluded: DataFrame, error: str = "Unsupported trait value") -> DataFrame:
    """The different values of each trait that aren't among its allowed ones."""
    return excluded.filter(F.col("error") == error).select("trait_name", "value").distinct()


def more_properties(locations: DataFrame, main: list[str], properties: list[str]) -> DataFrame:
    """Locations with a column for each of the properties that aren't ``main``; those without any are left out.

    The properties are given (a program lists them), so that the data isn't read to find them.
    """
    rest = [p for p in properties if p not in main]
    wide = locations.filter(F.col("location_property").isin(rest)).groupBy("location_id", "location_name")
    return wide.agg(*[F.max(F.when(F.col("location_property") == p, F.col("value"))).alias(p) for p in rest])


def contexts_by_property(contexts: DataFrame) -> DataFrame:
    """Each context property with its values and what they mean, sorted, as one list; and how many ids use them."""
    one = F.struct("value", "description", F.size(F.split("link_vals", ", ")).alias("n_ids"))
    return contexts.groupBy("dataset_id", "context_property", "category").agg(F.array_sort(F.collect_list(one)).alias("values")).withColumn("n_values", F.size("values"))
