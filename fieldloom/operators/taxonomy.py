"""Taxon names: updates, alignment with a list of accepted names, the taxa table, and names derived from names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_in, standardise_name, word
from ..sources.scratch import keep, rule_table
from .reshape import first_per_key
from .rules import compose


#: So many different names are standardised once each and sent to all tasks; of more, each row's is.
FEW_NAMES = 100_000


def update_names(df: DataFrame, updates: list[tuple[str, str, str | None]], source: DataFrame | None = None) -> DataFrame:
    """original_name, updated taxon_name and taxonomic_resolution by updates (find, replace, resolution).

    Updates apply in sequence; names that none hits are standardised, but only if there are updates at all.
    ``source`` has the same names, read more cheaply.
    """
    df = df.withColumn("original_name", F.col("taxon_name"))
    if not updates or any(u[0] is None for u in updates):
        return df.withColumn("taxonomic_resolution", F.lit(None).cast("string"))
    rows = [(k, name, updates[last][2]) for k, (name, last) in compose([(f, r) for f, r, _ in updates]).items()]
    table = rule_table(df.sparkSession, rows, "_find string, _to string, _resolution string")
    out = df.join(table, F.col("taxon_name") == F.col("_find"), "left")
    hit, standard = F.col("_find").isNotNull(), standardise_name(F.col("taxon_name"))
    if source is not None:
        names = keep(source.select(F.col("taxon_name").alias("_name")).filter("_name is not null").distinct())
        if names.count() <= FEW_NAMES:
            names = F.broadcast(names.withColumn("_standard", standardise_name(F.col("_name"))))
            out, standard = out.join(names, F.col("taxon_name") == F.col("_name"), "left"), F.col("_standard")
    return out.withColumns({"taxon_name": F.when(hit, F.col("_to")).otherwise(standard), "taxonomic_resolution": F.col("_resolution")}).drop("_find", "_to", "_resolution", "_name", "_standard")


def accept_names(df: DataFrame, taxa: DataFrame) -> DataFrame:
    """taxon_name becomes the accepted name of the aligned name, where the list has one.

    The list is joined as it stands: an aligned name that it has twice gives two rows.
    """
    names = taxa.select(F.col("aligned_name").alias("_aligned"), F.col("taxon_name").alias("_accepted"))
    out = df.join(names, F.col("taxon_name") == F.col("_aligned"), "left")
    return out.withColumn("taxon_name", F.coalesce("_accepted", "taxon_name")).drop("_aligned", "_accepted")


def taxa_table(names: DataFrame, taxa: DataFrame, order: str) -> DataFrame:
    """One row for each different name: the first row of the list for it, or nulls; alignment columns go."""
    keep = [c for c in taxa.columns if "align" not in c]
    details = first_per_key(taxa.select(*dict.fromkeys([*keep, order])), ["taxon_name"], order)
    return names.select("taxon_name").filter("taxon_name is not null").distinct().join(details, "taxon_name", "left").select(*keep)


def taxonomic_updates_table(df: DataFrame, taxa: DataFrame | None, excluded: list[str]) -> DataFrame:
    """The different name changes of a dataset, with the list's ids, without names that were excluded."""
    rows = df.select("dataset_id", "original_name", F.col("taxon_name").alias("aligned_name"), "taxonomic_resolution").distinct()
    if excluded:
        gone = rule_table(df.sparkSession, [(x,) for x in excluded], "n string").select(standardise_name(F.col("n")).alias("aligned_name")).distinct()
        rows = rows.join(gone, "aligned_name", "left_anti").select(*rows.columns)
    return with_list(rows, taxa)


def with_list(rows: DataFrame, taxa: DataFrame | None) -> DataFrame:
    """Name changes (dataset_id, original_name, aligned_name, taxonomic_resolution) with what the list has of the aligned name."""
    if taxa is None:
        return rows.withColumn("taxon_name", F.col("aligned_name"))
    more = [c for c in taxa.columns if c.startswith("aligned_name_")]
    out = rows.join(taxa.select("aligned_name", "taxon_name", *more).distinct(), "aligned_name", "left").distinct()
    return out.select("dataset_id", "original_name", "aligned_name", "taxonomic_resolution", F.coalesce("taxon_name", "aligned_name").alias("taxon_name"), *more)


def genus(name: Column) -> Column:
    return word(name, 1)


def binomial(name: Column, rank: Column) -> Column:
    """The first two words, for species and ranks below."""
    return F.when(is_in(rank, ["species", "subspecies", "variety", "form", "series"]), word(name, 1, 2))


def trinomial(name: Column, rank: Column) -> Column:
    """The whole name, for ranks below species."""
    return F.when(is_in(rank, ["subspecies", "variety", "form", "series"]), name)


def establishment_means(distribution: Column) -> Column:
    """native, naturalised or both, from how often the word stands among comma-separated places."""
    places = F.size(F.split(distribution, ","))
    naturalised = F.regexp_count(distribution, F.lit("naturalised"))
    mixed = F.regexp_count(distribution, F.lit("native and naturalised"))
    return F.when(naturalised == 0, "native").when((mixed > 0) | (naturalised < places), "native and naturalised").otherwise("naturalised")


#: Ranks below species, and those above genus.
LOWER_RANKS, HIGHER_RANKS = ["subspecies", "variety", "form"], ["family", "order", "class", "phylum", "kingdom"]


def genus_of(name: Column) -> Column:
    """The first word, or the first two of a hybrid genus (``x Name``)."""
    return F.when(word(name, 1) == "x", F.coalesce(word(name, 1, 2), name)).otherwise(word(name, 1))


def match_name(name: Column, rank: Column) -> Column:
    """The part of a name to look up: the genus of one resolved to genus or family; no notes in brackets."""
    noted = name.contains("[")
    return F.when(is_in(rank, ["genus", "family"]), genus_of(name)).when(noted & (rank == "species"), word(name, 1, 2)).when(noted & is_in(rank, LOWER_RANKS), word(name, 1, 3)).otherwise(name)
