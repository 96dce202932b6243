"""Building the list of accepted names from what datasets call their taxa and from reference lists.

Names are looked up in the lists in order, and the first list that has a name gives all of its details.  Every step
is an equi-join on names, of which each list has one row: lists are cut to their first row for a name before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_in, word
from .reshape import first_per_key
from .taxonomy import HIGHER_RANKS, LOWER_RANKS, establishment_means, genus_of, match_name

#: Columns of a reference list; those that one lacks are null.
REFERENCE = "canonical_name taxon_rank accepted_name taxon_id taxonomic_status family taxon_distribution scientific_name scientific_name_id".split()
#: Columns of the list that is built, in order.
COLUMNS = "aligned_name taxon_name taxon_rank taxonomic_status taxonomic_dataset taxon_name_alternatives genus family binomial trinomial taxon_distribution establishment_means scientific_name taxon_id taxon_id_genus taxon_id_family scientific_name_id aligned_name_taxon_id aligned_name_taxonomic_status".split()


def _reference(df: DataFrame, order: str | None) -> DataFrame:
    """A reference list with all columns and one row a name: the first in ``order`` (a column), or in the list's own order."""
    df = df.withColumn("_order", F.col(order) if order else F.monotonically_increasing_id())
    df = df.select(*[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in REFERENCE], "_order").filter("canonical_name is not null")
    return first_per_key(df, ["canonical_name"], "_order").drop("_order")


def names_to_list(updates: DataFrame, ranks: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(aligned_name, resolution, name_to_match) of the names that datasets use.

    ``updates`` is (original_name, aligned_name, taxonomic_resolution), ``ranks`` (taxon_name, taxon_rank) has ranks of
    names without a resolution; names that are only used for ``excluded`` (original_name) rows and have none are left out.
    """
    own = ranks.groupBy(F.col("taxon_name").alias("aligned_name")).agg(F.min("taxon_rank").alias("_rank"))
    names = updates.filter("aligned_name is not null").groupBy("original_name", "aligned_name").agg(F.min("taxonomic_resolution").alias("resolution")).join(own, "aligned_name", "left")
    names = names.withColumn("resolution", F.coalesce("resolution", "_rank"))
    if excluded is not None:
        gone = excluded.select("original_name", F.lit(True).alias("_gone")).distinct()
        names = names.join(gone, "original_name", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    else:
        names = names.withColumn("_gone", F.lit(False))
    names = names.groupBy("aligned_name").agg(F.min("resolution").alias("resolution"), F.bool_and("_gone").alias("excluded"))
    return names.withColumn("name_to_match", match_name(F.col("aligned_name"), F.col("resolution")))


def first_hits(names: DataFrame, lists: list[tuple[str, DataFrame]]) -> DataFrame:
    """``names`` with ``hit``: the details of the first list that has the name to match, and ``taxonomic_dataset``, its name."""
    hits = []
    for k, (label, reference) in enumerate(lists):
        details = reference.select(F.col("canonical_name").alias(f"_name{k}"), F.struct(F.lit(label).alias("taxonomic_dataset"), *REFERENCE).alias(f"_hit{k}"))
        names = names.join(details, F.col("name_to_match") == F.col(f"_name{k}"), "left").drop(f"_name{k}")
        hits.append(f"_hit{k}")
    # the rank comes from the first list that knows one
    rank = F.coalesce(*[F.col(h)["taxon_rank"] for h in hits], F.col("resolution"))
    return names.withColumns({"hit": F.coalesce(*hits), "taxon_rank": rank}).withColumn("taxonomic_dataset", F.col("hit")["taxonomic_dataset"]).drop(*hits)


def build_taxon_list(
    updates: DataFrame, ranks: DataFrame, lists: list[tuple[str, DataFrame]], genera: DataFrame, families: DataFrame,
    excluded: DataFrame | None = None, existing: DataFrame | None = None, order: str | None = None,
) -> DataFrame:
    """One row for each aligned name that a list or its resolution knows (see ``COLUMNS``).

    ``lists`` are (name, frame) in order of priority, ``genera`` (genus, taxon_id) and ``families`` (family, taxon_id)
    give ids of higher ranks.  With ``existing``, a list built before, only names that it lacks are added to it.
    """
    lists = [(label, _reference(df, order)) for label, df in lists]
    names = first_hits(names_to_list(updates, ranks, excluded), lists)
    names = names.filter(~(F.col("excluded") & F.col("taxon_rank").isNull()) & ~(F.col("taxon_rank").isNull() & F.col("taxonomic_dataset").isNull()))
    hit, rank = F.col("hit"), F.col("taxon_rank")
    low = is_in(rank, ["genus", "family"])
    full = F.coalesce(F.when(~low, hit["accepted_name"]), F.col("aligned_name"))
    # other possible names stand in brackets behind the name
    parts = F.split(full, r"\[alternative possible names:")
    out = names.withColumns({"taxon_name": F.trim(parts[0]), "taxon_name_alternatives": F.when(F.size(parts) > 1, F.regexp_replace(F.get(parts, F.lit(1)), r"\]$", "")), "taxonomic_status": F.coalesce(hit["taxonomic_status"], F.lit("unknown"))})

    # details of the accepted name are those of its own row, in the list of the hit
    accepted = reduce(DataFrame.unionByName, [df.select(F.lit(label).alias("_list"), F.struct(*REFERENCE).alias("_accepted")) for label, df in lists])
    out = out.join(accepted, (F.col("taxonomic_dataset") == F.col("_list")) & (F.col("taxon_name") == F.col("_accepted")["canonical_name"]), "left")
    has = F.col("_accepted")
    rank = F.when(low, rank).otherwise(F.coalesce(has["taxon_rank"], rank))
    out = out.withColumn("taxon_rank", rank)
    rank, high = F.col("taxon_rank"), is_in(F.col("taxon_rank"), HIGHER_RANKS)
    low = is_in(rank, ["genus", "family"])
    out = out.withColumns({"genus": F.when(~high | rank.isNull(), genus_of(F.col("taxon_name"))), "taxon_id": F.when(~low, has["taxon_id"]), "scientific_name": has["scientific_name"], "scientific_name_id": F.when(~low, has["scientific_name_id"])})

    # families of names that their row has none for go by the genus, in the first list
    by_genus = lists[0][1].filter("family is not null").groupBy(genus_of(F.col("canonical_name")).alias("_genus")).agg(F.min("family").alias("_family"))
    out = out.join(by_genus, F.col("genus") == F.col("_genus"), "left")
    out = out.withColumn("family", F.coalesce(has["family"], hit["family"], F.when(rank == "family", F.col("taxon_name")), F.col("_family")))
    for name, frame in (("genus", genera), ("family", families)):
        ids = frame.groupBy(F.col(name).alias("_of")).agg(F.min("taxon_id").alias(f"taxon_id_{name}"))
        out = out.join(ids, F.col(name) == F.col("_of"), "left").drop("_of")

    # ids of the aligned names themselves
    aligned = lists[0][1].select(F.col("canonical_name").alias("_aligned"), F.col("taxon_id").alias("aligned_name_taxon_id"), F.col("taxonomic_status").alias("aligned_name_taxonomic_status"))
    out = out.join(aligned, F.col("aligned_name") == F.col("_aligned"), "left")
    bare, below = F.trim(F.split("taxon_name", r"\[")[0]), is_in(rank, [*LOWER_RANKS, "series"])
    places = F.when(~high & ~is_in(rank, ["genus"]), has["taxon_distribution"])
    out = out.withColumns({
        "trinomial": F.when(below, bare), "binomial": F.when(rank == "species", bare).when(below, word(F.col("taxon_name"), 1, 2)),
        "taxon_distribution": places, "establishment_means": F.when(places.isNotNull(), establishment_means(places)),
    }).select(*COLUMNS)
    if existing is None:
        return out
    known = existing.select(F.col("aligned_name").alias("_known")).distinct()
    added = out.join(known, F.col("aligned_name") == F.col("_known"), "left_anti")
    return existing.select(*[(F.col(c) if c in existing.columns else F.lit(None)).cast("string").alias(c) for c in COLUMNS]).unionByName(added).dropDuplicates(["taxon_name", "aligned_name"])
