"""Dense, padded identifiers by sorted or first-seen order, and the ids of populations, individuals and observations.

Ids are computed on the different keys and joined back.  Keys that are about as many as rows (``many``) are numbered
in ranges, so that no task sorts all measurements of a dataset.  A missing key has no id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_in, pad_id, paste
from ..sources.scratch import keep
from .ranks import ranked

POPULATION_ENTITIES = ["individual", "population", "metapopulation"]
#: Parts of an observation's key, in order.
OBSERVATION_KEY = ["taxon_name", "population_id", "individual_id", "temporal_context_id", "entity_type", "life_stage", "source_id", "entity_context_id", "basis_of_record", "collection_date", "original_name"]
REPEAT_KEY = ["dataset_id", "observation_id", "trait_name", "value_type", "method_id", "method_context_id"]


def dense_id(df: DataFrame, key: Column, name: str, by: list[str], first_seen: str | None = None, prefix: str = "", where: Column | None = None, many: bool = False, source: DataFrame | None = None, sparse: bool = False) -> DataFrame:
    """Adds ``name``: the padded number of each row's key among the keys of its group.

    Keys are numbered in order of their text or, with ``first_seen`` (a column that orders rows), of their
    first row.  Rows outside ``where`` count for the numbering only if where is None, and get no id.
    The keys are those of ``source``, if given: the same rows, read more cheaply (several ids of one written frame then
    don't compute each other).  With ``sparse``, rows without a key don't take part in the join: in it all of them would
    meet in few tasks.
    """
    text = key.cast("string") if where is None else F.when(where, key.cast("string"))
    keyed = None if source is None else source.withColumn("_key", text)
    df = df.withColumn("_key", text)
    keys = (df if keyed is None else keyed).filter(F.col("_key").isNotNull())
    keys = keys.groupBy(*by, "_key").agg(F.min(first_seen).alias("_order")) if first_seen else keys.select(*by, "_key").distinct().withColumn("_order", F.col("_key"))
    if many:
        keys = ranked(keys, by, ["_order"], "_id", "_n")
    else:
        keys = keep(keys)  # few: read back, Spark knows their size when it plans the join
        window = Window.partitionBy(*by)
        keys = keys.withColumn("_id", F.row_number().over(window.orderBy("_order"))).withColumn("_n", F.count("*").over(window))
    keys = keys.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_key").alias("_key2"), F.concat(F.lit(prefix), pad_id(F.col("_id"), F.col("_n"))).alias("_new"))
    own = [f"_by_{b}" for b in by]
    same = [F.col(b).eqNullSafe(F.col(o)) for b, o in zip(by, own)] + [F.col("_key") == F.col("_key2")]
    if many:
        # rows are sorted for the join by a hash first: long texts that start alike are slow to compare
        keys = keys.withColumn("_mark2", F.xxhash64(*own, "_key2"))
        df, same = df.withColumn("_mark", F.xxhash64(*by, "_key")), [F.col("_mark") == F.col("_mark2"), *same]
    out = (df.filter("_key is not null") if sparse else df).join(keys, same, "left").drop("_key2", "_mark2", *own)
    if sparse:
        out = out.unionByName(df.filter("_key is null").withColumn("_new", F.lit(None).cast("string")))
    return out.withColumn(name, F.col("_new")).drop("_key", "_new", "_mark")


def population_ids(df: DataFrame, row: str = "_row") -> DataFrame:
    """population_id from location, plot and treatment; ``pop_unk`` where none is known.

    Codes go by first appearance over all rows of the dataset, those without any part included.
    """
    parts = ["location_name", "plot_context_id", "treatment_context_id"]
    df = dense_id(df, paste(parts), "_code", ["dataset_id"], row)
    known = F.coalesce(*[F.col(p) for p in parts]).isNotNull()
    here = is_in(F.col("entity_type"), POPULATION_ENTITIES)
    return df.withColumn("population_id", F.when(here & known, F.col("_code")).when(here, F.lit("pop_unk"))).drop("_code")


def individual_ids(df: DataFrame, row: str = "_row") -> DataFrame:
    """individual_id within taxon and population, from the mapped column or, if it is empty, from parsing_id."""
    entity, nowhere = F.col("entity_type"), F.col("population_id").isNull()
    # of rows without a population only those of datasets where one of them gets a code count for the numbering
    coded = nowhere & (entity.isNull() | (entity == "individual"))
    about = keep(df.groupBy(F.col("dataset_id").alias("_d")).agg((F.count("individual_id") > 0).alias("_mapped"), F.bool_or(coded).alias("_coded")))
    df = df.join(about, F.col("dataset_id").eqNullSafe(F.col("_d"))).drop("_d")
    # a record counts that has a value of an individual; most rows show it themselves, the others look for their record
    shown = F.coalesce(F.col("value").isNotNull() & entity.contains("individual"), F.lit(False))
    counts, asks = ~nowhere | F.col("_coded"), ~F.col("_mapped") & ~shown
    given = F.when(F.col("individual_id").isNull() & (entity == "individual"), F.col("parsing_id")).otherwise(F.col("individual_id"))
    one = F.when(F.col("_mapped"), given).when(shown, F.col("parsing_id"))
    asking = df.filter(counts & asks)
    out = df.withColumn("individual_id", F.when(counts, one))
    if not asking.isEmpty():
        # combined before the shuffle, as a record can be a whole taxon
        records = df.filter(~F.col("_mapped") & shown).select(F.col("dataset_id").alias("_d"), F.col("parsing_id").alias("_p")).distinct().withColumn("_any", F.lit(True))
        asking = asking.join(records, F.col("dataset_id").eqNullSafe(F.col("_d")) & F.col("parsing_id").eqNullSafe(F.col("_p")), "left")
        out = out.filter(~(counts & asks)).unionByName(asking.withColumn("individual_id", F.when(F.col("_any"), F.col("parsing_id"))).drop("_d", "_p", "_any"))
    group = ["dataset_id", "taxon_name", "population_id"]
    df = dense_id(out, F.col("individual_id"), "_code", group, row, many=True, sparse=True)
    code = F.when(F.col("entity_type") == "individual", F.col("_code")).when(F.col("entity_type").isNull(), F.concat(F.lit("entity_unk"), F.col("_code")))
    return df.withColumn("individual_id", code).drop("_mapped", "_coded", "_code")


def observation_ids(df: DataFrame) -> DataFrame:
    """observation_id: sorted number of the observation's key within the dataset, for rows with a value."""
    return dense_id(df, paste(OBSERVATION_KEY, "-"), "observation_id", ["dataset_id"], where=F.col("value").isNotNull(), many=True)


def repeat_measurement_ids(df: DataFrame, repeated: Column, row: str = "_row") -> DataFrame:
    """repeat_measurements_id: padded row number within an observation's trait, where ``repeated``; else as it was."""
    on = F.coalesce(repeated & F.col("value").isNotNull(), F.lit(False))
    window = Window.partitionBy(*REPEAT_KEY, on)
    number = pad_id(F.row_number().over(window.orderBy(row)), F.count("*").over(window))
    return df.withColumn("repeat_measurements_id", F.when(on, number).otherwise(F.col("repeat_measurements_id").cast("string")))


def method_ids(methods: DataFrame, row: str = "_row") -> DataFrame:
    """(dataset_id, trait_name, methods, method_id): the different methods of each trait by first appearance."""
    first = methods.groupBy("dataset_id", "trait_name", "methods").agg(F.min(row).alias(row))
    window = Window.partitionBy("dataset_id", "trait_name")
    number = F.row_number().over(window.orderBy(row))
    return first.withColumn("method_id", F.when(F.col("methods").isNotNull(), pad_id(number, F.count("methods").over(window)))).drop(row)


def parsing_ids(df: DataFrame, individual: str | None, is_long: bool, row: str = "_row") -> DataFrame:
    """parsing_id: which rows of the raw data were one record."""
    if is_long:
        parts = [F.regexp_replace("taxon_name", " ", "-"), *[F.col(c) for c in ("location_name", individual) if c and c in df.columns]]
        key = paste(parts, "_")
    elif individual:
        key = F.coalesce(F.col(individual).cast("string"), F.concat(F.lit("temp_"), F.col(row).cast("string")))
    else:
        key = F.col(row)
    df = dense_id(df, key, "_parsed", ["dataset_id"], row, many=True)
    return df.withColumn("parsing_id", F.concat_ws("_", "dataset_id", "_parsed")).drop("_parsed")
