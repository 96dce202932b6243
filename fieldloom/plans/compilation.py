"""Builds of many datasets in one plan: rule tables keyed by dataset joined to one frame of all datasets' rows.

Datasets have different columns, so a row is (dataset_id, _row, cells), cells being a map of its columns.  Whatever
differs between programs is data: one table of specifications, a row a dataset, and rule tables with a dataset_id.
So the number of Spark jobs and the size of the plan don't depend on how many datasets there are, and datasets are
harmonised together however small or large they are.  ``build.process_dataset`` is the same for one dataset whose columns
are columns of the plan; custom steps (which see columns) are done there, and bound to the rest.

Edge cases: a dataset without rows gives its program's tables only; columns whose name a header repeats are told apart
by their place (``name...3``); a missing cell is null; programs that name a column that the data lacks take the name as
a constant, but for a trait's column, which is an error that names all of them.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_in, number_text, paste, separate_and_sort, standardise_name, to_number
from ..operators import contexts as ctx
from ..operators import ids, rules, taxonomy
from ..operators.reshape import conform
from ..sources import program as prog
from ..sources import scratch
from ..sources.tables import MISSING_TOKENS, in_file_order, scan_places
from . import build as single
from .build import DATASET_FIELDS, LOCATION_FIELDS
from .database import TABLES, VALUE_TYPES, Database, bind_databases, value_type_order

SOURCE = "struct<column: string, text: string>"
MAP = f"struct<trait_index: int, var_in: string, trait_name: string, over: map<string, {SOURCE}>>"
CONTEXT = "struct<category: string, var_in: string, context_property: string, ruled: boolean>"
IDENTIFIER = "struct<var_in: string, identifier_type: string, institution_code: string>"
SPECIFICATION = f"dataset_id string, is_long boolean, trait_column string, value_column string, fields map<string, {SOURCE}>, maps array<{MAP}>, contexts array<{CONTEXT}>, context_rules map<string, string>, identifiers array<{IDENTIFIER}>, updated boolean"
#: Between a context's column and a text, in the key of a context rule.
BETWEEN = "\x1f"


# --- reading

def header_names(names: list[str]) -> list[str]:
    """Names of columns, told apart by their place where they repeat or are empty."""
    return [n if n and names.count(n) == 1 else f"{n}...{k + 1}" for k, n in enumerate(names)]


def read_header(path: str | Path) -> list[str]:
    """The first line of a CSV file; empty for an empty file."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        return header_names(next(csv.reader(f), []))


def read_cells(spark: SparkSession, files: dict[str, str], headers: dict[str, list[str]], multi_line: bool = True) -> DataFrame:
    """(dataset_id, _row, cells) of the CSV files of datasets; ``_row`` is the row's number in its file, from 1.

    All files are one scan.  Without ``multi_line`` quoted texts can't have line ends, and large files are read in parts,
    whose rows are numbered in the order of the file.  Rows are read once, and written to the shared folder.
    """
    width = max([1, *map(len, headers.values())])
    columns = [f"c{k}" for k in range(width)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", False).option("multiLine", multi_line).option("escape", '"').csv(list(files.values()))
    rows = in_file_order(scratch.keep(raw.select(*scan_places(), F.array(*columns).alias("_cells"))))
    known = spark.createDataFrame([(d, f"{Path(p).parent.name}/{Path(p).name}", headers[d]) for d, p in files.items()], "dataset_id string, _name string, _header array<string>")
    name = F.array_join(F.slice(F.split(F.url_decode("_path"), "/"), -2, 2), "/")
    rows = rows.filter("_row > 0").join(known, name == F.col("_name"))
    texts = F.transform(F.slice("_cells", F.lit(1), F.size("_header")), lambda x: F.when(~x.isin(MISSING_TOKENS), x))
    return rows.select("dataset_id", "_row", F.map_from_arrays("_header", texts).alias("cells"))


def canonical_cells(rows: DataFrame) -> DataFrame:
    """Texts as typed reading would print them; one aggregation decides for all columns of all datasets.

    See ``sources.tables.canonical_text``.
    """
    clock, logical = r"^\d{1,2}:\d{2}(:\d{2})?$", ["T", "F", "TRUE", "FALSE"]
    each = rows.select("dataset_id", F.explode("cells").alias("_c", "_v")).filter("_v is not null")
    every = lambda test: F.bool_and(test)
    found = each.groupBy("dataset_id", "_c").agg(every(F.col("_v").isin(logical)).alias("l"), every(to_number(F.col("_v")).isNotNull()).alias("n"), every(F.col("_v").rlike(clock)).alias("t"))
    kind = F.when(F.col("l"), "l").when(F.col("n"), "n").when(F.col("t"), "t")
    kinds = found.select("dataset_id", "_c", kind.alias("_k")).filter("_k is not null").groupBy(F.col("dataset_id").alias("_d")).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_k"))).alias("_kinds"))
    rows = rows.join(kinds, F.col("dataset_id") == F.col("_d"), "left")

    def printed(c: Column, v: Column) -> Column:
        k = F.try_element_at("_kinds", c)
        full = F.when(F.size(F.split(v, ":")) == 2, F.concat(v, F.lit(":00"))).otherwise(v)
        return F.when(k == "l", F.when(v.isin(["T", "TRUE"]), "TRUE").when(v.isNotNull(), "FALSE")).when(k == "n", number_text(to_number(v))).when(k == "t", F.when(F.length(full) == 7, F.concat(F.lit("0"), full)).otherwise(full)).otherwise(v)

    return rows.select("dataset_id", "_row", F.transform_values("cells", printed).alias("cells"))


def cells_of(df: DataFrame, dataset_id: Column | str, row: str = "_row") -> DataFrame:
    """(dataset_id, _row, cells) of a frame whose other columns are cells, as text."""
    names = [c for c in df.columns if c != row and c != dataset_id]
    texts = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(f"`{c}`").cast("string") for c in names]))
    return df.select((F.col(dataset_id) if isinstance(dataset_id, str) else dataset_id).alias("dataset_id"), F.col(row).alias("_row"), texts.alias("cells"))


# --- rules of all programs

def _source(columns: list[str], text, terms: tuple[str, ...] = ()) -> tuple[str | None, str | None]:
    """(column, constant): a column of that name, unless the text is a term of a vocabulary."""
    text = rules.rule_text(text)
    return (text, None) if text is not None and text in columns and text not in terms else (None, text)


def specification(dataset_id: str, program: dict, columns: list[str], terms: tuple[str, ...]) -> tuple:
    """A program's row of the table of specifications."""
    about, contexts = program.get("dataset") or {}, program.get("contexts") or []
    is_long = str(about.get("data_is_long_format")).lower() in ("true", "yes")
    maps = [(k, m) for k, m in enumerate(m for m in single.trait_maps(program) if m.trait_name is not None)]
    if not is_long and (lost := [m.var_in for _, m in maps if m.var_in not in columns]):
        raise ValueError(f"{dataset_id}: mapped columns are not in the data: {lost}")
    own = {f for _, m in maps for f in m.overrides}
    over = lambda m: {f: _source(columns, v, terms) for f, v in {**m.overrides, **({} if m.unit_in is None else {"unit_in": m.unit_in})}.items()}
    listed = [(c, [(v.get("find"), v.get("value")) for v in c.get("values") or []]) for c in contexts]
    ruled = {c["var_in"] for c, values in listed if any(f is not None or v is not None for f, v in values)}
    texts: dict[str, str | None] = {}
    for c, values in listed:
        for find, value in values:
            find, value = rules.rule_text(find), rules.rule_text(value)
            if c["var_in"] in ruled and (find if find is not None else value) is not None:
                texts.setdefault(c["var_in"] + BETWEEN + (find if find is not None else value), value)
    present = [(c["category"], c["var_in"], c["context_property"], c["var_in"] in ruled) for c in contexts if c["var_in"] in columns or c["var_in"] in own]
    updates = program.get("taxonomic_updates") or []
    return (
        dataset_id, is_long, about.get("trait_name"), about.get("value"), {f: _source(columns, about.get(f)) for f in [*DATASET_FIELDS, "taxon_name"]},
        [(k, m.var_in, m.trait_name, over(m)) for k, m in maps], present, texts,
        [(i["var_in"], i["identifier_type"], i.get("institution_code")) for i in program.get("identifiers") or [] if i["var_in"] in columns],
        bool(updates) and all(u["find"] is not None for u in updates),
    )


def _rows(spark: SparkSession, rows: list, columns: str) -> DataFrame:
    return scratch.rule_table(spark, rows, ", ".join(f"{c} string" for c in columns.split()))


def substitution_rows(spark: SparkSession, programs: dict[str, dict]) -> DataFrame:
    """(_d, _t, _find, _to): what each dataset's sequence of substitutions makes of a text."""
    low = lambda x: None if x is None else rules.rule_text(x).lower()
    out = []
    for d, p in programs.items():
        subs = p.get("substitutions") or []
        for trait in dict.fromkeys(s["trait_name"] for s in subs):
            out += [(d, trait, k, v) for k, (v, _) in rules.compose([(low(s["find"]), low(s["replace"])) for s in subs if s["trait_name"] == trait]).items()]
    return _rows(spark, out, "_d _t _find _to")


def update_rows(spark: SparkSession, programs: dict[str, dict]) -> DataFrame:
    """(_d, _find, _to, _resolution): what each dataset's sequence of name changes makes of a name."""
    out = []
    for d, p in programs.items():
        updates = [(rules.rule_text(u["find"]), rules.rule_text(u["replace"]), u.get("taxonomic_resolution")) for u in p.get("taxonomic_updates") or []]
        if all(u[0] is not None for u in updates):
            out += [(d, k, name, updates[last][2]) for k, (name, last) in rules.compose([(f, r) for f, r, _ in updates]).items()]
    return _rows(spark, out, "_d _find _to _resolution")


def exclusion_rows(programs: dict[str, dict]) -> list[tuple[str, str, str]]:
    """(dataset_id, variable, text) of all exclusions."""
    return sorted({(d, v, text) for d, p in programs.items() for v, text in rules.exclusions([(e["variable"], e["find"], e.get("reason")) for e in p.get("exclude_observations") or []])})


def flag_excluded(df: DataFrame, programs: dict[str, dict]) -> DataFrame:
    """Adds ``_excluded``: whether a listed text stands in a row's value of a listed trait, or in another listed column.

    One join a variable, and one for all traits.
    """
    traits = {d: {m.trait_name for m in single.trait_maps(p)} for d, p in programs.items()}
    on_value, on_column = [], {}
    for d, variable, text in exclusion_rows(programs):
        if variable in traits[d]:
            on_value.append((d, variable, text))
        elif variable in df.columns:
            on_column.setdefault(variable, []).append((d, text))
    test = F.lit(False)
    if on_value:
        df = df.join(_rows(df.sparkSession, on_value, "_xd _xt _xv").withColumn("_x", F.lit(True)), (F.col("dataset_id") == F.col("_xd")) & (F.col("trait_name") == F.col("_xt")) & (F.col("value") == F.col("_xv")), "left").drop("_xd", "_xt", "_xv")
        test |= F.col("_x").isNotNull()
    for k, (variable, found) in enumerate(on_column.items()):
        df = df.join(_rows(df.sparkSession, found, f"_xd{k} _xv{k}").withColumn(f"_x{k}", F.lit(True)), (F.col("dataset_id") == F.col(f"_xd{k}")) & (F.col(variable) == F.col(f"_xv{k}")), "left").drop(f"_xd{k}", f"_xv{k}")
        test |= F.col(f"_x{k}").isNotNull()
    return df.withColumn("_excluded", test).drop("_x", *[f"_x{k}" for k in range(len(on_column))])


# --- the plan

def _taken(cells: Column, source: Column) -> Column:
    """The text that a source (column or constant) gives."""
    return F.when(source["column"].isNotNull(), F.try_element_at(cells, source["column"])).otherwise(source["text"])


def measurements(rows: DataFrame, specifications: DataFrame) -> DataFrame:
    """One row per row and trait map of its dataset: fields, value, contexts by category, identifiers; see ``build.process_dataset``."""
    spec = specifications.withColumnRenamed("dataset_id", "_d")
    fields = [*DATASET_FIELDS, "taxon_name"]
    df = rows.join(F.broadcast(spec), F.col("dataset_id") == F.col("_d"))
    df = df.select(
        "dataset_id", "_row", "cells", "is_long", "maps", "contexts", "context_rules", *[_taken(F.col("cells"), F.col("fields")[f]).alias(f) for f in fields],
        F.col("fields")["individual_id"]["column"].isNotNull().alias("_given"), F.try_element_at("cells", "trait_column").alias("_trait"), F.try_element_at("cells", "value_column").alias("_value"),
        F.transform("identifiers", lambda i: F.struct(i["identifier_type"].alias("identifier_type"), i["institution_code"].alias("institution_code"), F.try_element_at("cells", i["var_in"]).alias("identifier_value"))).alias("_identifiers"),
    )
    record = [F.regexp_replace("taxon_name", " ", "-"), F.col("location_name")]
    key = F.when(F.col("is_long"), F.when(F.col("_given"), paste([*record, F.col("individual_id")], "_")).otherwise(paste(record, "_")))
    key = key.when(F.col("_given"), F.coalesce(F.col("individual_id"), F.concat(F.lit("temp_"), F.col("_row").cast("string")))).otherwise(F.col("_row").cast("string"))
    df = ids.dense_id(df, key, "_parsed", ["dataset_id"], "_row", many=True).withColumn("parsing_id", F.concat_ws("_", "dataset_id", "_parsed"))
    mapped = F.when(F.col("is_long"), F.slice(F.filter("maps", lambda m: m["var_in"] == F.col("_trait")), 1, 1)).otherwise(F.col("maps"))
    df = df.withColumn("_map", F.explode(mapped)).withColumn("_over", F.col("_map")["over"])

    def context_text(var: Column) -> Column:
        over = F.try_element_at("_over", var)
        return F.when(over.isNotNull(), _taken(F.col("cells"), over)).otherwise(F.try_element_at("cells", var))

    def context_value(c: Column) -> Column:
        text = context_text(c["var_in"])
        return F.struct(c["context_property"].alias("context_property"), F.when(c["ruled"], F.try_element_at("context_rules", F.concat(c["var_in"], F.lit(BETWEEN), text))).otherwise(text).alias("value"))

    over = lambda f: F.when(F.col("_over")[f].isNotNull(), _taken(F.col("cells"), F.col("_over")[f])).otherwise(F.col(f))
    return df.select(
        "dataset_id", "_row", "parsing_id", "taxon_name", F.col("_map")["trait_index"].alias("trait_index"), F.col("_map")["trait_name"].alias("trait_name"), *[over(f).alias(f) for f in DATASET_FIELDS],
        F.lower(F.when(F.col("is_long"), F.col("_value")).otherwise(F.try_element_at("cells", F.col("_map")["var_in"]))).alias("value"),
        *[F.transform(F.filter("contexts", lambda c: c["category"] == k), context_value).alias(f"_{k}") for k in ctx.CATEGORIES],
        F.when(F.col("is_long"), F.col("_row")).otherwise(F.col("_map")["trait_index"].cast("long") * (1 << 40) + F.col("_row")).alias("_order"), "_identifiers",
    )


def add_contexts(long: DataFrame, programs: dict[str, dict], present: list[tuple[str, str, str, bool]]) -> tuple[DataFrame, DataFrame]:
    """Context ids of all categories, and the contexts table.  ``present`` is (dataset_id, category, property, ruled)."""
    spark, links, used = long.sparkSession, None, [c for c in ctx.CATEGORIES if any(own == c for _, own, _, _ in present)]
    long = written = scratch.keep(long)
    for category in ctx.CATEGORIES:
        if category not in used:
            long = long.withColumn(f"{category}_id", F.lit(None).cast("string"))
            continue
        pairs = F.col(f"_{category}")
        key = F.array_join(F.transform(pairs, lambda p: F.coalesce(p["value"], F.lit("NA"))), "_")
        long = ids.dense_id(long, key, f"{category}_id", ["dataset_id"], where=F.exists(pairs, lambda p: p["value"].isNotNull()), source=written)
    long = scratch.keep(long) if used else long
    for category in used:
        pairs = F.col(f"_{category}")
        own = ctx.linked(long.select("dataset_id", "_order", F.col(f"{category}_id").alias("id"), F.explode(pairs).alias("e")).select("dataset_id", "_order", "id", "e.*"), f"{category}_id", "_order")
        links = own if links is None else links.unionByName(own)
    long = long.drop(*[f"_{c}" for c in ctx.CATEGORIES])
    if links is None:
        return long, spark.createDataFrame([], ", ".join(f"{c} string" for c in TABLES["contexts"]))
    here = {d for d, _, _, _ in present}
    known = [(d, c["context_property"], c["category"], c["var_in"], *[rules.rule_text(v.get(k)) for k in ("find", "value", "description")], n * 1000 + k) for d in sorted(here) for n, c in enumerate(programs[d].get("contexts") or []) for k, v in enumerate(c.get("values") or [{}])]
    table = spark.createDataFrame(known, ctx.CONTEXT_COLUMNS)
    # contexts without values take those of the data
    free = spark.createDataFrame([(d, p, c) for d, c, p, ruled in present if not ruled], "dataset_id string, context_property string, category string")
    links = scratch.keep(links)
    found = links.join(free, ["dataset_id", "context_property"]).select("dataset_id", "context_property", "category", "value", F.lit(None).cast("string").alias("description"), F.lit(0).alias("rule"))
    return long, ctx.contexts_table(table.select("dataset_id", "context_property", "category", "value", "description", "rule").unionByName(found), links)


def update_names(long: DataFrame, updates: DataFrame, updated: DataFrame) -> DataFrame:
    """original_name, updated taxon_name and taxonomic_resolution; datasets without updates keep their names as they are."""
    out = long.withColumn("original_name", F.col("taxon_name")).join(updates, (F.col("dataset_id") == F.col("_d")) & (F.col("taxon_name") == F.col("_find")), "left").drop("_d")
    out = out.join(updated, F.col("dataset_id") == F.col("_d"), "left").drop("_d")
    name = F.when(F.col("_find").isNotNull(), F.col("_to")).when(F.col("_updated"), standardise_name(F.col("taxon_name"))).otherwise(F.col("taxon_name"))
    return out.withColumns({"taxon_name": name, "taxonomic_resolution": F.col("_resolution")}).drop("_find", "_to", "_resolution", "_updated")


def compile_datasets(
    spark: SparkSession, rows: DataFrame, columns: dict[str, list[str]], programs: dict[str, dict], definitions: dict, conversions: dict[str, rules.Conversion],
    schema: dict | None = None, taxa: DataFrame | None = None, filter_missing: bool = True,
) -> Database:
    """The tables of all datasets; ``rows`` is (dataset_id, _row, cells), ``columns`` are the names of each dataset's cells."""
    schema = schema or {}
    terms = single.vocabulary(schema)
    specs = [specification(d, p, columns.get(d, []), terms) for d, p in programs.items()]
    specifications = spark.createDataFrame(specs, SPECIFICATION)
    long = measurements(rows, specifications)
    long, contexts = add_contexts(long, programs, [(s[0], c, p, ruled) for s in specs for c, _, p, ruled in s[6]])

    subs = substitution_rows(spark, programs)
    long = long.join(subs, (F.col("dataset_id") == F.col("_d")) & (F.col("trait_name") == F.col("_t")) & (F.col("value") == F.col("_find")), "left")
    long = long.withColumn("value", F.when(F.col("_find").isNotNull(), F.col("_to")).otherwise(F.col("value"))).drop("_d", "_t", "_find", "_to")

    places = [(d, str(n), str(k), rules.rule_text(v)) for d, p in programs.items() for n, ps in (p.get("locations") or {}).items() for k, v in (ps or {}).items()]
    several = {d for d in programs if sum(p[0] == d for p in places) > 1}
    locations = ctx.locations_table(_rows(spark, [p for p in places if p[0] in several], "dataset_id location_name location_property value"))
    long = ctx.attach_locations(long, F.broadcast(locations))
    if over := [f for f in LOCATION_FIELDS if any(p[2] == f and p[0] in several for p in places)]:
        long = ctx.override_by_location(long, F.broadcast(locations), over)
        locations = locations.filter(~F.col("location_property").isin(over))

    long = long.withColumns({c: F.lit(None).cast("string") for c in TABLES["traits"] if c not in long.columns})
    long = flag_excluded(rules.with_dictionary(long, single.dictionary_frame(spark, definitions)), programs)
    long = long.withColumn("error", rules.value_error(F.col("_excluded"))).drop("_excluded")
    long = rules.convert_units(long, conversions).withColumn("error", rules.range_error(F.col("error")))
    # ids build on each other: each starts from written rows, so that none computes those before it again
    long = ids.population_ids(scratch.keep(long), "_order")
    long = ids.individual_ids(scratch.keep(long), "_order")
    long = ids.observation_ids(scratch.keep(long.withColumn("original_name", F.lit(None).cast("string"))))
    flagged = F.col("repeat_measurements_id").cast("string").isin("TRUE", "True", "true")
    long = ids.repeat_measurement_ids(long, flagged, "_order")
    updated = scratch.rule_table(spark, [(s[0], s[9]) for s in specs], "_d string, _updated boolean")
    long = update_names(long, update_rows(spark, programs), updated)
    long = long.withColumn("value", F.when(F.col("error").isNull(), separate_and_sort(F.col("value"))).otherwise(F.col("value")))
    long = long.withColumn("value_type", F.when(is_in(F.col("value_type"), VALUE_TYPES), F.col("value_type")))

    listed = spark.createDataFrame([(d, m.trait_name, m.methods, k) for d, p in programs.items() for k, m in enumerate(m for m in single.trait_maps(p) if m.trait_name is not None)], "dataset_id string, trait_name string, methods string, _row int")
    methods = ids.method_ids(listed)
    found = methods.select(*[F.col(c).alias(f"_{c}") for c in methods.columns])
    numbers = listed.join(found, (F.col("dataset_id") == F.col("_dataset_id")) & (F.col("trait_name") == F.col("_trait_name")) & F.col("methods").eqNullSafe(F.col("_methods")))
    numbers = numbers.select(F.col("dataset_id").alias("_d"), F.col("_row").alias("_k"), F.col("_method_id").alias("_method"))
    long = long.join(F.broadcast(numbers), (F.col("dataset_id") == F.col("_d")) & (F.col("trait_index") == F.col("_k")), "left").withColumn("method_id", F.col("_method")).drop("_d", "_k", "_method")
    long = scratch.keep(long)
    if filter_missing:
        long = long.filter(F.coalesce(F.col("error") != rules.MISSING_VALUE, F.lit(True)))

    order = [F.col("dataset_id"), F.col("observation_id").asc_nulls_last(), F.col("trait_name").asc_nulls_last(), value_type_order(), F.col("_order")]
    good, bad = long.filter("error is null"), long.filter("error is not null")
    traits = good
    if taxa is not None:
        taxa = taxa.withColumn("_list", F.monotonically_increasing_id()) if "_list" not in taxa.columns else taxa
        traits = taxonomy.accept_names(good, taxa)
    names = traits.select("taxon_name")
    updates = long.select("dataset_id", "original_name", F.col("taxon_name").alias("aligned_name"), "taxonomic_resolution").distinct()
    gone = [(d, text) for d, v, text in exclusion_rows(programs) if v == "taxon_name"]
    if gone:
        wrong = _rows(spark, gone, "dataset_id n").select("dataset_id", standardise_name(F.col("n")).alias("aligned_name")).distinct()
        updates = updates.join(wrong, ["dataset_id", "aligned_name"], "left_anti")
    updates = taxonomy.with_list(updates, taxa.drop("_list") if taxa is not None else None)
    people = [(d, *[p.get(k) for k in single.PEOPLE]) for d, program in programs.items() for p in (program.get("contributors") or {}).get("data_collectors") or [] if p.get("last_name")]
    found = long.select("dataset_id", "observation_id", F.explode("_identifiers").alias("e")).select("dataset_id", "observation_id", "e.*").filter("identifier_value is not null and observation_id is not null").distinct()
    described = [single.method_details(d, p) for d, p in programs.items()]
    details = _rows(spark, [tuple(None if v is None else str(v) for v in x.values()) for x in described], " ".join(described[0])) if described else None
    tables = {
        "traits": conform(traits.orderBy(*order), TABLES["traits"]),
        "locations": locations,
        "contexts": contexts,
        "methods": conform(methods.join(details, "dataset_id", "full") if details is not None else methods, TABLES["methods"]),
        "excluded_data": conform(bad, TABLES["excluded_data"]),
        "taxonomic_updates": conform(updates, TABLES["taxonomic_updates"]),
        "taxa": taxonomy.taxa_table(names, taxa, "_list").drop("_list") if taxa is not None else names.distinct(),
        "contributors": _rows(spark, people, " ".join(TABLES["contributors"])).distinct(),
        "identifiers": conform(found, TABLES["identifiers"]),
    }
    metadata = {d: {**p, "related_identifiers": [{"relation_type": "isCompiledBy", "resource_type": "software", "identifier": "fieldloom"}]} for d, p in programs.items()}
    return Database(tables, sources={d: p.get("source") or {} for d, p in programs.items()}, definitions=definitions, schema=schema, metadata=metadata)


def build_many(
    spark: SparkSession, folder: str, dataset_ids: list[str] | None, definitions: dict, conversions: dict, schema: dict | None = None, taxa: DataFrame | None = None,
    hooks: dict[str, Callable] | None = None, multi_line: bool = True,
) -> Database:
    """A compilation of the datasets of a folder, in one plan; those with custom steps are built apart and bound to the rest."""
    wanted = dataset_ids or prog.discover(folder)
    apart = [d for d in wanted if d in (hooks or {})]
    together = [d for d in wanted if d not in apart]
    out = []
    if together:
        programs = {d: prog.read_program(Path(folder, d, "metadata.yml")) for d in together}
        files = {d: str(Path(folder, d, "data.csv")) for d in together}
        headers = {d: read_header(p) for d, p in files.items()}
        rows = canonical_cells(read_cells(spark, files, headers, multi_line))
        out.append(compile_datasets(spark, rows, headers, programs, definitions, conversions, schema, taxa))
    if apart:
        out.append(single.build(spark, folder, apart, definitions, conversions, schema, taxa, hooks))
    return bind_databases(out)
