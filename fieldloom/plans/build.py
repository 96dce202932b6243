"""Building a database: one dataset's program applied to its table, and compilations of many datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_in, separate_and_sort
from ..operators import contexts as ctx
from ..operators import ids, reshape, rules, taxonomy
from ..operators.reshape import TraitMap, column_or_constant, conform
from ..sources import program as prog
from ..sources import scratch
from .database import ENTITY_TYPES, RECORD_BASES, TABLES, VALUE_BASES, VALUE_TYPES, Database, LaterTables, bind_databases, value_type_order

#: Fields that a program may give for a whole dataset or for a trait.
DATASET_FIELDS = "entity_type value_type basis_of_value replicates basis_of_record life_stage source_id measurement_remarks collection_date individual_id location_name repeat_measurements_id unit_in".split()
#: Fields that a location may give for the measurements made there.
LOCATION_FIELDS = "basis_of_record life_stage collection_date measurement_remarks entity_type".split()
PEOPLE = ["last_name", "given_name", "ORCID", "affiliation", "additional_role"]


def dictionary_frame(spark: SparkSession, definitions: dict) -> DataFrame:
    """The trait dictionary as a table."""
    rows = []
    for name, d in definitions.items():
        levels = d.get("allowed_values_levels")
        number = lambda k: None if d.get(k) is None else float(d[k])  # noqa: B023, E731
        rows.append((name, d.get("type"), d.get("units"), number("allowed_values_min"), number("allowed_values_max"), [str(k) for k in levels] if levels else None))
    return scratch.rule_table(spark, rows, rules.DICTIONARY)


def trait_maps(program: dict) -> list[TraitMap]:
    fixed = {"var_in", "trait_name", "unit_in", "methods"}
    return [TraitMap(str(t["var_in"]), t.get("trait_name"), rules.rule_text(t.get("unit_in")), t.get("methods"), {k: rules.rule_text(v) for k, v in t.items() if k not in fixed and v is not None}) for t in program.get("traits") or []]


def vocabulary(schema: dict) -> tuple[str, ...]:
    """All terms of the controlled vocabularies, and of lists of values in a schema."""
    return tuple(dict.fromkeys([*ENTITY_TYPES, *VALUE_TYPES, *VALUE_BASES, *RECORD_BASES, *[v for s in schema.values() if isinstance(s, dict) for v in (s.get("values") or {})]]))


def gives(program: dict, field: str) -> bool:
    """Whether a program gives a field at all, for its dataset or for a trait."""
    return any(x.get(field) is not None for x in [program.get("dataset") or {}, *(program.get("traits") or [])])


@dataclass(frozen=True)
class Parsed:
    """A dataset's rows as they are before flags and units, one a measurement, and its contexts."""

    dataset_id: str
    program: dict
    long: DataFrame
    contexts: DataFrame
    maps: list[TraitMap]
    absent: tuple[str, ...] = ()  # fields that the program doesn't give, of which the rows have nulls only


@dataclass(frozen=True)
class Processed:
    """A dataset's harmonised rows with their errors and ids, written, and its locations; names are not looked up yet."""

    parsed: Parsed
    long: DataFrame
    methods: DataFrame
    locations: DataFrame
    filter_missing: bool = True


def parse_dataset(spark: SparkSession, dataset_id: str, data: DataFrame, program: dict, schema: dict | None = None) -> Parsed:
    """Fields by column or constant, one row per measurement, contexts, substitutions."""
    schema, about = schema or {}, program.get("dataset") or {}
    is_long = str(about.get("data_is_long_format")).lower() in ("true", "yes")
    maps = trait_maps(program)
    terms = vocabulary(schema)

    # parse: dataset-level fields by column or constant, then one row per measurement
    raw = data.columns
    context_rules = [(dataset_id, c["context_property"], c["category"], c["var_in"], *[rules.rule_text(v.get(k)) for k in ("find", "value", "description")], n * 1000 + k) for n, c in enumerate(program.get("contexts") or []) for k, v in enumerate(c.get("values") or [{}])]
    context_columns = list(dict.fromkeys(r[3] for r in context_rules))
    identifiers = program.get("identifiers") or []
    fields = {f: column_or_constant(raw, None if about.get(f) is None else str(about[f])) for f in DATASET_FIELDS}
    fields["taxon_name"] = column_or_constant(raw, about.get("taxon_name"))
    keep = {c: F.col(f"`{c}`") for c in [*context_columns, *[i["var_in"] for i in identifiers]] if c in raw}
    sources = {m.var_in for m in maps} | {v for m in maps for v in [*m.overrides.values(), m.unit_in]} | {about.get("trait_name"), about.get("value")}
    keep |= {c: F.col(f"`{c}`") for c in raw if c in sources and c not in fields}
    frame = data.select(F.lit(dataset_id).alias("dataset_id"), "_row", *[v.alias(k) for k, v in {**keep, **fields}.items()])
    frame = ids.parsing_ids(frame, "individual_id" if about.get("individual_id") in raw else None, is_long)
    own = ["dataset_id", "_row", "parsing_id", "taxon_name", *[f for f in DATASET_FIELDS if f != "unit_in"], *[c for c in keep if c in context_columns or c in {i["var_in"] for i in identifiers}]]
    if is_long:
        frame = frame.withColumn("value", F.col(f"`{about['value']}`"))
        long = reshape.map_long(frame, maps, about["trait_name"], terms).withColumn("_order", F.col("_row"))
    else:
        wide = frame.withColumns({m.var_in: F.col(f"`{m.var_in}`") for m in maps if m.var_in in raw and m.var_in not in frame.columns})
        long = reshape.wide_to_long(wide, maps, own, terms)
        long = long.withColumn("_order", F.col("trait_index").cast("long") * (1 << 40) + F.col("_row"))
    long = long.withColumn("value", F.lower("value"))

    # contexts on the long frame, which is written once: values are mapped, then the categories' ids are made, by small tables
    links, in_use, absent = None, {}, [f for f in DATASET_FIELDS if not gives(program, f)]
    table = spark.createDataFrame(context_rules, ctx.CONTEXT_COLUMNS)
    for category in ctx.CATEGORIES:
        properties = {c["var_in"]: c["context_property"] for c in program.get("contexts") or [] if c["category"] == category}
        properties = {v: p for v, p in properties.items() if v in long.columns}
        if properties:
            in_use[category] = properties
        else:
            long = long.withColumn(f"{category}_id", F.lit(None).cast("string"))
            absent.append(f"{category}_id")
    long = scratch.keep(long, absent) if in_use else long
    written = long
    for category, properties in in_use.items():
        for v in properties:  # a context without values takes those of the data
            if not any(r[3] == v and (r[4] is not None or r[5] is not None) for r in context_rules):
                found = ctx.values_from_data(written, v, "_order")
                table = table.filter(F.col("var_in") != v).unionByName(found.select(F.lit(dataset_id).alias("dataset_id"), F.lit(properties[v]).alias("context_property"), F.lit(category).alias("category"), F.lit(v).alias("var_in"), F.col("value").alias("find"), "value", F.lit(None).cast("string").alias("description"), F.lit(0).alias("rule")))
    if in_use:
        table = scratch.keep(table)
        for properties in in_use.values():
            long = ctx.map_contexts(long, table, list(properties))
        written = long
        for category, properties in in_use.items():
            long = ctx.context_ids(long, category, [f"{v}_mapped" for v in properties], written)
        for category, properties in in_use.items():
            own_links = ctx.context_links(long, category, {f"{v}_mapped": p for v, p in properties.items()}, "_order")
            links = own_links if links is None else links.unionByName(own_links)
    contexts = ctx.contexts_table(table, links) if links is not None else spark.createDataFrame([], ", ".join(f"{c} string" for c in TABLES["contexts"]))

    long = rules.substitute(long, [(s["trait_name"], s["find"], s["replace"]) for s in program.get("substitutions") or []])

    return Parsed(dataset_id, program, long, contexts, maps, tuple(absent))


class ProcessedLater:
    """The same as ``Processed``, but the rows are harmonised only when they are asked for."""

    def __init__(self, parsed: Parsed, definitions: dict, conversions: dict[str, rules.Conversion], filter_missing: bool) -> None:
        self.parsed, self.filter_missing, self._rest = parsed, filter_missing, (definitions, conversions)
        self.methods, self.locations = program_methods(parsed.long.sparkSession, parsed), program_locations(parsed.long.sparkSession, parsed)

    @cached_property
    def long(self) -> DataFrame:
        return process_parsed(self.parsed, *self._rest, self.filter_missing).long


PLACES = "dataset_id string, location_name string, location_property string, value string"


def listed_places(dataset_id: str, program: dict) -> list[tuple]:
    """(dataset_id, location, property, value) of a program that describes more than one property."""
    places = [(dataset_id, str(n), str(p), None if v is None else str(v)) for n, ps in (program.get("locations") or {}).items() for p, v in (ps or {}).items()]
    return places if len(places) > 1 else []


def program_locations(spark: SparkSession, parsed: Parsed) -> DataFrame:
    """The locations table; properties that replace fields of the measurements are not in it."""
    locations = ctx.locations_table(spark.createDataFrame(listed_places(parsed.dataset_id, parsed.program), PLACES))
    return locations.filter(~F.col("location_property").isin(LOCATION_FIELDS))


def program_methods(spark: SparkSession, parsed: Parsed) -> DataFrame:
    listed = [(parsed.dataset_id, m.trait_name, m.methods, k) for k, m in enumerate(parsed.maps) if m.trait_name]
    return ids.method_ids(spark.createDataFrame(listed, "dataset_id string, trait_name string, methods string, _row int"))


def process_parsed(parsed: Parsed, definitions: dict, conversions: dict[str, rules.Conversion], filter_missing: bool = True) -> Processed:
    """Locations, flags, units, ids, name updates."""
    dataset_id, program, long, maps = parsed.dataset_id, parsed.program, parsed.long, parsed.maps
    spark, mapped = long.sparkSession, {m.trait_name for m in maps}
    dictionary = dictionary_frame(spark, {k: v for k, v in definitions.items() if k in mapped})

    # locations
    absent = {*parsed.absent, "location_id"}
    places = listed_places(dataset_id, program)
    locations = ctx.locations_table(spark.createDataFrame(places, PLACES))
    if places:
        long = ctx.attach_locations(long, F.broadcast(locations))
        absent.discard("location_id")
        over = [f for f in LOCATION_FIELDS if any(p == f for _, _, p, _ in places)]
        if over:
            long = ctx.override_by_location(long, F.broadcast(locations), over)
            absent -= set(over)
    else:
        long = long.withColumn("location_id", F.lit(None).cast("string"))

    # flags, units, ids, names
    absent |= {c for c in TABLES["traits"] if c not in long.columns} - {"unit"}
    long = long.withColumns({c: F.lit(None).cast("string") for c in TABLES["traits"] if c not in long.columns})
    long = rules.with_dictionary(long, dictionary)
    excluded = [(e["variable"], e["find"], e.get("reason")) for e in program.get("exclude_observations") or []]
    long = long.withColumn("error", rules.value_error(rules.flag_excluded(long, excluded, mapped)))
    long = rules.convert_units(long, conversions).withColumn("error", rules.range_error(F.col("error")))
    # what is needed from here on: rows are written and shuffled several times
    needed = {*TABLES["traits"], "location_name", "_row", "_order", "trait_index", "parsing_id", "error", "methods", *[i["var_in"] for i in program.get("identifiers") or []]}
    long = long.drop(*[c for c in long.columns if c not in needed])
    # ids build on each other: each starts from written rows, so that none computes those before it again
    long = ids.population_ids(scratch.keep(long, absent), "_order")
    long = ids.individual_ids(scratch.keep(long, absent - {"population_id"}), "_order")
    absent -= {"population_id", "individual_id"}
    written = scratch.keep(long.withColumn("original_name", F.lit(None).cast("string")), absent | {"original_name"})
    long = ids.observation_ids(written)
    if gives(program, "repeat_measurements_id"):
        flagged = F.col("repeat_measurements_id").cast("string").isin("TRUE", "True", "true")
        long = ids.repeat_measurement_ids(long, flagged, "_order")
    updates = [(rules.rule_text(u["find"]), rules.rule_text(u["replace"]), u.get("taxonomic_resolution")) for u in program.get("taxonomic_updates") or []]
    long = taxonomy.update_names(long, updates, written)
    long = long.withColumn("value", F.when(F.col("error").isNull(), separate_and_sort(F.col("value"))).otherwise(F.col("value")))
    long = long.withColumn("value_type", F.when(is_in(F.col("value_type"), VALUE_TYPES), F.col("value_type")))

    methods = program_methods(spark, parsed)
    renamed = methods.select(*[F.col(c).alias(f"_m_{c}") for c in methods.columns])
    long = long.drop("method_id").join(F.broadcast(renamed), (F.col("trait_name") == F.col("_m_trait_name")) & F.col("methods").eqNullSafe(F.col("_m_methods")), "left").withColumn("method_id", F.col("_m_method_id"))
    # all tables below fan out from these rows: written once, so that a compilation holds none in memory
    long = scratch.keep(long.drop(*[c for c in long.columns if c.startswith("_m_")]), absent - {"observation_id", "method_id", "original_name"})
    return Processed(parsed, long, methods, program_locations(spark, parsed), filter_missing)


def finish_dataset(processed: Processed | ProcessedLater, definitions: dict, schema: dict | None = None, taxa: DataFrame | None = None) -> Database:
    """Accepted names and the tables of a dataset; of rows that are processed later, tables that ask for them are made later."""
    methods, locations = processed.methods, processed.locations
    dataset_id, program, contexts = processed.parsed.dataset_id, processed.parsed.program, processed.parsed.contexts
    spark, schema, identifiers = locations.sparkSession, schema or {}, program.get("identifiers") or []
    excluded = [(e["variable"], e["find"], e.get("reason")) for e in program.get("exclude_observations") or []]
    if taxa is not None and "_list" not in taxa.columns:
        taxa = taxa.withColumn("_list", F.monotonically_increasing_id())

    def rows() -> DataFrame:
        missing = F.coalesce(F.col("error") != rules.MISSING_VALUE, F.lit(True))
        return processed.long.filter(missing) if processed.filter_missing else processed.long

    def good() -> DataFrame:
        found = rows().filter("error is null")
        return found if taxa is None else taxonomy.accept_names(found, taxa)

    order = [F.col("observation_id").asc_nulls_last(), F.col("trait_name").asc_nulls_last(), value_type_order(), F.col("_order")]
    people = [{**p} for p in (program.get("contributors") or {}).get("data_collectors") or [] if p.get("last_name")]
    named = [tuple([dataset_id, *[p.get(k) for k in PEOPLE]]) for p in people]
    gone = [t for v, t in rules.exclusions(excluded) if v == "taxon_name"]
    makers = {
        "traits": lambda: conform(good().orderBy(*order), TABLES["traits"]),
        "locations": lambda: locations,
        "contexts": lambda: contexts,
        "methods": lambda: methods_table(spark, methods, program, dataset_id),
        "excluded_data": lambda: conform(rows().filter("error is not null"), TABLES["excluded_data"]),
        "taxonomic_updates": lambda: conform(taxonomy.taxonomic_updates_table(rows(), taxa.drop("_list") if taxa is not None else None, gone), TABLES["taxonomic_updates"]),
        "taxa": lambda: taxonomy.taxa_table(good().select("taxon_name"), taxa, "_list").drop("_list") if taxa is not None else good().select("taxon_name").distinct(),
        "contributors": lambda: spark.createDataFrame(named, ", ".join(f"{c} string" for c in TABLES["contributors"])),
        "identifiers": lambda: identifier_rows(rows(), identifiers),
    }
    tables = LaterTables(makers) if isinstance(processed, ProcessedLater) else {n: make() for n, make in makers.items()}
    metadata = {dataset_id: {**program, "related_identifiers": [{"relation_type": "isCompiledBy", "resource_type": "software", "identifier": "fieldloom"}]}}
    return Database(tables, sources={dataset_id: program.get("source") or {}}, definitions=definitions, schema=schema, metadata=metadata)


def process_dataset(
    spark: SparkSession, dataset_id: str, data: DataFrame, program: dict, definitions: dict, conversions: dict[str, rules.Conversion],
    schema: dict | None = None, taxa: DataFrame | None = None, hook: Callable[[DataFrame], DataFrame] | None = None, filter_missing: bool = True,
) -> Database:
    """One dataset's tables.  ``data`` has text columns and ``_row``; ``hook`` is its custom step.

    Measurements are harmonised when a table of them is asked for; contexts, methods, locations and people need none of it.
    """
    parsed = parse_dataset(spark, dataset_id, hook(data) if hook else data, program, schema)
    return finish_dataset(ProcessedLater(parsed, definitions, conversions, filter_missing), definitions, schema, taxa)


def identifier_rows(long: DataFrame, identifiers: list[dict]) -> DataFrame:
    """Identifiers of observations: different rows with a value and an observation."""
    known = [i for i in identifiers if i["var_in"] in long.columns]
    if not known:
        return long.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in TABLES["identifiers"]))
    each = F.explode(F.array(*[F.struct(F.lit(i["identifier_type"]).alias("identifier_type"), F.lit(i.get("institution_code")).cast("string").alias("institution_code"), F.col(f"`{i['var_in']}`").cast("string").alias("identifier_value")) for i in known]))
    rows = long.select("dataset_id", "observation_id", each.alias("e")).select("dataset_id", "observation_id", "e.*")
    return rows.filter("identifier_value is not null and observation_id is not null").distinct()


def method_details(dataset_id: str, program: dict) -> dict:
    """What a program says of all methods of its dataset: description, sampling, sources, people."""
    about, source, people = (program.get(k) or {} for k in ("dataset", "source", "contributors"))
    of = lambda kind: [s for k, s in source.items() if k.startswith(kind)]
    text = lambda xs, f, between="; ": between.join(f(x) for x in xs) or None
    described = {"dataset_id": dataset_id, "description": about.get("description"), "sampling_strategy": about.get("sampling_strategy")}
    cited = {"source_primary_key": text(of("primary"), lambda s: s["key"]), "source_primary_type": text(of("primary"), lambda s: s["bibtype"]), "source_primary_citation": prog.citations(of("primary")), "source_secondary_key": text(of("secondary"), lambda s: s["key"]), "source_secondary_citation": prog.citations(of("secondary")), "source_original_dataset_key": text(of("original"), lambda s: s["key"]), "source_original_dataset_citation": prog.citations(of("original"))}
    named = lambda p: f"{p.get('given_name')} {p['last_name']}" + (f" ({p['additional_role']})" if p.get("additional_role") else "")
    return {**described, **cited, "data_collectors": text([p for p in people.get("data_collectors") or [] if p.get("last_name")], named, ", "), "assistants": people.get("assistants"), "dataset_curators": people.get("dataset_curators")}


def methods_table(spark: SparkSession, methods: DataFrame, program: dict, dataset_id: str) -> DataFrame:
    """Each trait's methods beside the dataset's descriptions, sources and people (a full join on dataset_id)."""
    details = method_details(dataset_id, program)
    one = spark.createDataFrame([tuple(None if v is None else str(v) for v in details.values())], ", ".join(f"{k} string" for k in details))
    return conform(methods.join(one, "dataset_id", "full"), TABLES["methods"])


def build(spark: SparkSession, folder: str, dataset_ids: list[str] | None, definitions: dict, conversions: dict, schema: dict | None = None, taxa: DataFrame | None = None, hooks: dict[str, Callable] | None = None) -> Database:
    """A compilation of every dataset of a folder that has both its files, each built apart; see ``compilation.build_many`` for many."""
    from ..sources.tables import canonical_text, read_csv_text

    out = []
    for dataset_id in dataset_ids or prog.discover(folder):
        path = Path(folder, dataset_id)
        data = canonical_text(read_csv_text(spark, str(path / "data.csv")))
        out.append(process_dataset(spark, dataset_id, data, prog.read_program(path / "metadata.yml"), definitions, conversions, schema, taxa, (hooks or {}).get(dataset_id)))
    return bind_databases(out)
