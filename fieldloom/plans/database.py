"""A harmonised database: its tables and their columns, joining several, flattening, and checks for pivoting."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tables and their columns, in order.
TABLES = {
    "traits": "dataset_id taxon_name observation_id trait_name value unit entity_type value_type basis_of_value replicates basis_of_record life_stage population_id individual_id repeat_measurements_id temporal_context_id source_id location_id entity_context_id plot_context_id treatment_context_id collection_date measurement_remarks method_id method_context_id original_name".split(),
    "locations": "dataset_id location_id location_name location_property value".split(),
    "contexts": "dataset_id context_property category value description link_id link_vals".split(),
    "methods": "dataset_id trait_name methods method_id description sampling_strategy source_primary_key source_primary_type source_primary_citation source_secondary_key source_secondary_citation source_original_dataset_key source_original_dataset_citation data_collectors assistants dataset_curators".split(),
    "taxonomic_updates": "dataset_id original_name aligned_name taxonomic_resolution taxon_name aligned_name_taxon_id aligned_name_taxonomic_status".split(),
    "taxa": "taxon_name taxonomic_dataset taxon_rank trinomial binomial genus family taxon_distribution establishment_means taxonomic_status taxon_id taxon_id_genus taxon_id_family scientific_name scientific_name_id".split(),
    "contributors": "dataset_id last_name given_name ORCID affiliation additional_role".split(),
    "identifiers": "dataset_id observation_id identifier_type institution_code identifier_value".split(),
}
TABLES["excluded_data"] = ["error", *TABLES["traits"]]
#: Value types in sort order; record and value bases.
VALUE_TYPES = "raw minimum mean median maximum mode range bin standard_error standard_deviation unknown".split()
#: What a value can be of, and how it and its record came about.
ENTITY_TYPES = "individual population metapopulation subspecies species subsection section subgenus genus subtribe tribe supertribe subfamily family superfamily infraorder suborder order superorder subclass class subphylum phylum subdivision division kingdom".split()
VALUE_BASES = "measurement expert_score model_derived unknown".split()
RECORD_BASES = "field field_experiment captive_cultivated lab preserved_specimen literature".split()
PIVOT_KEYS = "dataset_id taxon_name original_name observation_id value_type repeat_measurements_id method_id method_context_id".split()


class LaterTables(Mapping):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass(frozen=True)
class Database:
    tables: Mapping[str, DataFrame]
    sources: dict = field(default_factory=dict)
    definitions: dict = field(default_factory=dict)
    schema: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    build_info: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def with_version(self, version: str, git_sha: str | None) -> Database:
        return replace(self, build_info={**self.build_info, "version": version, "git_SHA": git_sha})


def value_type_order(column: str = "value_type"):
    """Sort key of value types; unknown words come last."""
    position = F.array_position(F.array(*[F.lit(v) for v in VALUE_TYPES]), F.col(column))
    return F.coalesce(F.nullif(position, F.lit(0)), F.lit(len(VALUE_TYPES) + 1))


def bind_frames(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bind_databases(databases: list[Database]) -> Database:
    """One database of several: rows of each table together, shared taxa and definitions once."""
    names = dict.fromkeys(n for d in databases for n in d.tables)
    tables = {n: bind_frames([d.tables[n] for d in databases if n in d.tables]) for n in names}
    for n in ("taxa", "contributors"):
        if n in tables:
            tables[n] = tables[n].distinct()
    join = lambda part: {k: v for d in databases for k, v in getattr(d, part).items()}
    return Database(tables, *(join(p) for p in ("sources", "definitions", "schema", "metadata", "build_info")))


def flatten_database(db: Database) -> DataFrame:
    """Measurements with the columns of their locations, contexts, methods and taxa beside them.

    Location properties become one text ``property='value'; ...`` per location, contexts likewise.
    """
    traits = db["traits"]
    pairs = lambda name, value: F.array_join(F.array_sort(F.collect_list(F.concat(F.col(name), F.lit("='"), F.coalesce(F.col(value), F.lit("")), F.lit("'")))), "; ")
    places = db["locations"].groupBy("dataset_id", "location_id", "location_name").agg(pairs("location_property", "value").alias("location_properties"))
    out = traits.join(places, ["dataset_id", "location_id"], "left")
    links = db["contexts"].withColumn("_id", F.explode(F.split("link_vals", ", ")))
    for link in ("plot_context_id", "treatment_context_id", "entity_context_id", "temporal_context_id", "method_context_id"):
        own = links.filter(F.col("link_id") == link).groupBy("dataset_id", F.col("_id").alias(link)).agg(pairs("context_property", "value").alias(link.replace("_id", "_properties")))
        out = out.join(own, ["dataset_id", link], "left")
    methods = db["methods"].drop("description") if "description" in traits.columns else db["methods"]
    out = out.join(methods, ["dataset_id", "trait_name", "method_id"], "left")
    return out.join(db["taxa"], "taxon_name", "left")


def pivot_duplicates(traits: DataFrame, keys: list[str] = PIVOT_KEYS) -> DataFrame:
    """Keys and traits that have more than one value, with their number."""
    return traits.groupBy(*dict.fromkeys([*keys, "trait_name"])).agg(F.count("*").alias("number_of_duplicates")).filter("number_of_duplicates > 1")


#: What tells values of a trait apart in a wide table.
WIDE_KEYS = "dataset_id observation_id value_type repeat_measurements_id method_id method_context_id".split()


def pivots_wider(traits: DataFrame, keys: list[str] = WIDE_KEYS) -> bool:
    """Whether each trait has one value at most for the keys of a row of a wide table."""
    return pivot_duplicates(traits, keys).isEmpty()


def find_taxon(traits: DataFrame, taxa: list[str], original_name: bool = False) -> DataFrame:
    """The datasets with each of some taxa: (taxon_name, dataset_id)."""
    name = "original_name" if original_name else "taxon_name"
    return traits.filter(F.col(name).isin(taxa)).select(F.col(name).alias("taxon_name"), "dataset_id").distinct()


def tree(title: str, terms: list[str], indent: str = "") -> list[str]:
    """A title and, below it, one branch for each term, as lines of text."""
    marks = ["├──"] * (len(terms) - 1) + ["└──"] * min(1, len(terms))
    return [f"{indent}{title}", *[f"{indent}{mark} {term}" for mark, term in zip(marks, terms)]]


def outline(db: Database) -> str:
    """The tables of a database and their columns, drawn as trees."""
    return "\n".join(line for name, table in db.tables.items() for line in tree(name, table.columns))
