"""Validation: rules over a folder, a program, its data and what is built from them give findings; none stops the others.

``check_program`` lists all rules with a few of the failing values each; ``failures`` gives all failing values as a
DataFrame; ``check_folder`` and ``check_build`` cover the files and the built tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXCEPTION_LETTERS, unsupported_bytes
from ..operators.rules import exclusions
from ..sources import scratch
from ..sources.program import DATASET_FIELDS, SECTIONS, read_program
from ..sources.tables import corrupt_rows
from .database import ENTITY_TYPES, RECORD_BASES, TABLES, VALUE_BASES, VALUE_TYPES, Database, pivot_duplicates
from .hooks import apply_steps

#: Required and allowed fields of program sections.
TRAIT_REQUIRED = ["var_in", "unit_in", "trait_name", "value_type", "basis_of_value"]
SOURCE_REQUIRED = ["key", "bibtype", "author", "title", "year"]
CONTRIBUTOR_FIELDS = ["last_name", "given_name", "ORCID", "affiliation", "notes", "additional_role"]
CATEGORIES = ["plot_context", "treatment_context", "entity_context", "temporal_context", "method_context"]
#: Vocabularies that a program or a column of its data draws on; ``unknown`` is always allowed.
VOCABULARIES = {"entity_type": ENTITY_TYPES, "value_type": VALUE_TYPES, "basis_of_value": VALUE_BASES, "basis_of_record": RECORD_BASES}
#: What a dataset's folder may hold.
FOLDER = ["data.csv", "metadata.yml", "raw", "output", "README.md"]
FIELDS = {"substitutions": ["trait_name", "find", "replace"], "taxonomic_updates": ["find", "replace", "reason", "taxonomic_resolution"], "exclude_observations": ["variable", "find", "reason"], "identifiers": ["var_in", "identifier_type", "institution_code"]}


def not_members(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """The different tokens-as-whole texts of a column that aren't allowed."""
    return df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull() & ~F.col("value").isin(allowed)).distinct()


def repeated(df: DataFrame, column: str) -> DataFrame:
    """Texts that a column has more than once, with their number."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def findings(df: DataFrame, rules: dict[str, tuple[str, str, list | None]]) -> DataFrame:
    """Failures of rules (member, present or unique, of a column): (rule, failures)."""
    out = []
    for rule, (kind, column, allowed) in rules.items():
        bad = {"member": lambda: not_members(df, column, allowed), "present": lambda: df.filter(F.col(column).isNull()), "unique": lambda: repeated(df, column)}[kind]()  # noqa: B023
        out.append(bad.agg(F.count("*").alias("failures")).select(F.lit(rule).alias("rule"), "failures"))
    return reduce(DataFrame.unionByName, out)


#: Failing values of a rule that a listing shows.
SHOWN = 20


def vocabularies(schema: dict | None = None) -> dict[str, set[str]]:
    """Terms of each vocabulary field, those of a schema in their place, and ``unknown``."""
    own = {f: set((((schema or {}).get(f) or {}).get("values")) or terms) for f, terms in VOCABULARIES.items()}
    return {f: terms | {"unknown"} for f, terms in own.items()}


def check_program(program: dict, columns: list[str], dictionary: dict, data: DataFrame | None = None, schema: dict | None = None) -> list[tuple[str, bool, str]]:
    """(rule, ok, detail) of all rules on a program and, if given, its data (text columns)."""
    out = [(name, not wrong, ", ".join(wrong[:SHOWN])) for name, wrong in _program_rules(program, columns, dictionary, schema)]
    for name, wrong in _data_rules(program, data, schema) if data is not None else []:
        some = sorted(r.value for r in wrong.limit(SHOWN).collect())
        out.append((name, not some, ", ".join(some)))
    return out


def failures(program: dict, data: DataFrame, dictionary: dict, schema: dict | None = None) -> DataFrame:
    """All failing values of all rules on a program and its data: (rule, value)."""
    columns = [c for c in data.columns if c != "_row"]
    known = [(name, w) for name, wrong in _program_rules(program, columns, dictionary, schema) for w in wrong]
    out = data.sparkSession.createDataFrame(known, "rule string, value string")
    return reduce(DataFrame.unionByName, [wrong.select(F.lit(name).alias("rule"), "value") for name, wrong in _data_rules(program, data, schema)], out)


def check_folder(folder: str | Path, spark: SparkSession | None = None, multi_line: bool = True) -> list[tuple[str, bool, str]]:
    """(rule, ok, detail) of the rules on a dataset's files.  The data is scanned by Spark, see ``corrupt_rows``."""
    folder = Path(folder)
    here = sorted(p.name for p in folder.iterdir()) if folder.exists() else []
    out = [("folder: both files", [f for f in FOLDER[:2] if f not in here]), ("folder: nothing else", [f for f in here if f not in FOLDER])]
    if "metadata.yml" in here:
        text = (folder / "metadata.yml").read_text(encoding="utf-8")
        allowed = {b for b in EXCEPTION_LETTERS.encode() if b >= 0x7F}
        out.append(("metadata: plain text", [f"line {n + 1}" for n, line in enumerate(text.split("\n")) if any(b >= 0x7F and b not in allowed for b in line.encode())]))
        try:
            about = list((read_program(folder / "metadata.yml").get("dataset") or {}))
            at = about.index("custom_R_code") if "custom_R_code" in about else None
            out += [("metadata: parses", []), ("dataset: custom step before collection_date", [] if at is None or about[at + 1 : at + 2] == ["collection_date"] else about[at + 1 : at + 2] or ["nothing"])]
        except yaml.YAMLError as error:
            out.append(("metadata: parses", [str(error).split("\n")[0]]))
    if "data.csv" in here:
        wrong = corrupt_rows(spark or SparkSession.active(), str(folder / "data.csv"), multi_line).orderBy("file", "row").limit(SHOWN).collect()
        out.append(("data: rows are as long as the header", [f"row {r.row}" for r in wrong]))
    return [(name, not wrong, ", ".join(map(str, wrong[:SHOWN]))) for name, wrong in out]


def check_custom_step(data: DataFrame, steps: list[dict] | Callable[[DataFrame], DataFrame]) -> tuple[str, bool, str]:
    """A dry run of a dataset's custom step on its data."""
    try:
        (steps(data) if callable(steps) else apply_steps(data, steps)).limit(1).collect()
    except Exception as error:  # whatever a step raises is the finding
        return ("custom step: runs", False, str(error).split("\n")[0][:200])
    return ("custom step: runs", True, "")


def check_build(build: Callable[[], Database]) -> list[tuple[str, bool, str]]:
    """(rule, ok, detail) of the rules on what a dataset builds to; ``build`` makes it."""
    try:
        db = build()
        traits = db["traits"]
        empty = traits.isEmpty()
    except Exception as error:  # whatever building raises is the finding
        return [("build: works", False, str(error).split("\n")[0][:200])]
    shape = [n for n in TABLES if n not in db.tables or n != "taxa" and db[n].columns != TABLES[n]]
    strange = sorted(r.value for r in traits.filter(F.size(unsupported_bytes(F.col("value"), "")) > 0).select("value").distinct().limit(SHOWN).collect())
    twice = [f"{r.observation_id} {r.trait_name}" for r in pivot_duplicates(traits).orderBy("observation_id", "trait_name").limit(SHOWN).collect()]
    found = [("build: works", []), ("build: tables and columns", shape), ("build: traits not empty", ["traits"] if empty else []), ("build: values are plain text", strange), ("build: pivots without duplicates", twice)]
    return [(name, not wrong, ", ".join(wrong)) for name, wrong in found]


#: Stages of a build, in order.
STAGES = ["configure", "parse", "process", "taxonomy"]


def check_stages(
    dataset_id: str, data: DataFrame, program: dict, definitions: dict, conversions: dict, schema: dict | None = None, taxa: DataFrame | None = None, hook: Callable[[DataFrame], DataFrame] | None = None,
) -> list[tuple[str, bool, str]]:
    """(rule, ok, detail) of a build that is run stage by stage: one finding a stage, and those on what it gave.

    A stage that fails leaves the later ones undone, which their findings say.
    """
    from . import build

    spark, out, failed = data.sparkSession, [], None

    def stage(name: str, work: Callable):
        nonlocal failed
        if failed:
            out.append((f"build: {name} runs", False, f"not run, as {failed} failed"))
            return None
        try:
            done = work()
        except Exception as error:  # whatever a stage raises is its finding
            failed = name
            out.append((f"build: {name} runs", False, str(error).split("\n")[0][:200]))
            return None
        out.append((f"build: {name} runs", True, ""))
        return done

    def configure() -> DataFrame:
        used = {m.trait_name for m in build.trait_maps(program)}
        build.dictionary_frame(spark, {k: v for k, v in definitions.items() if k in used}).count()
        return hook(data) if hook else data

    def parse(frame: DataFrame) -> build.Parsed:
        done = build.parse_dataset(spark, dataset_id, frame, program, schema)
        return replace(done, long=scratch.keep(done.long))

    frame = stage("configure", configure)
    parsed = stage("parse", lambda: parse(frame))
    processed = stage("process", lambda: build.process_parsed(parsed, definitions, conversions))
    built = stage("taxonomy", lambda: (db := build.finish_dataset(processed, definitions, schema, taxa), db["traits"].isEmpty())[0])
    if parsed:
        for name, wrong in (("parsed: values are plain text", parsed_text(parsed.long)), ("parsed: exclusions are in the data", parsed_exclusions(parsed.long, program))):
            some = [" ".join(x for x in r if x) for r in wrong.limit(SHOWN).collect()]
            out.append((name, not some, ", ".join(sorted(some))))
    return out + (check_build(lambda: built)[1:] if built else [])


def parsed_text(long: DataFrame) -> DataFrame:
    """(trait_name, value): different values of parsed rows that aren't ASCII."""
    return long.filter(F.size(unsupported_bytes(F.col("value"), "")) > 0).select("trait_name", "value").distinct()


def parsed_exclusions(long: DataFrame, program: dict) -> DataFrame:
    """(variable, value): texts that a program excludes but parsed rows lack, in a trait's values or another column."""
    spark, traits = long.sparkSession, {t.get("trait_name") for t in program.get("traits") or []}
    listed = exclusions([(e["variable"], e["find"], e.get("reason")) for e in program.get("exclude_observations") or []])
    wanted = spark.createDataFrame([(v, x) for v, x in dict.fromkeys(listed)], "variable string, value string")
    columns = sorted({v for v, _ in listed} - traits)
    # a value of a trait, or the text of a listed column, each once
    have = [long.filter(F.col("trait_name").isin([v for v, _ in listed])).select(F.col("trait_name").alias("variable"), "value").distinct()]
    have += [long.select(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")).distinct() for c in columns if c in long.columns]
    return wanted.join(reduce(DataFrame.unionByName, have), ["variable", "value"], "left_anti").select("variable", "value")


def _program_rules(program: dict, columns: list[str], dictionary: dict, schema: dict | None) -> list[tuple[str, list[str]]]:
    """The rules that need no data, with all values that fail."""
    out: list[tuple[str, list[str]]] = []

    def rule(name: str, wrong) -> None:
        out.append((name, [str(w) for w in wrong]))

    records = lambda s: program.get(s) or []
    twice = lambda xs: [x for x, n in Counter(xs).items() if n > 1]
    rule("columns: named, plain text, unique", [c for c in columns if not c or re.search(r"[^\x00-\x7E]", c)] + twice(columns))
    rule("sections: known", set(program) - set(SECTIONS))
    rule("sections: complete", [s for s in SECTIONS if s not in program and s != "identifiers"])
    source = program.get("source") or {}
    rule("source: has a primary", [] if "primary" in source else ["primary"])
    rule("source: kinds", [k for k in source if not re.match(r"^(primary|secondary|original)(_\d+)?$", k)])
    rule("source: fields", [f"{k}.{f}" for k, s in source.items() for f in SOURCE_REQUIRED if f not in s])
    rule("source: keys unique", twice(s.get("key") for s in source.values()))
    people = (program.get("contributors") or {}).get("data_collectors") or []
    rule("contributors: fields", {f for p in people for f in p} - set(CONTRIBUTOR_FIELDS))
    rule("contributors: curators", [] if (program.get("contributors") or {}).get("dataset_curators") else ["dataset_curators"])
    about = program.get("dataset") or {}
    is_long = str(about.get("data_is_long_format")).lower() in ("true", "yes")
    rule("dataset: layout is logical", [] if isinstance(about.get("data_is_long_format"), bool) else [about.get("data_is_long_format")])
    for section, fields in FIELDS.items():
        rule(f"{section}: fields", {f for r in records(section) for f in set(r) ^ set(fields)})
    places = program.get("locations") or {}
    full = lambda p: {"latitude (deg)", "longitude (deg)"} <= set(p or {}) or {"latitude range (deg)", "longitude range (deg)"} <= set(p or {})
    rule("locations: coordinates or ranges", [n for n, p in places.items() if not full(p)])
    rule("locations: name is a column", [about.get("location_name")] if places and about.get("location_name") not in columns else [])
    contexts = program.get("contexts") or []
    rule("contexts: categories", [c["category"] for c in contexts if c.get("category") not in CATEGORIES])
    rule("contexts: properties unique", twice(c["context_property"] for c in contexts))
    rule("contexts: var_in unique", twice(c["var_in"] for c in contexts))
    traits = records("traits")
    own = {k for t in traits for k in t}
    rule("contexts: var_in is a column or trait field", [c["var_in"] for c in contexts if c["var_in"] not in columns and c["var_in"] not in own])
    values = [(c["context_property"], v) for c in contexts for v in c.get("values") or []]
    rule("contexts: find unique", twice((p, v.get("find")) for p, v in values if v.get("find") is not None))
    rule("contexts: one description each", [k for k, n in Counter(p for p, _ in {((p, v.get("value")), v.get("description")) for p, v in values}).items() if n > 1])
    rule("contexts: find needs a value", [p for p, v in values if v.get("find") is not None and "value" not in v])
    rule("contexts: description needs a value", [p for p, v in values if v.get("description") and v.get("value") is None])
    rule("traits: fields", [f"{t.get('var_in')}.{f}" for t in traits for f in TRAIT_REQUIRED if f not in t])
    rule("traits: in dictionary", [t["trait_name"] for t in traits if t.get("trait_name") and t["trait_name"] not in dictionary])
    rule("traits: var_in unique", twice(t.get("var_in") for t in traits))
    rule("traits: some named", [] if any(t.get("trait_name") for t in traits) else ["trait_name"])
    rule("traits: value types", [t["value_type"] for t in traits if t.get("value_type") and t["value_type"] not in vocabularies(schema)["value_type"] and t["value_type"] not in columns])
    for field, terms in vocabularies(schema).items():
        if field != "value_type":
            rule(f"traits: {field} in vocabulary", [t[field] for t in traits if t.get(field) and t[field] not in terms and t[field] not in columns])
        whole = about.get(field)
        rule(f"dataset: {field} in vocabulary", [w for w in str(whole).split(" ") if w not in terms] if whole is not None and whole not in columns else [])
    rule("dataset: fields", [f for f in about if f not in ((((schema or {}).get("metadata") or {}).get("elements") or {}).get("dataset") or {}).get("values", DATASET_FIELDS)])
    if not is_long:
        rule("traits: var_in is a column", [t["var_in"] for t in traits if t.get("trait_name") and t["var_in"] not in columns])
    mapped = {t.get("trait_name") for t in traits}
    subs = records("substitutions")
    rule("substitutions: trait mapped", [s["trait_name"] for s in subs if s["trait_name"] not in mapped])
    rule("substitutions: find unique", twice((s["trait_name"], s["find"]) for s in subs))
    levels = lambda t: set((dictionary.get(t) or {}).get("allowed_values_levels") or {})
    rule("substitutions: replacement allowed", [s["replace"] for s in subs if s["replace"] is not None and levels(s["trait_name"]) and not set(str(s["replace"]).split(" ")) <= levels(s["trait_name"]) and not re.fullmatch("[YyNn]{12}", str(s["replace"]))])
    rule("taxonomic_updates: find unique", twice(u["find"] for u in records("taxonomic_updates")))
    gone = [(e["variable"], e["find"], e.get("reason")) for e in records("exclude_observations")]
    rule("exclude_observations: unique", twice((v, f) for v, f, _ in gone))
    return out


def _data_rules(program: dict, data: DataFrame, schema: dict | None) -> list[tuple[str, DataFrame]]:
    """Rules that compare small lists of a program with the different texts of data columns (as anti joins)."""
    spark, out = data.sparkSession, []
    about, places, contexts, traits = program.get("dataset") or {}, program.get("locations") or {}, program.get("contexts") or [], program.get("traits") or []
    gone = [(e["variable"], e["find"], e.get("reason")) for e in program.get("exclude_observations") or []]
    is_long = str(about.get("data_is_long_format")).lower() in ("true", "yes")

    def rule(name: str, wrong: DataFrame) -> None:
        out.append((name, wrong))

    def listed(values) -> DataFrame:
        return spark.createDataFrame([(str(v),) for v in dict.fromkeys(values)], "value string")

    def texts(column: str) -> DataFrame:
        return data.select(F.col(f"`{column}`").cast("string").alias("value")).filter("value is not null").distinct()

    def tokens(column: str) -> DataFrame:
        return texts(column).select(F.explode(F.split("value", " ")).alias("value")).distinct()

    name = about.get("location_name")
    if places and name in data.columns:
        rule("locations: all of the data described", (texts(name).join(listed(places), "value", "left_anti")))
        rule("locations: all described in the data", (listed(places).join(texts(name), "value", "left_anti")))
    for c in contexts:
        finds = [v.get("find") if v.get("find") is not None else v.get("value") for v in c.get("values") or []]
        if c["var_in"] in data.columns and finds:
            rule(f"contexts: {c['context_property']}: data in find", (texts(c["var_in"]).join(listed(finds), "value", "left_anti")))
            rule(f"contexts: {c['context_property']}: find in data", (listed(finds).join(texts(c["var_in"]), "value", "left_anti")))
    taxon, updates = about.get("taxon_name"), program.get("taxonomic_updates") or []
    if updates and taxon in data.columns:
        rule("taxonomic_updates: find in data", (listed(u["find"] for u in updates).join(texts(taxon), "value", "left_anti")))
    if is_long and about.get("trait_name") in data.columns:
        rule("traits: all of the data mapped", (texts(about["trait_name"]).join(listed(t["var_in"] for t in traits), "value", "left_anti")))
    by: dict[str, list[str]] = {}
    for variable, text in exclusions(gone):
        by.setdefault(variable, []).append(text)
    for variable, found in by.items():
        source = variable if variable in data.columns else about.get(variable)
        if source in data.columns:
            rule(f"exclude_observations: {variable} in data", (listed(found).join(texts(source), "value", "left_anti")))
    for field, terms in vocabularies(schema).items():
        named = [*dict.fromkeys(str(x) for x in [about.get(field), *[t.get(field) for t in traits]] if x is not None)]
        for column in [x for x in named if x in data.columns and x not in terms]:
            rule(f"vocabulary: {field} in data", tokens(column).join(listed(terms), "value", "left_anti"))
    return out
