"""Small rule tables: sequences of find-and-replace rules composed to one lookup, exclusions, dictionary and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_tokens_in, has_unsupported_characters, is_in, to_number
from ..sources.scratch import rule_table
from .units import NO_CONVERSION, RANGE_TYPES, Conversion, check_conversions, convert_units, parse_conversion, read_conversions  # noqa: F401

TIME_TRAITS = ["flowering_time", "fruiting_time"]

#: The messages of the error flags.
UNKNOWN_TRAIT = "Trait name not in trait dictionary"
EXCLUDED = "Observation excluded in metadata"
UNSUPPORTED_CHARACTERS = "Value contains unsupported characters"
MISSING_VALUE = "Missing value"
MISSING_TAXON = "Missing species name"
UNSUPPORTED_VALUE = "Unsupported trait value"
TIME_LETTERS = "Time can only contain Y & Ns"
TIME_LENGTH = "Times must be length 12"
NOT_NUMERIC = "Value does not convert to numeric"
OUT_OF_RANGE = "Value out of allowable range"


def compose(rules: list[tuple[str, str | None]]) -> dict[str, tuple[str | None, int]]:
    """What a sequence of rules (find, replace) makes of each text it finds, and the last rule that hit it.

    A later rule sees what earlier rules left.
    """
    out = {}
    for start, _ in rules:
        if start is None or start in out:
            continue
        now, last = start, None
        for k, (find, replace) in enumerate(rules):
            if now is not None and now == find:
                now, last = replace, k
        out[start] = (now, last)
    return out


def rule_text(x) -> str | None:
    """A text of a program as data has it: numbers with 15 digits, as YAML may read a text as a number."""
    if x is None or isinstance(x, str):
        return x
    return str(x).upper() if isinstance(x, bool) else f"{x:.15g}" if isinstance(x, float) else str(x)


def substitute(df: DataFrame, rules: list[tuple[str, str, str | None]], trait: str = "trait_name", value: str = "value") -> DataFrame:
    """Values replaced by rules (trait, find, replace); both sides are compared in lower case."""
    if not rules:
        return df
    low = lambda x: None if x is None else rule_text(x).lower()
    rows = []
    for name in dict.fromkeys(t for t, _, _ in rules):
        rows += [(name, k, v) for k, (v, _) in compose([(low(f), low(r)) for t, f, r in rules if t == name]).items()]
    table = rule_table(df.sparkSession, rows, "_t string, _find string, _to string")
    out = df.join(table, (F.col(trait) == F.col("_t")) & (F.col(value) == F.col("_find")), "left")
    return out.withColumn(value, F.when(F.col("_find").isNotNull(), F.col("_to")).otherwise(F.col(value))).drop("_t", "_find", "_to")


def exclusions(rules: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(variable, text) of exclusion rules; ``find`` may list several texts, separated by a comma and a space."""
    return [(v, " ".join(x.split())) for v, find, *_ in rules for x in rule_text(find).split(", ")]


def flag_excluded(df: DataFrame, rules: list[tuple[str, str, str]], trait_names: set[str]) -> Column:
    """Whether a listed text stands in the value of a listed trait or in any other listed column."""
    by: dict[str, list[str]] = {}
    for variable, text in exclusions(rules):
        by.setdefault(variable, []).append(text)
    test = F.lit(False)
    for variable, texts in by.items():
        if variable in trait_names:
            test |= F.coalesce((F.col("trait_name") == variable) & F.col("value").isin(texts), F.lit(False))
        elif variable in df.columns:
            test |= is_in(F.col(variable), texts)
    return test


DICTIONARY = "trait_name string, type string, units string, min double, max double, levels array<string>"


def with_dictionary(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds _type, _units, _min, _max, _levels and _known of each row's trait (first entry of a trait)."""
    table = dictionary.dropDuplicates(["trait_name"]).select(F.col("trait_name").alias("_trait"), *[F.col(c).alias(f"_{c}") for c in ("type", "units", "min", "max", "levels")])
    return df.join(table, F.col("trait_name") == F.col("_trait"), "left").withColumn("_known", F.col("_trait").isNotNull()).drop("_trait")


def value_error(excluded: Column | None = None) -> Column:
    """The error of a row (with dictionary columns) before units: the one that wins of all that apply."""
    value, kind, trait = F.col("value"), F.col("_type"), F.col("trait_name")
    plain = ~is_in(F.col("value_type"), RANGE_TYPES)
    return (
        F.when(F.col("taxon_name").isNull(), MISSING_TAXON)
        .when(value.isNull(), MISSING_VALUE)
        .when(excluded if excluded is not None else F.lit(False), EXCLUDED)
        .when(~F.col("_known"), UNKNOWN_TRAIT)
        .when(has_unsupported_characters(value), UNSUPPORTED_CHARACTERS)
        .when((kind == "categorical") & F.col("_levels").isNotNull() & ~all_tokens_in(value, F.col("_levels")), UNSUPPORTED_VALUE)
        .when(trait.isin(TIME_TRAITS) & ~value.rlike("^[YyNn]+$"), TIME_LETTERS)
        .when(trait.isin(TIME_TRAITS) & (F.length(value) != 12), TIME_LENGTH)
        .when((kind == "numeric") & plain & to_number(value).isNull(), NOT_NUMERIC)
    )


def range_error(error: Column) -> Column:
    """``error``, or that a numeric value lies outside its (inclusive) limits."""
    number = to_number(F.col("value"))
    outside = (F.col("_type") == "numeric") & ~is_in(F.col("value_type"), RANGE_TYPES) & ((number < F.col("_min")) | (number > F.col("_max")))
    return F.when(error.isNotNull(), error).when(outside, OUT_OF_RANGE)
