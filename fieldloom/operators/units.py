"""Unit conversions: formulas of x, read by a small grammar and never evaluated as code, and their use on rows.

A formula holds x once, and numbers, ``+ - * /``, signs and parentheses, so it is a chain of steps from x outwards.
Steps run in the order in which the formula is written, as each rounds: ``x*1/1000`` divides by 1000.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_in, number_text, to_number
from ..sources.scratch import rule_table

#: Value types whose values have two ends, ``lo--hi``.
RANGE_TYPES = ["range", "bin"]
NO_CONVERSION = "Missing unit conversion"
#: Columns of one step: what is divided by x, then factor, divisor and summand.
STEP = ("over", "times", "by", "plus")


@dataclass(frozen=True)
class Conversion:
    """Steps done to x in order; each is (over, times, by, plus): ``over`` / x unless it is None, then * times / by + plus."""

    steps: tuple[tuple[float | None, float, float, float], ...]


def _chained(operations: list[tuple[str, float]]) -> Conversion:
    """Single operations (``~`` is number - x, ``\\`` is number / x) put into as few steps as their order allows."""
    steps: list[list] = [[None, 1.0, 1.0, 0.0]]
    filled = -1  # the last part of the current step that an operation took
    for sign, number in operations:
        part = "\\*/+".index({"-": "+", "~": "+"}.get(sign, sign))
        if part <= filled or sign == "~" and filled >= 1:
            steps.append([None, 1.0, 1.0, 0.0])
        filled = part
        if sign == "~":
            steps[-1][1:] = [-1.0, 1.0, number]
        else:
            steps[-1][part] = -number if sign == "-" else number
    return Conversion(tuple(tuple(s) for s in steps))


def parse_conversion(text: str) -> Conversion:
    """Reads a formula of x; a ValueError says what is wrong with others."""
    tokens = re.findall(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\S)", str(text))
    place = 0

    def take(*wanted: str) -> str | None:
        nonlocal place
        if place < len(tokens) and (not wanted or tokens[place] in wanted):
            place += 1
            return tokens[place - 1]
        return None

    def joined(a, sign: str, b):
        """Two parts, of which one at most is a chain (list) and the others numbers."""
        if isinstance(a, list) and isinstance(b, list):
            raise ValueError(f"x stands twice: {text}")
        if isinstance(a, list):
            if sign == "/" and b == 0:
                raise ValueError(f"division by zero: {text}")
            return [*a, (sign, b)]
        if isinstance(b, list):
            return [*b, ({"-": "~", "/": "\\"}.get(sign, sign), a)]
        if sign == "/" and b == 0:
            raise ValueError(f"division by zero: {text}")
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[sign]()

    def total():
        out = product()
        while sign := take("+", "-"):
            out = joined(out, sign, product())
        return out

    def product():
        out = signed()
        while sign := take("*", "/"):
            out = joined(out, sign, signed())
        return out

    def signed():
        if sign := take("+", "-"):
            inner = signed()
            return inner if sign == "+" else joined(inner, "*", -1.0)
        return single()

    def single():
        token = take()
        if token == "x":
            return []
        if token == "(":
            inner = total()
            if not take(")"):
                raise ValueError(f"a parenthesis stays open: {text}")
            return inner
        if token is None or not re.match(r"[\d.]", token) or token == ".":
            raise ValueError(f"not a number, x or parenthesis: {token or 'end'} in {text}")
        return float(token)

    out = total()
    if place < len(tokens):
        raise ValueError(f"not expected: {tokens[place]} in {text}")
    if not isinstance(out, list):
        raise ValueError(f"without x: {text}")
    return _chained(out)


def read_conversions(rows: list[dict]) -> dict[str, Conversion]:
    """Conversions by ``from-to`` from rows of unit_from, unit_to and function; of rows that can't be read see ``check_conversions``."""
    out = {}
    for r in rows:
        try:
            out[f"{r['unit_from']}-{r['unit_to']}"] = parse_conversion(r["function"])
        except (ValueError, KeyError):
            continue
    return out


def check_conversions(rows: list[dict]) -> list[tuple[str, bool, str]]:
    """(rule, ok, detail): rows that can't be read, pairs of units given twice with different formulas."""
    bad, seen, twice = [], {}, []
    for n, r in enumerate(rows):
        try:
            formula, key = parse_conversion(r["function"]), f"{r['unit_from']}-{r['unit_to']}"
        except ValueError as error:
            bad.append(f"row {n + 1}: {error}")
        except KeyError as error:
            bad.append(f"row {n + 1}: no {error.args[0]}")
        else:
            if seen.setdefault(key, formula) != formula:
                twice.append(key)
    return [("units: formulas can be read", not bad, "; ".join(bad)), ("units: one formula a pair", not twice, ", ".join(twice))]


def _step(x: Column, n: int) -> Column:
    over, times, by, plus = (F.col(f"_{part}{n}") for part in STEP)
    turned = F.when(over.isNull(), x).when(x == 0, over * float("inf")).otherwise(over / x)
    return turned * times / by + plus


def convert_units(df: DataFrame, conversions: dict[str, Conversion]) -> DataFrame:
    """Values in the dictionary's units, and ``unit``; rows must have dictionary columns and ``error``.

    Values whose unit fits stay as written.  Both ends of a range or bin (``lo--hi``) are converted and not
    swapped.  Rows in error keep value and unit.  Categorical traits have no unit, in error or not.
    Numbers of a formula are plain columns, and each step is a column of its own, so that rows stay in generated code
    and no expression holds another many times.
    """
    key = F.concat_ws("-", F.coalesce("unit_in", F.lit("NA")), F.coalesce("_units", F.lit("NA")))
    numeric = F.col("error").isNull() & (F.col("_type") == "numeric")
    same = F.coalesce(F.col("unit_in") == F.col("_units"), F.lit(False))
    most = max([1, *[len(c.steps) for c in conversions.values()]])
    nothing = (None, 1.0, 1.0, 0.0)
    rows = [(k, *[v for n in range(most) for v in (c.steps[n] if n < len(c.steps) else nothing)]) for k, c in conversions.items()]
    table = rule_table(df.sparkSession, rows, "_key string, " + ", ".join(f"_{part}{n} double" for n in range(most) for part in STEP))
    out = df.withColumns({"_change": F.coalesce(numeric & ~same, F.lit(False)), "_wanted": key})
    out = out.join(table, F.col("_wanted") == F.col("_key"), "left").withColumn("_known", F.col("_key").isNotNull() & F.col("_change"))
    two = is_in(F.col("value_type"), RANGE_TYPES)
    out = out.withColumn("_number", F.when(F.col("_known") & ~two, to_number(F.col("value"))))
    both = F.transform(F.split("value", "--"), to_number)
    for n in range(most):
        out = out.withColumn("_number", _step(F.col("_number"), n))
        both = F.transform(both, lambda x: _step(x, n))  # noqa: B023
    both = F.array_join(F.transform(both, number_text), "--")
    out = out.withColumn("_new", F.when(F.col("_known") & two, both).otherwise(number_text(F.col("_number"))))
    return out.withColumns({
        "unit": F.when(F.col("_type") == "categorical", F.lit(None)).when(F.col("_known"), F.col("_units")).otherwise(F.col("unit_in")),
        "value": F.when(F.col("_known"), F.col("_new")).otherwise(F.col("value")),
        "error": F.when(F.col("_change") & ~F.col("_known"), NO_CONVERSION).otherwise(F.col("error")),
    }).drop("_change", "_wanted", "_key", "_known", "_number", "_new", *[f"_{part}{n}" for n in range(most) for part in STEP])
