"""Text and null expressions of the harmonisation rules; all are native Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "NA"

#: Name patterns and replacements, in the order in which they apply.
NAME_PATTERNS = [
    (r"^[Xx]\s", "x "),
    (r"\ssp(\s|$)", " sp.$1"),
    (r"\sspp.(\s|$)", " sp.$1"),
    (r"\sspp(\s|$)", " sp.$1"),
    (r"\sspp(\s|$)", " sp.$1"),
    (r"\sssp(\s|$)", " subsp.$1"),
    (r"\sssp.(\s|$)", " subsp.$1"),
    (r"\ssubsp(\s|$)", " subsp.$1"),
    (r"\ssub sp.(\s|$)", " subsp.$1"),
    (r"\svar(\s|$)", " var.$1"),
    (r"\saffin(\s|$)", " aff.$1"),
    (r"\saff(\s|$)", " aff.$1"),
    (r"\saffn(\s|$)", " aff.$1"),
    (r"\sforma(\s|$)", " f.$1"),
    (r"\sms(\s|$)", "$1"),
    (r"\ssl(\s|$)", "$1"),
    (r"\ss\.l\.(\s|$)", "$1"),
    (r"\sss(\s|$)", ""),
    (r"\ss\.s\.(\s|$)", "$1"),
]


def paste(columns: list, separator: str = "") -> Column:
    """Texts joined with a separator; what is missing is written ``NA``."""
    return F.concat_ws(separator, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(MISSING)) for c in columns])


def if_else(test: Column, yes, no) -> Column:
    """``yes`` or ``no``; null where the test is null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(test, lit(yes)).when(~test, lit(no))


def replace_null(x: Column, value) -> Column:
    """``x``, or ``value`` where it is missing."""
    return F.coalesce(x, value if isinstance(value, Column) else F.lit(value))


def is_in(column: Column, values) -> Column:
    """Membership that is never null."""
    return F.coalesce(column.isin(list(values)), F.lit(False)) if values else F.lit(False)


def squish(x: Column) -> Column:
    """White space trimmed, and single inside."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def standardise_name(x: Column) -> Column:
    """A taxon name with the usual abbreviations and a capital first letter."""
    first = F.substring(x, 1, 1)
    x = F.when(first.rlike("^[a-z]"), F.concat(F.upper(first), x.substr(F.lit(2), F.length(x)))).otherwise(x)
    return squish(reduce(lambda y, rule: F.regexp_replace(y, *rule), NAME_PATTERNS, x))


def separate_and_sort(x: Column, separator: str = " ") -> Column:
    """The different tokens of a multi-value text in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(x, separator))), separator)


def standardise_doi(x: Column) -> Column:
    return F.regexp_replace(x, r"^(https?://)?doi\.org/", "")


def has_unsupported_characters(x: Column, exceptions: str = "") -> Column:
    """Whether a text has characters other than ASCII (below 0x7F) and the exceptions."""
    return x.rlike(rf"[^\x00-\x7E{exceptions}]")


#: Letters beyond ASCII whose bytes names and places may have.
EXCEPTION_LETTERS = "ÁÅÀÂÄÆÃĀâíåæäãàáíÇčóöøéèłńl°êÜüùúû±µµ“”‘’-–—≈˜×≥≤"


def unsupported_bytes(x: Column, exceptions: str = EXCEPTION_LETTERS) -> Column:
    """Where (from 1) the UTF-8 form of a text has bytes other than ASCII (below 0x7F) and those of the exceptions."""
    allowed = sorted({b for b in exceptions.encode() if b >= 0x7F})
    size = F.octet_length(x)
    byte = lambda k: F.conv(F.hex(F.substring(F.encode(x, "UTF-8"), k, F.lit(1))), 16, 10).cast("int")
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.when(x.isNotNull(), F.filter(places, lambda k: (byte(k) >= 0x7F) & ~byte(k).isin(allowed)))


def all_tokens_in(x: Column, allowed: Column, separator: str = " ") -> Column:
    """Whether every token of a text is in an array."""
    return F.size(F.array_except(F.split(x, separator), allowed)) == 0


def pad_id(number: Column, largest: Column) -> Column:
    """A number with leading zeros to max(2, ceil(log10(largest))) digits; longer numbers stay whole."""
    text = number.cast("string")
    width = F.greatest(F.lit(2), F.ceil(F.log10(largest.cast("double"))).cast("int"), F.length(text))
    return F.lpad(text, width, "0")


def to_number(x: Column) -> Column:
    """The number that a text is, or null."""
    return F.when(x.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), x.try_cast("double"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number_text(x: Column) -> Column:
    """A number with 15 significant digits, in fixed or, if that is shorter, in scientific notation."""
    return _number_text(x, False)


def printf_text(x: Column) -> Column:
    """A number as ``%.15g`` of C and SQL prints it: 15 significant digits, fixed for exponents from -4 to 14."""
    return _number_text(x, True)


def printf_notation(text: Column) -> Column:
    """A number's text, as ``number_text`` writes it, as ``printf_text`` does; other texts stay."""
    # without an exponent, a number of 15 characters or less is the same in both
    return F.when(text.contains("e") | (F.length(text) > 15), F.coalesce(printf_text(to_number(text)), text)).otherwise(text)


def _number_text(x: Column, printf: bool) -> Column:
    def parts(s: Column) -> Column:
        digits = F.rtrim(F.translate(F.substring_index(s, "e", 1), "0.", " "))
        return F.struct(F.translate(digits, " ", "0").alias("d"), F.substring_index(s, "e", -1).cast("int").alias("e"))

    def lengths(p: Column) -> Column:
        return F.struct(p["d"].alias("d"), p["e"].alias("e"), F.length(p["d"]).alias("n"))

    def text(p: Column) -> Column:
        d, e, n = p["d"], p["e"], p["n"]
        power = F.abs(e).cast("string")
        short = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, 2, 15))).otherwise(""), F.when(e < 0, "e-").otherwise("e+"), F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power))
        plain = F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)).when(n - 1 <= e, F.concat(d, F.repeat(F.lit("0"), e + 1 - n))).otherwise(F.concat(d.substr(F.lit(1), e + 1), F.lit("."), d.substr(e + 2, n)))
        fixed_width = F.when(e < 0, n - e + 1).otherwise(F.when(n - 1 <= e, e + 1).otherwise(n + 1))
        scientific_width = n + F.when(n > 1, 1).otherwise(0) + 2 + F.greatest(F.lit(2), F.length(power))
        return F.when(e.between(-4, 14) if printf else fixed_width <= scientific_width, plain).otherwise(short)

    finite = _let(_let(_let(F.format_string("%.14e", F.abs(x)), parts), lengths), text)
    # most numbers need no more than 15 digits as Java writes them, between 0.001 and ten million, where fixed is the
    # shorter notation but for one digit before five or six zeros
    written = x.cast("string")
    usual = F.abs(x).between(0.001, 9999999.0) & (F.length(written) <= 16)
    if not printf:
        usual &= ~written.rlike(r"^-?[1-9]0{5,}\.0$")
    return (
        F.when(F.isnan(x), "nan" if printf else "NaN")
        .when(x == float("inf"), "inf" if printf else "Inf")
        .when(x == float("-inf"), "-inf" if printf else "-Inf")
        .when(x == 0, F.when(written.startswith("-"), "-0").otherwise("0") if printf else F.lit("0"))
        .when(usual, F.regexp_replace(written, r"\.0$", ""))
        .when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), finite))
    )


def word(x: Column, first: int, last: int | None = None) -> Column:
    """Words first to last (from 1) of a text; null if it has fewer."""
    last = last or first
    parts = F.split(x, " ")
    return F.when(F.size(parts) >= last, F.array_join(F.slice(parts, first, last - first + 1), " "))
