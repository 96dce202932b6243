"""Tables as subject-predicate-object triples, and their N-Quads form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed_object(value: Column, predicate: Column, dates: list[str] = ()) -> Column:
    """An IRI in angle brackets, a date with its type, or a quoted text."""
    date = F.concat(F.lit('"'), value, F.lit('"^^<http://www.w3.org/2001/XMLSchema#date>'))
    quoted = F.concat(F.lit('"'), F.regexp_replace(value, '"', r'\\"'), F.lit('"'))
    return F.when(value.rlike("^https?://"), F.concat(F.lit("<"), value, F.lit(">"))).when(predicate.isin(list(dates)), date).otherwise(quoted)


def triples(df: DataFrame, subject: Column, predicates: dict[str, str], separator: str = "; ", dates: list[str] = ()) -> DataFrame:
    """One row per subject, predicate and value; texts with several values are split, missing ones go."""
    each = F.explode(F.array(*[F.struct(F.lit(iri).alias("predicate"), F.col(c).cast("string").alias("value")) for c, iri in predicates.items()]))
    long = df.select(subject.alias("subject"), each.alias("e")).select("subject", "e.*").filter("value is not null")
    long = long.withColumn("value", F.explode(F.split("value", separator)))
    return long.select("subject", "predicate", typed_object(F.col("value"), F.col("predicate"), dates).alias("object")).distinct()


def typed_triples(rows: DataFrame, identifiers: DataFrame, base: str, name: str, separator: str = "; ") -> DataFrame:
    """Triples of rows (subject, predicate, value), in which the predicate decides what kind of object a value is.

    ``base`` is the IRI of the vocabulary, whose terms are ``<base#term>``; ``identifiers`` is (identifier, entity): the
    IRI of each prefixed name (``prefix:name``).  Texts with several values are split.

    - descriptions, labels and comments are English texts;
    - other values without a colon are terms of the vocabulary, those with one are looked up (``<NA>`` if unknown);
    - datatypes stand as they are, schemes are the vocabulary itself, dates of creation are typed dates.

    The subject ``name`` is the vocabulary itself.
    """
    each = rows.filter("value is not null").select("subject", "predicate", F.explode(F.split("value", separator)).alias("value")).withColumn("value", F.trim("value"))
    known = identifiers.groupBy(F.col("identifier").alias("_identifier")).agg(F.min("entity").alias("_entity"))
    each = each.join(known, F.col("value") == F.col("_identifier"), "left")
    value, predicate = F.col("value"), F.col("predicate")
    iri = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    kind = (
        F.when(predicate.contains("created"), F.concat(F.lit('"'), value, F.lit('"^^<xsd:date>')))
        .when(predicate.contains("inScheme"), F.lit(f"<{base}>"))
        .when(predicate.contains("#datatype"), iri(value))
        .when(predicate.rlike("description|[Ll]abel|[Cc]omment"), F.concat(F.lit('"'), value, F.lit('"@en')))
        .when(value.contains(":"), iri(F.coalesce("_entity", F.lit("NA"))))
        .otherwise(F.concat(F.lit(f"<{base}#"), value, F.lit(">")))
    )
    subject = F.when(F.col("subject") == name, F.lit(f"<{base}>")).otherwise(F.concat(F.lit(f"<{base}#"), F.col("subject"), F.lit(">")))
    return each.select(subject.alias("subject"), iri(predicate).alias("predicate"), kind.alias("object")).distinct()


def write_nquads(df: DataFrame, graph: str, path: str) -> None:
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    df.select(F.concat_ws(" ", iri("subject"), iri("predicate"), F.col("object"), F.lit(f"<{graph}>"), F.lit("."))).write.text(path)
