"""What a build of one dataset costs: which tables are shuffled, written and processed at all; results stay the same."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import ids, ranks, rules, taxonomy
from fieldloom.plans import build, catalogue
from fieldloom.sources import scratch

SMALL = "/root/testdata/sf0.001"


def test_rule_tables_are_not_joined_by_a_shuffle_of_the_measurements(spark):
    dictionary = build.dictionary_frame(spark, {"mass": {"type": "numeric", "units": "kg"}})
    df = spark.createDataFrame([("mass", "raw", "g", "3", "a b", None)], "trait_name string, value_type string, unit_in string, value string, taxon_name string, error string")
    df = rules.substitute(df, [("mass", "3", "4")])
    df = rules.convert_units(rules.with_dictionary(df, dictionary), {"g-kg": rules.parse_conversion("x/1000")})
    df = taxonomy.update_names(df, [("a b", "c d", None)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in plan


def test_tables_without_measurements_are_made_without_them(spark, monkeypatch):
    def never(*_):
        raise AssertionError("measurements were processed")

    monkeypatch.setattr(build, "process_parsed", never)
    assert catalogue.queries()["process_dataset_details"](spark, SMALL).count() == 12


def test_columns_without_values_are_not_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "new_path", lambda _: str(tmp_path / "kept"))
    df = spark.range(3).select("id", F.lit(None).cast("string").alias("nothing"), F.lit("x").alias("some.thing"))
    kept = scratch.keep(df, ["nothing", "elsewhere"])
    assert spark.read.parquet(str(tmp_path / "kept")).columns == ["id", "some.thing"]
    assert kept.columns == df.columns and sorted(kept.collect()) == sorted(df.collect())


@pytest.mark.parametrize("few", [ranks.FEW, 2])
def test_ranks_over_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    rows = [(g, k) for g in ("a", "b", None) for k in range(40)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, k int").repartition(5), ["g"], ["k"], "number", "total")
    assert {(r["g"], r["k"], r["number"], r["total"]) for r in got.collect()} == {(g, k, k + 1, 40) for g, k in rows}


def individuals(rows):
    """individual_id by the rule, in Python: rows are (_row, dataset, taxon, population, entity, individual, parsing, value)."""
    out, shown = {}, {(d, p) for _, d, _, _, e, _, p, v in rows if v is not None and e is not None and "individual" in e}
    mapped = {r[1] for r in rows if r[5] is not None}
    keys = {r[0]: (r[6] if r[5] is None and r[4] == "individual" else r[5]) if r[1] in mapped else r[6] if (r[1], r[6]) in shown else None for r in rows}
    for group in {r[1:4] for r in rows}:
        order = list(dict.fromkeys(keys[r[0]] for r in sorted(rows) if r[1:4] == group and keys[r[0]] is not None))
        for r in rows:
            if r[1:4] == group and keys[r[0]] is not None and r[4] in ("individual", None):
                out[r[0]] = ("" if r[4] else "entity_unk") + f"{order.index(keys[r[0]]) + 1:02d}"
    return {r[0]: out.get(r[0]) for r in rows}


def test_individuals_of_all_kinds_of_rows(spark):
    """Datasets: d has individuals given, e has none given, f neither has rows without an entity type."""
    kinds = product("def", ["t", "u"], ["01", None], ["individual", "population", "species", None], [None, "i1"], ["p1", "p2", "p3"], ["1", None])
    rows = []
    for n, (d, t, pop, entity, given, parsing, value) in enumerate(kinds):
        if d == "f" and (entity is None or pop is None and entity == "individual") or n % 5 == 3:
            continue
        rows.append((len(rows) * 7919 % 10007, d, t, None if entity == "species" else pop, entity, given if d == "d" else None, f"{parsing}{t}{n % 3}", value))
    df = spark.createDataFrame(rows, "_row long, dataset_id string, taxon_name string, population_id string, entity_type string, individual_id string, parsing_id string, value string")
    got = {r["_row"]: r["individual_id"] for r in ids.individual_ids(df).collect()}
    assert got == individuals(rows)


def test_process_dataset_writes_numbers_as_its_sql(spark, tmp_path):
    from .test_sql_notation import differing

    totals = "CASE WHEN o_custkey % 40 IN (2, 3) THEN 200000 ELSE o_totalprice END AS o_totalprice"
    assert differing(spark, tmp_path, "process_dataset", orders=totals) == []
