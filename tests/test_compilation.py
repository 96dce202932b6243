"""Many datasets in one plan, units given by columns, numbers in programs, and formulas of units."""

import uuid

import pytest
import yaml
from pyspark.sql import functions as F

from fieldloom.operators import rules, units
from fieldloom.plans import build, compilation, database
from fieldloom.sources import program as prog

from .test_harmonise import CONVERSIONS, DEFINITIONS, PROGRAM, ROWS, folder  # noqa: F401


def rows_of(db, name):
    table = db[name]
    return sorted(map(str, (r.asDict() for r in table.select(*sorted(table.columns)).collect())))


def same(one, other):
    for name in database.TABLES:
        assert rows_of(one, name) == rows_of(other, name), name


@pytest.fixture(scope="module")
def taxa(spark):
    return spark.createDataFrame([("Banksia serrata subsp. minor", "Banksia serrata", "species", "accepted")], "aligned_name string, taxon_name string, taxon_rank string, aligned_name_taxonomic_status string")


def test_many_equal_single(spark, folder, taxa):  # noqa: F811
    same(compilation.build_many(spark, str(folder), None, DEFINITIONS, CONVERSIONS, taxa=taxa), build.build(spark, str(folder), None, DEFINITIONS, CONVERSIONS, taxa=taxa))


def test_custom_steps_are_built_apart(spark, folder):  # noqa: F811
    hooks = {"Doe_2020": lambda df: df.filter("plant = '1'")}
    both = compilation.build_many(spark, str(folder), None, DEFINITIONS, CONVERSIONS, hooks=hooks)
    same(both, build.build(spark, str(folder), None, DEFINITIONS, CONVERSIONS, hooks=hooks))
    assert both["traits"].filter("dataset_id = 'Doe_2020'").count() == 2


def variants(top, n):
    """Small datasets of different programs."""
    for k in range(n):
        path = top / f"D{k:03d}"
        path.mkdir()
        about = {**PROGRAM["dataset"], "individual_id": "plant" if k % 2 else None, "location_name": "site" if k % 3 else None, "collection_date": f"20{k % 10}0"}
        traits = [{**PROGRAM["traits"][0], "unit_in": ["cm2", "mm2", "plant"][k % 3]}, {**PROGRAM["traits"][1], "life_stage": ["adult", "shade"][k % 2]}]
        contexts = [PROGRAM["contexts"], None, [{"context_property": "free", "category": "plot_context", "var_in": "shade"}, {"context_property": "bag", "category": "entity_context", "var_in": "voucher", "values": [{"value": "v1"}]}]][k % 3]
        program = {**PROGRAM, "dataset": about, "traits": traits, "contexts": contexts, "taxonomic_updates": PROGRAM["taxonomic_updates"] if k % 4 else None, "locations": PROGRAM["locations"] if k % 3 else None, "exclude_observations": [{"variable": "leaf_area", "find": 2.5 if k % 2 else 7, "reason": "r"}] if k % 5 else None}
        (path / "data.csv").write_text(ROWS if k % 7 else ROWS.split("\n")[0] + "\n")
        (path / "metadata.yml").write_text(yaml.safe_dump(program))


def jobs(spark, work):
    name = f"count-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    for n in ("traits", "contexts", "methods"):
        out[n].count()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("other", "other")
    return n, out


def test_jobs_do_not_grow_with_datasets(spark, tmp_path, taxa):
    variants(tmp_path, 200)
    few, _ = jobs(spark, lambda: compilation.build_many(spark, str(tmp_path), [f"D{k:03d}" for k in range(12)], DEFINITIONS, CONVERSIONS, taxa=taxa))
    many, db = jobs(spark, lambda: compilation.build_many(spark, str(tmp_path), None, DEFINITIONS, CONVERSIONS, taxa=taxa))
    assert many <= few + 5
    assert db["methods"].select("dataset_id").distinct().count() == 200
    # datasets of a kind are equal but for their names, dates and numbers
    some = ["D000", "D001", "D005", "D008"]
    one = build.build(spark, str(tmp_path), some, DEFINITIONS, CONVERSIONS, taxa=taxa)
    for name in ("traits", "excluded_data", "contexts", "locations", "methods", "taxonomic_updates", "identifiers", "contributors"):
        part = db[name].filter(F.col("dataset_id").isin(some))
        assert rows_of({name: part}, name) == rows_of(one, name), name


def test_rows_of_files_read_in_parts(spark, tmp_path):
    texts = {"a": "x,y\n" + "".join(f"{k},NA\n" for k in range(3000)), "b": 'x,x,\n1,"two\n"' + ',3\n', "c": ""}
    files = {}
    for d, text in texts.items():
        (tmp_path / d).mkdir()
        files[d] = str(tmp_path / d / "data.csv")
        (tmp_path / d / "data.csv").write_text(text)
    headers = {d: compilation.read_header(p) for d, p in files.items()}
    assert headers["b"] == ["x...1", "x...2", "...3"] and headers["c"] == []
    got = compilation.read_cells(spark, files, headers).collect()
    assert sorted((r._row, r.cells["x"]) for r in got if r.dataset_id == "a") == [(k + 1, str(k)) for k in range(3000)]
    assert [r.cells for r in got if r.dataset_id == "b"] == [{"x...1": "1", "x...2": "two\n", "...3": "3"}]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        cut = compilation.read_cells(spark, {"a": files["a"]}, headers, multi_line=False)
        assert sorted((r._row, r.cells["x"]) for r in cut.collect()) == [(k + 1, str(k)) for k in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# --- units

@pytest.mark.parametrize("text, x, want", [
    ("x*10", 3.0, 30.0), ("x*1/1000", 7.0, 7.0 * 1 / 1000), ("x*.01", 3.0, 3.0 * 0.01), ("x*-1", 3.0, -3.0), ("x*-1000", 3.0, -3000.0), ("1/x*1000", 7.0, 1 / 7.0 * 1000), ("1000/x", 7.0, 1000 / 7.0), (" ( x ) ", 2.0, 2.0),
    ("x/14.0067", 3.0, 3 / 14.0067), ("x*1000/30.973761", 3.0, 3.0 * 1000 / 30.973761), ("(x-32)/1.8", 50.0, (50.0 - 32) / 1.8), ("x*1.8+32", 7.0, 7.0 * 1.8 + 32), ("100-x", 7.0, 93.0), ("(1/1000)*x", 7.0, 7.0 * (1 / 1000)), ("-x/2", 7.0, -3.5),
    ("2-(3-x)*4", 7.0, 2 - (3 - 7.0) * 4), ("1/(2/(x+1))", 4.0, 1 / (2 / 5.0)), ("x*1e-06", 7.0, 7.0 * 1e-06), ("+x", 1.5, 1.5), ("1/x", 0.0, float("inf")), ("-1/x", 0.0, float("-inf")),
])
def test_formulas(spark, text, x, want):
    formula = units.parse_conversion(text)
    columns = "trait_name string, value_type string, value string, unit_in string, error string, _type string, _units string"
    row = spark.createDataFrame([("t", "raw", repr(x), "a", None, "numeric", "b"), ("t", "bin", f"{x!r}--{x!r}", "a", None, "numeric", "b")], columns)
    got = {r.value_type: r.value for r in units.convert_units(row, {"a-b": formula, "other": units.parse_conversion("1/(2-x)")}).collect()}
    text = {float("inf"): "Inf", float("-inf"): "-Inf"}.get(want, f"{want:.15g}")
    number = lambda v: float(v.replace("Inf", "inf"))
    assert number(got["raw"]) == number(text) and got["bin"] == f"{got['raw']}--{got['raw']}"


def test_rows_that_cannot_be_read(spark):
    rows = [{"unit_from": "a", "unit_to": "b", "function": f} for f in ("x*2", "x*x", "3", "x/0", "(x", "x)", "x**2", "", "y*2", "x*", "import os")]
    rows += [{"unit_from": "c", "unit_to": "d", "function": "x"}, {"unit_from": "c", "unit_to": "d", "function": "x*2"}, {"unit_from": "e", "function": "x"}]
    known = units.read_conversions(rows)
    assert set(known) == {"a-b", "c-d"} and known["a-b"] == units.parse_conversion("x*2")
    (read, ok, bad), (_, once, twice) = units.check_conversions(rows)
    assert not ok and bad.count("row") == 11 and "row 14: no unit_to" in bad and not once and twice == "c-d"
    assert units.check_conversions(rows[:1]) == [(read, True, ""), ("units: one formula a pair", True, "")]


#: Shaped like compilations of small studies: units in a column, bins, traits without a name, contexts in columns and in
#: trait fields, locations without coordinates, numbers where texts are meant.
COLUMNS = """name,key,SLA,SLA_units,longevity,span_units,plant,site,sex,slope,clock,height
Eucalyptus grandis,B_1,90,cm2/g,5--15,mo,1,north,female2,bottom,9:00,3
Grevillea robusta,A_1,0.1,g/mm2,152--365,d,1,south,male,crest,17:00:00,4
Acacia sp,A_1,,,,,2,north,,,,10
Grevillea robusta,A_1,0.167,g/mm2,1,yr,,south,male,odd,09:30,5
Banksia,C_1,7,stone,2--3,mo,3,,female,crest,,3
"""
SHAPED = {
    **PROGRAM, "identifiers": None, "locations": {"north": {"elevation (m)": 800, "latitude (deg)": -17.1166667}, "south": {"elevation (m)": 25, "latitude (deg)": None}},
    "dataset": {"data_is_long_format": False, "taxon_name": "name", "location_name": "site", "individual_id": "plant", "source_id": "key", "basis_of_record": "field", "life_stage": "adult", "collection_date": "unknown/2009", "replicates": 3},
    "contexts": [
        {"context_property": "sex", "category": "entity_context", "var_in": "sex", "values": [{"value": "female"}, {"value": "male"}, {"find": "female2", "value": "female"}]},
        {"context_property": "slope", "category": "plot_context", "var_in": "slope", "values": [{"find": "bottom", "description": "low"}, {"value": "crest"}]},
        {"context_property": "clock", "category": "temporal_context", "var_in": "clock"}, {"context_property": "height", "category": "entity_context", "var_in": "height", "values": [{"value": 3.0}, {"value": 10.0}, {"value": 4}]},
        {"context_property": "branch", "category": "method_context", "var_in": "method_context", "values": [{"value": "250 mm", "description": "long"}]},
    ],
    "traits": [
        {"var_in": "SLA", "unit_in": "SLA_units", "trait_name": "leaf_mass", "entity_type": "individual", "value_type": "mean", "basis_of_value": "measurement", "methods": "scan", "method_context": "250 mm"},
        {"var_in": "longevity", "unit_in": "span_units", "trait_name": "span", "entity_type": "population", "value_type": "bin", "basis_of_value": "expert_score", "replicates": 10, "methods": "asked"},
        {"var_in": "height", "unit_in": "m", "trait_name": None, "methods": "none"},
    ],
    "substitutions": [{"trait_name": "span", "find": 1, "replace": "1--1"}], "taxonomic_updates": None, "exclude_observations": [{"variable": "leaf_mass", "find": 0.167, "reason": "r"}],
}
SHAPED_DEFINITIONS = {"leaf_mass": {"type": "numeric", "units": "g/m2", "allowed_values_min": 1, "allowed_values_max": 1e6}, "span": {"type": "numeric", "units": "mo"}}
SHAPED_UNITS = units.read_conversions([{"unit_from": "cm2/g", "unit_to": "g/m2", "function": "1/x*10000"}, {"unit_from": "g/mm2", "unit_to": "g/m2", "function": "x*1000000"}, {"unit_from": "d", "unit_to": "mo", "function": "x*1/30.4167"}, {"unit_from": "yr", "unit_to": "mo", "function": "x*12"}])


@pytest.mark.parametrize("one_plan", [True, False])
def test_units_in_columns_and_numbers_in_programs(spark, tmp_path, one_plan):
    (tmp_path / "Shaped").mkdir()
    (tmp_path / "Shaped" / "data.csv").write_text(COLUMNS)
    (tmp_path / "Shaped" / "metadata.yml").write_text(yaml.safe_dump(SHAPED))
    db = (compilation.build_many if one_plan else build.build)(spark, str(tmp_path), None, SHAPED_DEFINITIONS, SHAPED_UNITS)
    got = sorted((r.taxon_name, r.trait_name, r.value, r.unit, r.replicates, r.source_id, r.entity_context_id, r.method_context_id) for r in db["traits"].collect())
    assert got == sorted([
        ("Eucalyptus grandis", "leaf_mass", "111.111111111111", "g/m2", "3", "B_1", "02", "01"), ("Eucalyptus grandis", "span", "5--15", "mo", "10", "B_1", "02", None),
        ("Grevillea robusta", "leaf_mass", "1e+05", "g/m2", "3", "A_1", "03", "01"), ("Grevillea robusta", "span", "12--12", "mo", "10", "A_1", "04", None), ("Grevillea robusta", "span", f"{152 / 30.4167:.15g}--{365 / 30.4167:.15g}", "mo", "10", "A_1", "03", None),
        ("Banksia", "span", "2--3", "mo", "10", "C_1", "02", None),
    ], key=lambda r: tuple(map(str, r)))
    errors = sorted((r.taxon_name, r.value, r.unit, r.error) for r in db["excluded_data"].collect())
    assert errors == [("Banksia", "7", "stone", rules.NO_CONVERSION), ("Grevillea robusta", "0.167", "g/mm2", rules.EXCLUDED)]
    contexts = {(r.context_property, r.value): (r.link_id, r.link_vals) for r in db["contexts"].collect()}
    assert contexts["branch", "250 mm"] == ("method_context_id", "01") and ("clock", "09:00:00") in contexts and contexts["sex", "female"][0] == "entity_context_id"
    assert {(r.location_property, r.value) for r in db["locations"].collect()} == {("elevation (m)", "800"), ("latitude (deg)", "-17.1166667"), ("elevation (m)", "25"), ("latitude (deg)", None)}


def test_collectors_keep_their_roles():
    program = {"contributors": {"data_collectors": [{"last_name": "Doe", "given_name": "J", "additional_role": "contact"}, {"last_name": "Roe", "given_name": "A"}]}}
    assert build.method_details("d", program)["data_collectors"] == "J Doe (contact), A Roe"
    assert prog.clean({"a": ".na"}) == {"a": None}
