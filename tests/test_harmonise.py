"""The harmonisation engine: text rules, ids, a wide and a long dataset from files, editing, validation, streaming."""

import duckdb
import pytest
import yaml
from pyspark.sql import functions as F

import __spark_entry__
from fieldloom.functions import text as tx
from fieldloom.operators import ids, ranks, reshape, rules, taxonomy
from fieldloom.plans import build, catalogue, database, validate
from fieldloom.plans.hooks import apply_steps
from fieldloom.sources import program as prog
from fieldloom.sources import suggest
from fieldloom.sources import tables as src
from fieldloom.streaming import ingest

DEFINITIONS = {
    "leaf_area": {"type": "numeric", "units": "mm2", "allowed_values_min": 1.0, "allowed_values_max": 5000.0},
    "lifespan": {"type": "categorical", "allowed_values_levels": {"annual": "", "perennial": ""}},
}
CONVERSIONS = {"cm2-mm2": rules.parse_conversion("x*100"), "1/mm2-mm2": rules.parse_conversion("1/x")}
PROGRAM = {
    "source": {"primary": {"key": "Doe_2020", "bibtype": "Article", "year": "2020", "author": "J. Doe and A. Roe", "title": "Leaves", "journal": "Trees", "volume": 3, "pages": "1-2"}},
    "contributors": {"data_collectors": [{"last_name": "Doe", "given_name": "J"}, {"given_name": "none"}], "dataset_curators": "Roe"},
    "dataset": {"data_is_long_format": False, "taxon_name": "species", "location_name": "site", "individual_id": "plant", "basis_of_record": "field", "collection_date": "2020"},
    "identifiers": [{"var_in": "voucher", "identifier_type": "voucher", "institution_code": "HERB"}],
    "locations": {"north": {"latitude (deg)": "-10", "longitude (deg)": "140", "life_stage": "adult"}, "a south": {"latitude (deg)": "-20", "longitude (deg)": "141"}},
    "contexts": [{"context_property": "shade", "category": "treatment_context", "var_in": "shade", "values": [{"find": "s", "value": "shaded", "description": "under cloth"}, {"find": "o", "value": "open"}]}],
    "traits": [{"var_in": "area", "unit_in": "cm2", "trait_name": "leaf_area", "entity_type": "individual", "value_type": "raw", "basis_of_value": "measurement", "methods": "scanner"}, {"var_in": "life", "unit_in": None, "trait_name": "lifespan", "entity_type": "species", "value_type": "mode", "basis_of_value": "expert_score", "methods": "flora"}],
    "substitutions": [{"trait_name": "lifespan", "find": "p", "replace": "perennial"}],
    "taxonomic_updates": [{"find": "acacia sp", "replace": "Acacia sp. [unknown]", "reason": "x", "taxonomic_resolution": "genus"}],
    "exclude_observations": [{"variable": "taxon_name", "find": "bad one, worse  one", "reason": "wrong"}],
    "questions": None,
}
ROWS = """species,site,plant,area,life,shade,voucher
acacia sp,north,1,2.50,p,s,v1
Banksia  serrata ssp minor,a south,2,7,annual,o,NA
Banksia  serrata ssp minor,a south,2,90,annual,o,
bad one,north,,1,annual,,v9
Daviesia,north,4,NA,weedy,s,v4
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("data")
    (top / "Doe_2020").mkdir()
    (top / "Doe_2020" / "data.csv").write_text(ROWS)
    (top / "Doe_2020" / "metadata.yml").write_text(yaml.safe_dump(PROGRAM))
    long = {**PROGRAM, "dataset": {**PROGRAM["dataset"], "data_is_long_format": True, "trait_name": "what", "value": "how"}, "traits": [{**t, "var_in": v} for t, v in zip(PROGRAM["traits"], ["Area", "Life"])]}
    (top / "Long_2021").mkdir()
    lines = [x.split(",") for x in ROWS.strip().split("\n")]
    table = ["species,site,plant,what,how,shade,voucher"] + [",".join([r[0], r[1], r[2], w, r[k], r[5], r[6]]) for r in lines[1:] for w, k in (("Area", 3), ("Life", 4), ("Other", 4))]
    (top / "Long_2021" / "data.csv").write_text("\n".join(table) + "\n")
    (top / "Long_2021" / "metadata.yml").write_text(yaml.safe_dump(long))
    (top / "empty").mkdir()
    return top


@pytest.fixture(scope="module")
def built(spark, folder):
    taxa = spark.createDataFrame([("Banksia serrata subsp. minor", "Banksia serrata", "species", "accepted")], "aligned_name string, taxon_name string, taxon_rank string, aligned_name_taxonomic_status string")
    return build.build(spark, str(folder), None, DEFINITIONS, CONVERSIONS, taxa=taxa)


def test_wide_and_long_give_the_same_rows(built):
    rows = {d: sorted((r.taxon_name, r.trait_name, r.value, r.unit, r.location_id, r.population_id, r.life_stage, r.treatment_context_id, r.individual_id) for r in built["traits"].filter(F.col("dataset_id") == d).collect()) for d in ("Doe_2020", "Long_2021")}
    key = lambda r: (r[0], r[1], r[2])
    assert [key(r) for r in rows["Doe_2020"]] == [key(r) for r in rows["Long_2021"]]
    area = [r for r in rows["Doe_2020"] if r[1] == "leaf_area"]
    assert [(r[0], r[2], r[3], r[4]) for r in area] == [("Acacia sp. [unknown]", "250", "mm2", "02"), ("Banksia serrata", "700", "mm2", "01")]
    assert [r[6] for r in area] == ["adult", None]
    assert {r[4] for r in rows["Doe_2020"] if r[1] == "lifespan"} == {None}
    assert [r[2] for r in rows["Doe_2020"] if r[1] == "lifespan"] == ["perennial", "annual", "annual"]


def test_errors_and_links(built):
    errors = {(r.taxon_name, r.trait_name): r.error for r in built["excluded_data"].filter("dataset_id = 'Doe_2020'").collect()}
    assert errors["Bad one", "leaf_area"] == rules.EXCLUDED
    assert rules.OUT_OF_RANGE in errors.values() and rules.UNSUPPORTED_VALUE in errors.values() and rules.MISSING_VALUE not in errors.values()
    links = {r.value: (r.link_id, r.link_vals, r.description) for r in built["contexts"].filter("dataset_id = 'Doe_2020'").collect()}
    assert links["shaded"] == ("treatment_context_id", "02", "under cloth") and links["open"][1] == "01"
    assert not [r for r in built["locations"].collect() if r.location_property == "life_stage"]
    assert {(r.identifier_value, r.institution_code) for r in built["identifiers"].collect()} >= {("v1", "HERB")}
    assert [r.last_name for r in built["contributors"].filter("dataset_id = 'Doe_2020'").collect()] == ["Doe"]
    m = built["methods"].filter("dataset_id = 'Doe_2020' and trait_name = 'leaf_area'").first()
    assert m.method_id == "01" and m.source_primary_citation == 'J. Doe and A. Roe. "Leaves".   _Trees_ 3 (2020), pp. 1-2.'
    assert {t.taxon_name: t.taxon_rank for t in built["taxa"].collect()}["Banksia serrata"] == "species"
    for name, columns in database.TABLES.items():
        assert name == "taxa" or built[name].columns == columns


def test_sinks_and_flattening(spark, built, tmp_path):
    src.write_database(built, str(tmp_path / "db"))
    again = src.read_database(spark, str(tmp_path / "db"))
    assert sorted(map(str, again["traits"].collect())) == sorted(map(str, built["traits"].collect()))
    src.write_plaintext(built.with_version("1.0", None), str(tmp_path / "text"))
    assert "- version: 1.0" in (tmp_path / "text" / "build_info.md").read_text() and not (tmp_path / "text" / "identifiers.csv").exists()
    (entry,) = prog.read_bibtex_entries((tmp_path / "text" / "sources.bib").read_text())
    assert entry["key"] == "Doe_2020" and entry["author"] == "J. Doe and A. Roe" and entry["title"] == "Leaves"
    src.write_plaintext(built, str(tmp_path / "small"), one_file=True)
    assert (tmp_path / "small" / "traits.csv").read_text().split("\n")[0] == ",".join(database.TABLES["traits"])
    flat = database.flatten_database(built)
    assert flat.count() == built["traits"].count() and {"location_properties", "treatment_context_properties", "methods"} <= set(flat.columns)


@pytest.mark.parametrize("n, width", [(99, 2), (100, 2), (101, 3)])
def test_pad_width(spark, n, width):
    df = spark.range(n).withColumn("d", F.lit("d"))
    got = [r.x for r in ids.dense_id(df, F.lpad(F.col("id").cast("string"), 4, "0"), "x", ["d"]).orderBy("id").collect()]
    assert got == [str(k + 1).zfill(width) for k in range(n)]


def test_number_text(spark):
    values = {100000.0: "1e+05", 123456.0: "123456", 0.0001: "1e-04", 0.00012: "0.00012", 309.597523219814: "309.597523219814", 1 / 3: "0.333333333333333", -2.5: "-2.5", 0.0: "0", 1e15: "1e+15", 1.5e-7: "1.5e-07", float("inf"): "Inf", 1e100: "1e+100", 90.0: "90"}
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", tx.number_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == values


def test_names_and_composition(spark):
    names = {"acacia ssp minor": "Acacia subsp. minor", "x Banksia spp.": "x Banksia sp.", "A b ss c": "A bc", "A  forma b": "A f. b", "A b s.l.": "A b", "A sp": "A sp."}
    got = {r.x: r.y for r in spark.createDataFrame([(n,) for n in names], "x string").select("x", tx.standardise_name(F.col("x")).alias("y")).collect()}
    assert got == names
    assert rules.compose([("a", "b"), ("b", "c"), ("c", None)]) == {"a": (None, 2), "b": (None, 2), "c": (None, 2)}
    with pytest.raises(ValueError):
        rules.parse_conversion("__import__('os')")


def test_editing_and_validation(spark, folder, tmp_path):
    p = prog.read_program(folder / "Doe_2020" / "metadata.yml")
    p = prog.add_taxonomic_change(p, "b", "c", "r", "species")
    assert [u["find"] for u in p["taxonomic_updates"]] == ["acacia sp", "b"]
    assert prog.find_taxonomic_changes({"x": p}, "b") == ["x"]
    p = prog.remove_taxonomic_change(p, "b")
    assert prog.add_substitution(p, "lifespan", "p", "other") == p
    prog.write_program(p, tmp_path / "m.yml")
    assert prog.read_program(tmp_path / "m.yml") == prog.clean(p)
    assert prog.discover(folder) == ["Doe_2020", "Long_2021"]
    bib = prog.read_bibtex("@article{x, author = {Jane Doe and A. Roe}, year = 2001, title = {On {Leaves}}, doi = {https://doi.org/10.1/x}, url = {u}}")
    source = prog.add_source({}, bib)["source"]["primary"]
    assert source["key"] == "Doe_2001" and source["doi"] == "10.1/x" and "url" not in source
    data = src.read_csv_text(spark, str(folder / "Doe_2020" / "data.csv"))
    found = {n: (ok, d) for n, ok, d in validate.check_program(p, [c for c in data.columns if c != "_row"], DEFINITIONS, data)}
    assert found["locations: all of the data described"][0] and found["exclude_observations: taxon_name in data"] == (False, "worse one")
    broken = {**p, "traits": p["traits"] + [{"var_in": "area", "trait_name": "unheard"}]}
    bad = {n for n, ok, _ in validate.check_program(broken, data.columns, DEFINITIONS) if not ok}
    assert {"traits: in dictionary", "traits: var_in unique", "traits: fields"} <= bad


def test_hook_steps(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, x int")
    out = apply_steps(df, [{"group_id": {"by": ["g"], "name": "i"}}, {"filter": "x > 1"}, {"rename": {"x": "y"}}])
    assert sorted((r.g, r.y, r.i) for r in out.collect()) == [("a", 2, 1), ("b", 3, 2)]
    with pytest.raises(ValueError):
        apply_steps(df, [{"eval": "x"}])


def test_streaming_rows(spark, tmp_path):
    columns = "dataset_id string, taxon_name string, trait_name string, unit_in string, value_type string, value string"
    spark.createDataFrame([("d", "t", "leaf_area", "cm2", "raw", "3"), ("d", "t", "leaf_area", "ha", "raw", "3"), ("e", "t", "lifespan", None, "mode", "P")], columns).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
    out = ingest.harmonise_rows(stream, build.dictionary_frame(spark, DEFINITIONS), CONVERSIONS, [("lifespan", "p", "perennial")])
    ingest.ingest(out, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = sorted((r.value, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("3", rules.NO_CONVERSION), ("300", None), ("perennial", None)]


def test_units_overrides_and_first_maps(spark, folder):
    columns = "trait_name string, value_type string, value string, unit_in string, error string"
    rows = [("lifespan", "mode", "p", "mm", "bad"), ("lifespan", "mode", "annual", "mm", None), ("leaf_area", "raw", "3", "cm2", "bad"), ("leaf_area", "raw", "3", "cm2", None), ("leaf_area", "range", "2--4", "1/mm2", None), ("leaf_area", "raw", "3", "ha", None), ("other", "raw", "3", "ha", "bad")]
    df = rules.with_dictionary(spark.createDataFrame(rows, columns), build.dictionary_frame(spark, DEFINITIONS))
    got = [(r.value, r.unit, r.error) for r in rules.convert_units(df, CONVERSIONS).collect()]
    assert sorted(got, key=str) == sorted([("p", None, "bad"), ("annual", None, None), ("3", "cm2", "bad"), ("300", "mm2", None), ("0.5--0.25", "mm2", None), ("3", "ha", rules.NO_CONVERSION), ("3", "ha", "bad")], key=str)
    taxa = spark.createDataFrame([("a", "z"), ("a", "b")], "aligned_name string, taxon_name string")
    names = spark.createDataFrame([("a",), ("c",)], "taxon_name string")
    assert sorted(r.taxon_name for r in taxonomy.accept_names(names, taxa).collect()) == ["b", "c", "z"]
    data = spark.createDataFrame([("A", "1"), ("B", "2")], "what string, value string")
    maps = [reshape.TraitMap("A", "first"), reshape.TraitMap("A", "second"), reshape.TraitMap("B", None)]
    assert [r.trait_name for r in reshape.map_long(data, maps, "what").collect()] == ["first"]
    # a location's property named like a measurement's value or unit stays a property
    program = {**PROGRAM, "locations": {n: {**p, "unit": "km"} for n, p in PROGRAM["locations"].items()}}
    data = src.canonical_text(src.read_csv_text(spark, str(folder / "Doe_2020" / "data.csv")))
    built = build.process_dataset(spark, "Doe_2020", data, program, DEFINITIONS, CONVERSIONS)
    assert {r.unit for r in built["traits"].collect()} == {"mm2", None}
    assert {r.location_property for r in built["locations"].collect()} == {"latitude (deg)", "longitude (deg)", "unit"}


def test_outline(spark):
    db = database.Database({"taxa": spark.createDataFrame([], "a string, b string"), "none": spark.createDataFrame([], "x int").drop("x")})
    assert database.outline(db) == "taxa\n├── a\n└── b\nnone" and database.tree("t", ["y"], "  ") == ["  t", "  └── y"]


@pytest.mark.parametrize("few", [0, 200_000])
def test_ranks_in_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    data = [("a" if k % 3 else None, k * 7919 % 1000) for k in range(1000)]
    got = ranks.ranked(spark.createDataFrame(data, "g string, x long").repartition(5), ["g"], ["x"], "n", "all").collect()
    for g in ("a", None):
        mine = sorted(x for h, x in data if h == g)
        assert sorted((r.x, r.n, r["all"]) for r in got if r.g == g) == [(x, k + 1, len(mine)) for k, x in enumerate(mine)]
    assert ranks.ranked(spark.createDataFrame([], "g string, x long"), ["g"], ["x"], "n", "all").count() == 0


def test_files_programs_and_schema(spark, folder, tmp_path):
    (tmp_path / "units.csv").write_text("unit_from,unit_to,function\ncm2,mm2,x*100\nC,K,\"x*1\"\n")
    conversions = rules.read_conversions(prog.read_conversion_rows(tmp_path / "units.csv"))
    assert conversions["cm2-mm2"] == rules.parse_conversion("x*100") and list(conversions) == ["cm2-mm2", "C-K"]
    (tmp_path / "s.yml").write_text("metadata: {version: 1.2.3}\ntraits: {elements: {a: 1}}\n")
    assert prog.get_version(tmp_path / "s.yml") == "1.2.3" and prog.get_schema(tmp_path / "s.yml", "traits") == {"elements": {"a": 1}}
    assert prog.git_commit(tmp_path) is None
    prog.set_up(tmp_path)
    assert (tmp_path / "config" / "taxon_list.csv").read_text().startswith("aligned_name,")
    (tmp_path / "m.yml").write_text("dataset:\n  custom_R_code: '\n    one\n      two'\n  collection_date: 2020\n")
    assert prog.read_program(tmp_path / "m.yml")["dataset"]["custom_R_code"] == " '\n    one\n      two'"
    programs, notes = prog.add_substitutions_table({"x": PROGRAM, "y": {}}, [{"d": "x", "t": "lifespan", "f": "p", "r": "q"}, {"d": "y", "t": "lifespan", "f": "a", "r": "b"}], "d", "t", "f", "r")
    assert len(programs["x"]["substitutions"]) == 2 and len(programs["y"]["substitutions"]) == 1 and len(notes) == 1
    with pytest.raises(ValueError):
        prog.add_substitutions_table({}, [{"d": "x"}], "d", "t", "f", "r")
    wide = spark.createDataFrame([("n", "1", "s"), ("n", "1", "o"), (None, "2", "s")], "place string, lat string, shade string")
    assert suggest.add_locations_from({}, wide, "place", ["lat"])["locations"] == {"n": {"lat": "1"}}
    assert [v["find"] for v in suggest.add_contexts_from({}, wide, ["shade"])["contexts"][0]["values"]] == ["o", "s"]
    assert [t["var_in"] for t in suggest.add_traits_from({}, wide, long_column="shade")["traits"]] == ["o", "s"]


def test_folder_and_build_rules(spark, folder, tmp_path):
    assert all(ok for _, ok, _ in validate.check_folder(folder / "Doe_2020"))
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "data.csv").write_text("a,b\n1,2\n3\n")
    (bad / "metadata.yml").write_text("dataset:\n  custom_R_code: x\n  notes: \u4e2d\u00e9\n")
    (bad / "more.txt").write_text("")
    found = {n: d for n, ok, d in validate.check_folder(bad) if not ok}
    assert found == {"folder: nothing else": "more.txt", "metadata: plain text": "line 3", "dataset: custom step before collection_date": "notes", "data: rows are as long as the header": "row 2"}
    df = spark.createDataFrame([("1",)], "x string")
    assert validate.check_custom_step(df, [{"with": {"y": "x + 1"}}])[1] and not validate.check_custom_step(df, [{"with": {"y": "nothing + 1"}}])[1]
    make = lambda p: lambda: build.process_dataset(spark, "Doe_2020", src.canonical_text(src.read_csv_text(spark, str(folder / "Doe_2020" / "data.csv"))), p, DEFINITIONS, CONVERSIONS)
    assert {n for n, ok, _ in validate.check_build(make(PROGRAM)) if not ok} <= {"build: pivots without duplicates"}
    assert validate.check_build(lambda: 1 / 0)[0][:2] == ("build: works", False)
    wrong = {**PROGRAM, "traits": [{**PROGRAM["traits"][0], "entity_type": "pebble", "basis_of_value": "life"}], "dataset": {**PROGRAM["dataset"], "basis_of_record": "field moon", "extra": 1}}
    data = src.read_csv_text(spark, str(folder / "Doe_2020" / "data.csv"))
    names = {(r.rule, r.value) for r in validate.failures(wrong, data, DEFINITIONS).collect()}
    assert {("traits: entity_type in vocabulary", "pebble"), ("dataset: basis_of_record in vocabulary", "moon"), ("dataset: fields", "extra"), ("vocabulary: basis_of_value in data", "annual"), ("vocabulary: basis_of_value in data", "weedy")} <= names


def test_unsupported_bytes(spark):
    got = {r.x: r.p for r in spark.createDataFrame([("abc",), ("caf\u00e9",), ("a\u4e2d",), ("",), (None,)], "x string").select("x", tx.unsupported_bytes(F.col("x")).alias("p")).collect()}
    allowed = set(tx.EXCEPTION_LETTERS.encode())
    assert got["abc"] == got["caf\u00e9"] == got[""] == [] and got[None] is None
    assert got["a\u4e2d"] == [k + 1 for k, b in enumerate("a\u4e2d".encode()) if b >= 0x7F and b not in allowed]


SMALL = ["standardise_names", "context_links", "observation_id", "repeat_measurements_id", "error_lattice", "unit_conversion_range", "triples", "report_share"]


@pytest.mark.parametrize("name", SMALL)
def test_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = catalogue.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect()))) == sorted(map(str, want))


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalogue.queries()) == set(catalogue.oracle_sql())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
