"""Corrupt rows of files, and builds that are run stage by stage."""

import csv
import io

import pytest

from fieldloom.plans import validate
from fieldloom.sources import tables as src

from .test_harmonise import CONVERSIONS, DEFINITIONS, PROGRAM, ROWS


def plain(text):
    rows = list(csv.reader(io.StringIO(text)))
    return [n + 1 for n, r in enumerate(rows[1:]) if len(r) != len(rows[0])]


def test_corrupt_rows_over_many_files(spark, tmp_path):
    want = {}
    for k in range(12):
        lines = [f"{j},b{j},c" + (",extra" if (j + k) % 17 == 0 else "") if (j + k) % 23 else f"{j}" for j in range(1, 200)]
        text = "a,b,c\n" + "\n".join(lines) + "\n"
        (tmp_path / f"part{k}.csv").write_text(text)
        want[f"part{k}.csv"] = plain(text)
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = src.corrupt_rows(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        found = {name: sorted(r.row for r in got if r.file.endswith(f"/{name}")) for name in want}
        assert found == want
        assert all(("extra" in r.record) or "," not in r.record for r in got)


def test_corrupt_rows_of_quoted_and_empty_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x\ny",1\n"u ""v"" w",2,3\n,\n')
    got = src.corrupt_rows(spark, str(tmp_path / "q.csv"), multi_line=True).collect()
    assert [(r.row, r.record.strip()) for r in got] == [(2, '"u ""v"" w",2,3')]
    (tmp_path / "none.csv").write_text("a,b\n")
    assert src.corrupt_rows(spark, str(tmp_path / "none.csv")).count() == 0


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages") / "data.csv"
    path.write_text(ROWS + "Café,north,9,3,née,s,v2\n")
    return src.canonical_text(src.read_csv_text(spark, str(path)))


def stages(data, program, **more):
    out = validate.check_stages("d", data, program, more.pop("definitions", DEFINITIONS), CONVERSIONS, **more)
    return {name.removeprefix("build: ").removesuffix(" runs"): (ok, detail) for name, ok, detail in out}


def test_all_stages_run(data):
    program = {**PROGRAM, "exclude_observations": [*PROGRAM["exclude_observations"], {"variable": "leaf_area", "find": "90, 91", "reason": "r"}, {"variable": "lifespan", "find": "née", "reason": "r"}]}
    found = stages(data, program)
    assert all(found[s] == (True, "") for s in validate.STAGES)
    assert found["parsed: values are plain text"] == (False, "lifespan née")
    assert found["parsed: exclusions are in the data"] == (False, "leaf_area 91, taxon_name worse one")
    assert found["traits not empty"][0] and found["tables and columns"][0]


def test_a_failing_stage_is_the_finding(data):
    lost = {**PROGRAM, "traits": [{**PROGRAM["traits"][0], "var_in": "not there"}]}
    found = stages(data, lost)
    assert found["configure"][0] and not found["parse"][0] and "not there" in found["parse"][1]
    assert found["process"] == (False, "not run, as parse failed") and found["taxonomy"] == (False, "not run, as parse failed") and len(found) == 4
    found = stages(data, PROGRAM, hook=lambda df: df.select("nothing"))
    assert not found["configure"][0] and found["parse"][1] == "not run, as configure failed"
    found = stages(data, PROGRAM, definitions={**DEFINITIONS, "leaf_area": {"type": "numeric", "allowed_values_min": "low"}})
    assert not found["configure"][0]
    found = stages(data, PROGRAM, taxa=data.select("species"))
    assert found["process"][0] and not found["taxonomy"][0]
