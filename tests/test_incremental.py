"""Updates build only what has changed."""

from pathlib import Path

import yaml

from fieldloom.plans import build, compilation, database, incremental
from fieldloom.sources import program as prog
from fieldloom.sources import tables as src

from .test_compilation import rows_of, taxa, variants  # noqa: F401
from .test_harmonise import CONVERSIONS, DEFINITIONS


def stamps(path):
    """When each partition's files were written."""
    out = {}
    for p in Path(path).glob("*/dataset_id=*/*.parquet"):
        out.setdefault(p.parent.name.split("=")[1], set()).add((str(p), p.stat().st_mtime_ns))
    return out


def test_one_program_rewrites_one_partition(spark, tmp_path, taxa):  # noqa: F811
    folder, path = tmp_path / "data", str(tmp_path / "db")
    folder.mkdir()
    variants(folder, 6)
    go = lambda: incremental.update_folder(spark, str(folder), path, DEFINITIONS, CONVERSIONS, taxa=taxa)
    every = [f"D{k:03d}" for k in range(6)]
    assert go() == incremental.Changes(every, [], [])
    first = stamps(path)
    assert go() == incremental.Changes([], [], every) and stamps(path) == first

    program = prog.read_program(folder / "D002" / "metadata.yml")
    program["contexts"], program["dataset"]["collection_date"] = None, "1999"
    (folder / "D002" / "metadata.yml").write_text(yaml.safe_dump(program))
    with open(folder / "D004" / "data.csv", "a") as f:
        f.write("Acacia new,north,7,8,annual,o,v7\n")
    for p in (folder / "D005").iterdir():
        p.unlink()
    assert go() == incremental.Changes(["D002", "D004"], ["D005"], ["D000", "D001", "D003"])
    after = stamps(path)
    assert {d for d in first if after.get(d) != first[d]} == {"D002", "D004", "D005"} and "D005" not in after
    now = src.read_database(spark, path)
    whole = compilation.build_many(spark, str(folder), None, DEFINITIONS, CONVERSIONS, taxa=taxa)
    for name in database.TABLES:
        if name != "taxa":
            assert rows_of(now, name) == rows_of({name: whole[name]}, name), name
    assert sorted(r.taxon_name for r in now["taxa"].collect()) == sorted(r.taxon_name for r in whole["taxa"].collect())
    assert not now["contexts"].filter("dataset_id = 'D002'").count()


def test_what_counts_as_a_change(spark):
    rows = spark.createDataFrame([("a", 1, {"x": "1"}), ("a", 2, {"x": None}), ("b", 1, {"x": "1"})], "dataset_id string, _row long, cells map<string,string>")
    programs, columns = {"a": {"dataset": {}}, "b": {"dataset": {}}, "empty": {}}, {"a": ["x"], "b": ["x"]}
    of = lambda r=rows, p=programs, d=DEFINITIONS, t=None: incremental.fingerprints(r, columns, p, d, CONVERSIONS, None, t)
    base = of()
    assert of(rows.repartition(3)) == base and len(set(base.values())) == 3
    other = of(spark.createDataFrame([("a", 2, {"x": "1"}), ("a", 1, {"x": None}), ("b", 1, {"x": "1"})], rows.schema))
    assert other["a"] != base["a"] and other["b"] == base["b"]
    assert of(p={**programs, "b": {"dataset": {"x": 1}}})["a"] == base["a"] and of(p={**programs, "b": {"dataset": {"x": 1}}})["b"] != base["b"]
    assert not set(of(d={}).values()) & set(base.values()) and not set(of(t=rows.select("dataset_id")).values()) & set(base.values())
    assert build.vocabulary({})
