"""Programs made from a schema, and datasets that arrive in a stream."""

import pytest
from pyspark.sql import functions as F

from fieldloom.plans import compilation, database
from fieldloom.sources import tables as src
from fieldloom.sources import template
from fieldloom.streaming import ingest

from .test_compilation import rows_of
from .test_harmonise import CONVERSIONS, DEFINITIONS, PROGRAM, ROWS

SCHEMA = {"metadata": {"type": "list", "elements": {
    "source": {"values": {"primary": {"values": {"key": "k", "year": "y", "isbn": "i"}}, "secondary": {"values": {"key": "k"}}}},
    "contributors": {"type": "array", "elements": {"data_collectors": {"elements": {"last_name": "l", "ORCID": "o"}}, "dataset_curators": {"description": "d"}}},
    "dataset": {"values": {f: "about" for f in ["data_is_long_format", "custom_R_code", "collection_date", "taxon_name", "trait_name", "value", "location_name", "individual_id", "description", "notes", "life_stage", "plot_context_id", "observation_id", "replicates"]}},
    "locations": {"values": {"latitude (deg)": "x"}}, "traits": {"elements": {"var_in": "v"}}, "questions": {"values": {"q": "x"}},
}}}


def test_template_follows_the_schema():
    got = template.template_from_schema(SCHEMA, "Doe_2020", ["species", "what", "how"], {"data_is_long_format": True, "taxon_name": "species", "trait_name": "what", "value": "how"})
    assert list(got) == ["source", "contributors", "dataset", "locations", "traits", "questions"]
    assert got["source"] == {"primary": {"key": "Doe_2020", "year": "unknown", "isbn": "unknown"}}
    assert got["contributors"] == {"data_collectors": [{"last_name": "unknown", "ORCID": "unknown"}], "dataset_curators": "unknown"}
    assert got["dataset"] == {"data_is_long_format": True, "custom_R_code": None, "collection_date": "unknown", "taxon_name": "species", "trait_name": "what", "value": "how", "description": "unknown", "life_stage": "unknown", "notes": "unknown"}
    assert got["locations"] is None and got["traits"] is None
    # a field, a part of a source and a section that the schema gains
    schema = {"metadata": {"elements": {**SCHEMA["metadata"]["elements"], "source": {"values": {"primary": {"values": {"key": "k", "archive": "a"}}}}, "dataset": {"values": {**SCHEMA["metadata"]["elements"]["dataset"]["values"], "depth": "new"}}, "funding": {"elements": {"grant": "g"}}}}}
    more = template.template_from_schema(schema, "D", ["species"], {"taxon_name": "species"})
    assert more["dataset"]["depth"] == "unknown" and more["source"]["primary"] == {"key": "D", "archive": "unknown"} and more["funding"] == {"grant": "unknown"}
    assert "trait_name" not in more["dataset"] and "observation_id" not in more["dataset"]
    with pytest.raises(ValueError, match="taxon_name: nothing"):
        template.template_from_schema(SCHEMA, "D", ["species"], {"taxon_name": "nothing"})


def test_datasets_of_a_stream(spark, tmp_path):
    names = ROWS.split("\n")[0].split(",")
    lines = [dict(zip(names, [x if x not in ("", "NA") else None for x in r.split(",")])) for r in ROWS.strip().split("\n")[1:]]
    schema = "dataset_id string, _row long, cells map<string,string>"
    parts = [[("a", 1, lines[0]), ("a", 2, lines[1]), ("b", 1, lines[2])], [("b", 2, lines[3]), ("c", 1, lines[4]), ("none", 1, lines[0])], [("a", 3, lines[4])]]
    programs, columns = dict.fromkeys("abc", PROGRAM), dict.fromkeys("abc", names)

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.build_batches(stream, columns, programs, str(tmp_path / "db"), str(tmp_path / "check"), DEFINITIONS, CONVERSIONS).awaitTermination(300)

    for part in parts[:2]:
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    spark.createDataFrame(parts[2], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    every = spark.createDataFrame([r for p in parts for r in p if r[0] != "none"], schema)
    whole = compilation.compile_datasets(spark, every, columns, programs, DEFINITIONS, CONVERSIONS)
    for name in database.TABLES:
        if name != "taxa":
            assert rows_of(src.read_database(spark, str(tmp_path / "db")), name) == rows_of({name: whole[name]}, name), name
    # a batch that is replayed: its rows and the datasets stay as they are
    before = sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "db").glob("traits/*/*.parquet"))
    kept = spark.read.parquet(str(tmp_path / "db" / "_rows")).count()
    log = tmp_path / "check" / "commits"
    for p in [*log.glob("2"), *log.glob(".2.crc")]:
        p.unlink()
    run()
    assert sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "db").glob("traits/*/*.parquet")) == before
    assert spark.read.parquet(str(tmp_path / "db" / "_rows")).count() == kept == 7
