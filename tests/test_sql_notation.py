"""Queries equal their SQL where the rules' notation of a number (1e+05) isn't that of SQL's ``%.15g`` (100000)."""

import duckdb

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def differing(spark, folder, name, **changed):
    """Rows that a query's result and its SQL's don't share, over small tables with some numbers changed."""
    sql, out = duckdb.connect(), f"{folder}/out"
    for table in ("region", "orders", "lineitem"):
        numbers = f"REPLACE ({changed[table]})" if table in changed else ""
        sql.execute(f"COPY (SELECT * {numbers} FROM '{SMALL}/{table}.parquet') TO '{folder}/{table}.parquet'")
        sql.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    df.write.parquet(out)
    columns = ", ".join(df.columns)
    ours, theirs = f"SELECT {columns} FROM '{out}/*.parquet'", f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})"
    return sql.execute(f"({ours} EXCEPT ALL {theirs}) UNION ALL ({theirs} EXCEPT ALL {ours})").fetchall()


def test_incremental_build_writes_numbers_as_its_sql(spark, tmp_path):
    totals = "CASE o_orderkey % 9 WHEN 0 THEN 100000 WHEN 1 THEN 400000 WHEN 2 THEN 1e7 ELSE o_totalprice END AS o_totalprice"
    assert differing(spark, tmp_path, "incremental_build", orders=totals) == []


def test_pipeline_end_to_end_writes_numbers_as_its_sql(spark, tmp_path):
    prices = "CASE l_orderkey % 9 WHEN 0 THEN 100000 WHEN 1 THEN 3e6 ELSE l_extendedprice END AS l_extendedprice, CASE l_orderkey % 7 WHEN 0 THEN 100 ELSE l_quantity END AS l_quantity"
    assert differing(spark, tmp_path, "pipeline_end_to_end", lineitem=f"{prices}, CASE l_orderkey % 5 WHEN 0 THEN 1e-6 ELSE l_discount END AS l_discount") == []


def test_unit_columns_writes_numbers_as_its_sql(spark, tmp_path):
    prices = "CASE l_orderkey % 9 WHEN 0 THEN 100000 WHEN 1 THEN 3e6 WHEN 2 THEN 1e15 WHEN 3 THEN 1e-4 ELSE l_extendedprice END AS l_extendedprice"
    assert differing(spark, tmp_path, "unit_columns", lineitem=f"{prices}, CASE l_orderkey % 7 WHEN 0 THEN 100 ELSE l_quantity END AS l_quantity") == []


def test_wide_to_long_writes_numbers_as_its_sql(spark, tmp_path):
    prices = "CASE l_orderkey % 9 WHEN 0 THEN 100000 WHEN 1 THEN 3e6 WHEN 2 THEN 1e15 WHEN 3 THEN 123456789012345678 WHEN 4 THEN 1e-5 ELSE l_extendedprice END AS l_extendedprice"
    discounts = "CASE l_orderkey % 7 WHEN 0 THEN 1e-4 WHEN 1 THEN -2e5 ELSE l_discount END AS l_discount"
    assert differing(spark, tmp_path, "wide_to_long", lineitem=f"{prices}, {discounts}") == []
