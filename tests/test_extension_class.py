import duckdb

from stocktake.operators import plan
from stocktake.plans import registry


def test_archives_are_one_class(spark):
    rows = spark.createDataFrame([("7Z",), ("zip",), ("chd",), ("rom",), ("",)], "e string")
    assert [r.c for r in rows.select(plan.extension_class(rows.e).alias("c")).collect()] == ["archive", "archive", "chd", "other", "other"]


def test_classes_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = registry.queries()["s8_extension_class"](spark, sf).select("id", "class").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracle_sql()["s8_extension_class"]).fetchall())
