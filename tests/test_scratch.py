import os

from pyspark.sql import functions as F

from stocktake.operators import imports as i
from stocktake.plans import registry
from stocktake.state import settle


def _size(top, *names):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, files in os.walk(top) for x in files if not names or x.startswith(names))


def test_settling_leaves_no_shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    before = {f"{d}/{x}" for top in dirs for d, _, files in os.walk(top) for x in files if x.startswith("shuffle_")}
    settle(spark.range(1000).repartition(F.col("id") % 7), "tidy")
    after = {f"{d}/{x}" for top in dirs for d, _, files in os.walk(top) for x in files if x.startswith("shuffle_")}
    assert not after - before


def test_imports_leave_little_behind(spark, sf):
    """What stays written once a result is made is less than ten times what is read."""
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    read = sum(os.path.getsize(f"{sf}/{t}.parquet") for t in ("customer", "orders", "lineitem"))
    before = _size(top, "part-")
    registry.queries()["m4_members"](spark, sf)
    assert _size(top, "part-") - before < 10 * read


def test_hot_contents_are_shared_out(spark, monkeypatch):
    """The k-th member takes the k-th item, whether a content is in one task or numbered over many."""
    roms = spark.range(1, 41).selectExpr("id", "concat('r', id, '.bin') as name", "4L as size", "'aa' as crc", "null::string as md5", "null::string as sha1", "id as game_id", "null::bigint as romfile_id", "null::bigint as parent_id")
    roms = roms.withColumn("game_id", F.ceil(F.col("id") / 2))
    games = spark.range(1, 21).selectExpr("id", "concat('G', id) as name", "false as jbfolder", "1L as system_id")
    systems = spark.createDataFrame([(1, "Sys", None, False)], "id bigint, name string, custom_name string, arcade boolean")
    members = spark.range(50).selectExpr("concat('a', lpad(id, 2, '0'), '.zip') as archive", "'m' as member", "4L as size", "'AA' as crc", "null::string as md5", "null::string as sha1")
    want = [(f"a{k:02d}.zip", k + 1 if k < 40 else None, "valid" if k < 40 else "duplicate") for k in range(50)]
    for lots in (20_000, 10):
        monkeypatch.setattr(i, "LOTS", lots)
        got = sorted((r.archive, r.rom, r.state) for r in i.import_archives(members, roms, games, systems)[1].collect())
        assert got == want
