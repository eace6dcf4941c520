import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stocktake.functions import hashing, names, paths
from stocktake.functions.similarity import jaro_winkler
from stocktake.operators import delta, election, plan
from stocktake.schema import GAMES


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, codes", [("Game (France, Germany)", "FR-DE"), ("Game (World)", "US-JP-EU"), ("Game (USA, Europe) (Rev 1)", "US-EU"), ("Game", ""), ("Game (Beta)", "")])
def test_regions(spark, name, codes):
    assert one(spark, names.region_codes(F.col("n")), n=name) == codes


def test_name_parts(spark):
    name = "Some Game (Japan) (En,Fr,De) (Rev 2) (Beta 1) (Virtual Console, Unl) (Disc 1)"
    assert one(spark, names.languages(F.col("n")), n=name) == ["En", "Fr", "De"]
    assert one(spark, names.version(F.col("n")), n=name) == "2"
    assert one(spark, names.releases(F.col("n")), n=name) == ["Beta"]
    assert one(spark, names.flag_parts(F.col("n")), n=name) == ["Virtual Console", "Unl"]
    assert one(spark, names.title(F.col("n")), n=name) == "Some Game"


def test_crc_and_magic(spark):
    assert one(spark, hashing.crc32(F.col("c")), c=bytearray(b"hello")) == f"{zlib.crc32(b'hello'):08x}"
    assert one(spark, hashing.sniffed(F.col("c"), F.lit("a/b.BIN")), c=bytearray(b"MComprHDxx")) == "chd"
    assert one(spark, hashing.sniffed(F.col("c"), F.lit("a/b.BIN")), c=bytearray(b"??")) == "bin"
    rules = F.array(F.struct(F.lit(2).cast("bigint").alias("start_byte"), F.lit("4E45").alias("hex_value")))
    assert one(spark, F.md5(hashing.behind_header(F.col("c"), F.lit(4), rules)), c=bytearray(b"..NErest")) == hashlib.md5(b"rest").hexdigest()


def test_paths(spark):
    assert one(spark, paths.stem(F.col("p")), p="a/b.c.d") == "b.c" and one(spark, paths.stem(F.col("p")), p="a/.hidden") == ".hidden"
    assert one(spark, paths.alpha_folder(F.col("p")), p="game") == "G" and one(spark, paths.alpha_folder(F.col("p")), p="42") == "#"
    assert one(spark, paths.frames(F.lit(0), F.lit(3), F.lit(6)), x=1) == 231


def test_jaro_winkler():
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert jaro_winkler("", "x") == 0 and jaro_winkler("a", "a") == 1


def _family(spark, rows):
    return spark.createDataFrame([(i, n, n, None, None, False, False, False, r, 0, c, 1, p, None, None) for i, n, r, c, p in rows], GAMES)


def test_election(spark):
    games = _family(spark, [(1, "G (USA)", "US", 0, None), (2, "G (Europe)", "EU", 2, 1), (3, "G (USA) (Rev 1)", "US", 2, 1), (4, "G (Japan) (Beta)", "JP", 2, 1)])
    prefer = election.Preferences(versions="new", one_regions=("US", "EU"), all_regions=("JP",))
    got = {r.id: r.sorting for r in election.sorted_games(games, prefer).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 0}
    places = {r.id: r.place for r in election.ranked(games, election.Preferences(versions="old")).collect()}
    assert places[3] == 3
    trimmed = election.sorted_games(games, election.Preferences(one_regions=("JP",), all_regions=("ZZ",), ignored_releases=("Beta",)))
    assert {r.id: r.sorting for r in trimmed.collect()} == {1: 0, 2: 0, 3: 0, 4: 2}


def test_large_families_rank_without_a_comparator(spark):
    games = _family(spark, [(1, "G", "US", 0, None), *[(k, f"G (Rev {k % 7})", "US-EU" if k % 3 else "US", 0, 1) for k in range(2, 80)]])
    places = sorted(r.place for r in election.ranked(games, election.Preferences(regions="broad", versions="new", parents=True)).collect())
    assert places == list(range(79))


def test_gdi_fold(spark):
    tracks = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(a).alias("audio"), F.lit(f"t{n}").alias("stem"), F.lit(s).cast("bigint").alias("sectors"), F.lit(150).cast("bigint").alias("gap"), F.lit(i).alias("indices"), F.lit(d).alias("dense")) for n, a, s, i, d in ((1, False, 600, 1, False), (2, True, 700, 2, True), (3, False, 9, 1, False))])
    assert one(spark, plan.gdi_lines(tracks), x=1) == ["3", '1 0 4 2352 "t1.bin" 0', '2 750 0 2352 "t2.raw" 0', '3 45000 4 2352 "t3.bin" 0']


def test_snapshots(spark, tmp_path):
    from stocktake import state

    root = str(tmp_path)
    first = state.commit({"t": spark.range(3)}, root)
    state.commit({"t": spark.range(5)}, root)
    assert state.load(spark, root, "t").count() == 5 and state.load(spark, root, "t", first).count() == 3


def test_inserted_ids_continue(spark):
    old, new = spark.range(1, 4), spark.createDataFrame([("b",), ("a",), ("c",)], "path string")
    got = {r.path: r.id for r in delta.inserted(old, new, ["path"]).collect()}
    assert got == {"a": 4, "b": 5, "c": 6}
