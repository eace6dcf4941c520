from stocktake.operators import discs as d
from stocktake.operators import plan as p
from stocktake.operators import settings as s


def test_package_listing(spark):
    lines = ["Title version: 0x0410", "Content id: 0000000A", "  Content size: 0x1F00", "noise", "Content id: 0000000b", "Content size: 10"]
    rows = spark.createDataFrame([("p", k, x) for k, x in enumerate(lines)] + [("q", 0, "nothing")], "package string, number int, line string")
    assert sorted(map(tuple, d.package_members(rows).collect())) == [("p", "0000000a", 7936), ("p", "0000000b", 16), ("p", "tmd.1040", None)]


def _actions(spark, target, matrix, paths, names=None, children=(), **how):
    games = spark.createDataFrame([(1,)], "id bigint")
    roms = spark.createDataFrame([(k, 1, k, n) for k, n in enumerate(names or paths)], "id bigint, game_id bigint, romfile_id bigint, name string")
    files = spark.createDataFrame([(k, x, None) for k, x in enumerate(paths)] + [(100 + k, "x", c) for k, c in enumerate(children)], "id bigint, path string, parent_id bigint")
    return [r.action for r in p.planned(p.game_classes(games, roms, files), target, matrix, **how).collect()]


def test_archives_of_the_wanted_type_stay(spark):
    assert _actions(spark, "ZIP", p.CONVERT, ["a.zip"]) == [] and _actions(spark, "ZIP", p.CONVERT, ["a.zip"], recompress=True) == ["recompress"]
    assert _actions(spark, "7Z", p.CONVERT, ["a.zip"]) == ["rearchive"] and _actions(spark, "ZIP", p.EXPORT, ["a.zip"]) == ["copy"]


def test_each_target_has_its_own_order(spark):
    assert _actions(spark, "ZIP", p.CONVERT, ["a.zip", "a.chd"]) == ["archive decoded"] and _actions(spark, "CHD", p.CONVERT, ["a.zip", "a.chd"]) == ["encode extracted"]


def test_guards(spark):
    assert _actions(spark, "CSO", p.CONVERT, ["a.chd"], ["a.iso"]) == ["encode decoded"]
    assert _actions(spark, "CSO", p.CONVERT, ["a.chd", "a.chd"], ["a.bin", "a.cue"]) == [] and _actions(spark, "CSO", p.CONVERT, ["a.chd"], ["a.iso"], children=[0]) == []
    assert _actions(spark, "ISO", p.EXPORT, ["a.cue", "a.bin"]) == ["encode"] and _actions(spark, "ISO", p.EXPORT, ["a.cue", "a.bin", "b.bin"]) == []


def test_settings(spark):
    rows = spark.createDataFrame([(1, "LIST", "b|a"), (2, "FLAG", "true"), (3, "N", "9"), (4, "M", None)], "id bigint, key string, value string")
    value = lambda df, key: df.where(f"key = '{key}'").first()["value"]
    assert value(s.add_to_list(rows, "LIST", "a"), "LIST") == "a|b" and value(s.add_to_list(rows, "M", "x"), "M") == "x"
    assert value(s.remove_from_list(s.remove_from_list(rows, "LIST", "a"), "LIST", "b"), "LIST") is None
    assert [tuple(r) for r in s.invalid(rows, {"LIST": ["a"]}, {"N": (1, 8), "M": (1, 2)}).orderBy("key").collect()] == [("LIST", "b|a"), ("N", "9")]
