from stocktake import schema
from stocktake.operators import imports as i

EMPTY = {"patches": schema.PATCHES, "headers": schema.HEADERS, "rules": schema.RULES}
ITEM = "system string, game string, name string, size bigint, crc string, md5 string, sha1 string, rom_status string"
ENTRY = "system string, name string, description string, bios boolean, cloneof string, romof string"


def state_of(spark):
    systems = spark.createDataFrame([(1, "A", "1")], "id bigint, name string, version string")
    games = spark.createDataFrame([(1, "kept", 1, None, None), (2, "gone", 1, None, None), (3, "clone", 1, 2, None)], "id bigint, name string, system_id bigint, parent_id bigint, playlist_id bigint")
    games = games.selectExpr("*", "'' as description", "false as bios")
    roms = spark.createDataFrame(
        [(1, "a", 1, 10, 1, "aa"), (2, "b", 1, 20, 2, "bb"), (3, "c", 2, 30, 3, "cc"), (4, "d", 3, 40, None, "dd")], "id bigint, name string, game_id bigint, size bigint, romfile_id bigint, crc string"
    ).selectExpr("*", "cast(null as bigint) as parent_id", "cast(null as string) as md5", "cast(null as string) as sha1", "cast(null as string) as rom_status")
    files = spark.createDataFrame([(k, f"A/f{k}.bin", 10 * k, None, 0) for k in (1, 2, 3)], schema.ROMFILES)
    return {"systems": systems, "games": games, "roms": roms, "romfiles": files} | {n: spark.createDataFrame([], s) for n, s in EMPTY.items()}


def offer(spark, version="2"):
    entries = [("A", "kept", "", False, None, None), ("A", "clone", "", False, "kept", None), ("B", "first", "", False, None, None)]
    items = [("A", "kept", "a", 10, "AA", None, None, None), ("A", "kept", "b", 21, "bc", None, None, None), ("A", "clone", "e", 30, "cc", None, None, None), ("B", "first", "x", 1, None, None, None, None)]
    return spark.createDataFrame([("A", version), ("B", "1")], "name string, version string"), spark.createDataFrame(entries, ENTRY), spark.createDataFrame(items, ITEM)


def test_a_new_version_changes_entries_and_items(spark):
    new, orphans = i.import_catalogues(state_of(spark), *offer(spark))
    assert sorted((r.name, r.version) for r in new["systems"].collect()) == [("A", "2"), ("B", "1")]
    names = {r.id: (r.name, r.parent_id) for r in new["games"].collect()}
    assert sorted(n for n, _ in names.values()) == ["clone", "first", "kept"] and [p for n, p in names.values() if n == "clone"] == [1]
    got = sorted((names[r.game_id][0], r["name"], r["size"], r.romfile_id) for r in new["roms"].collect())
    assert got == [("clone", "e", 30, None), ("first", "x", 1, None), ("kept", "a", 10, 1), ("kept", "b", 21, None)]
    assert sorted(r.romfile_id for r in orphans.collect()) == [2, 3]
    digests = spark.createDataFrame([(k, 10 * k, c, None, None) for k, c in ((1, "aa"), (2, "bb"), (3, "cc"))], "id bigint, size bigint, crc string, md5 string, sha1 string")
    last = i.reimport_orphans(new, orphans, digests)
    assert {r.id: r.path for r in last["romfiles"].collect()} == {1: "A/f1.bin", 2: "Trash/f2.bin", 3: "A/f3.bin"}
    assert sorted((r["name"], r.romfile_id) for r in last["roms"].where("romfile_id is not null").collect()) == [("a", 1), ("e", 3)]


def test_the_same_version_changes_nothing_unless_forced(spark):
    new, orphans = i.import_catalogues(state_of(spark), *offer(spark, "1"))
    assert orphans.isEmpty() and new["roms"].where("game_id <= 3").count() == 4
    forced, orphans = i.import_catalogues(state_of(spark), *offer(spark, "1"), force=True)
    assert orphans.count() == 2 and forced["roms"].count() == 4


def test_files_take_items_by_their_first_known_checksum(spark):
    roms = spark.createDataFrame(
        [(1, 5, "aa", "m1", None), (2, 5, "aa", None, None), (3, 6, None, "m3", 9)], "id bigint, size bigint, crc string, md5 string, romfile_id bigint"
    ).selectExpr("*", "0L as game_id", "'n' as name", "cast(null as bigint) as parent_id", "cast(null as string) as sha1")
    files = spark.createDataFrame([(1, 5, "AA", "zz"), (2, 5, "aa", None), (3, 5, "aa", None), (4, 6, "q", "M3"), (5, 7, None, None)], "file bigint, size bigint, crc string, md5 string").selectExpr("*", "cast(null as string) as sha1")
    got = {r.file: (r.rom, r.algorithm, r.state) for r in i.import_files(files, roms).collect()}
    assert got == {1: (1, "crc", "valid"), 2: (2, "crc", "valid"), 3: (None, "crc", "duplicate"), 4: (None, "md5", "duplicate"), 5: (None, None, "invalid")}
