import pytest

from stocktake.operators import imports as i


@pytest.mark.parametrize("lots", [20_000, 0])
def test_files_of_a_content_take_its_items(spark, monkeypatch, lots):
    """Items of the same path first, the rest in order, whether a content is in one task or numbered over many."""
    monkeypatch.setattr(i, "LOTS", lots)
    rows = [(-1, i.ANCHOR, 1, "a", 1, None, 100), (1, "x", 4, "m", 1, None, 100), (2, "y", 4, "m", 1, None, 100), (3, "z", 4, "m", 1, None, 100), (4, "p", 4, "m", 1, 9, 100)]
    roms = spark.createDataFrame(rows, "id bigint, name string, size bigint, md5 string, game_id bigint, romfile_id bigint, parent_id bigint")
    games = spark.createDataFrame([(1, "G", 1)], "id bigint, name string, system_id bigint")
    systems = spark.createDataFrame([(1, "S", None)], "id bigint, name string, custom_name string")
    files = spark.createDataFrame([("f", i.ANCHOR, 1, "A"), *[("f", p, 4, "M") for p in "yabc"], ("g", "y", 4, "m")], "folder string, path string, size bigint, md5 string")
    got = {(r.folder, r.path): (r.rom, r.state, r.target) for r in i.import_folders(files, roms, games, systems).collect()}
    assert got == {("f", i.ANCHOR): (-1, "valid", f"S/G/{i.ANCHOR}"), ("f", "y"): (2, "valid", "S/G/y"), ("f", "a"): (1, "valid", "S/G/x"), ("f", "b"): (3, "valid", "S/G/z"), ("f", "c"): (None, "duplicate", None), ("g", "y"): (None, "invalid", None)}
