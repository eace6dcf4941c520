import gzip
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from stocktake.functions import names
from stocktake.operators import imports as i
from stocktake.operators import settings as s
from stocktake.sources import catalog_xml, cue, delivery, ird

SECTOR = ird.SECTOR


def record(name: bytes, location: int, size: int, folder: bool = False) -> bytes:
    body = struct.pack("<BIIIIxxxxxxxB", 0, location, 0, size, 0, 2 if folder else 0) + b"\0" * 6 + bytes([len(name)]) + name
    body += b"\0" * ((len(body) + 1) % 2)
    return bytes([len(body) + 1]) + body


def image() -> bytes:
    sub = record(b"\0", 19, SECTOR, True) + record(b"\1", 18, SECTOR, True) + record(b"IN.BIN;1", 40, 7)
    root = record(b"\0", 18, SECTOR, True) + record(b"\1", 18, SECTOR, True) + record(b"BIG.BIN;1", 30, 100) + record(b"BIG.BIN;1", 31, 5) + record(b"DIR", 19, SECTOR, True)
    head = b"\1CD001\1" + b"\0" * 149 + record(b"\0", 18, SECTOR, True)
    pad = lambda b: b.ljust(SECTOR, b"\0")
    return b"\0" * (16 * SECTOR) + pad(head) + pad(b"") + pad(root) + pad(sub)


def listing(hashes, cut=0) -> bytes:
    header = gzip.compress(image())
    data = b"3IRD\x09ABCD12345" + bytes([4]) + b"Name" + b"4.0001.0001.00" + struct.pack("<I", len(header)) + header + struct.pack("<I", 2) + b"zz" + bytes([1]) + b"\xaa" * 16
    data += struct.pack("<I", len(hashes)) + b"".join(struct.pack("<Q", at) + md5 for at, md5 in hashes)
    return data[: len(data) - cut]


def test_listings(spark):
    whole = listing([(30, b"\1" * 16), (40, b"\2" * 16)])
    rows = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(gzip.compress(whole))), ("c", bytearray(whole[:-3])), ("d", None), ("e", bytearray(b""))], "path string, content binary")
    got = {r.image: r for r in ird.read_listings(rows).collect()}
    for key in "ab":
        r = got[key]
        assert (r.version, r.entry_id, r.name, r.update_version, r.entry_version, r.app_version, r.files, r.error) == (9, "ABCD12345", "Name", "4.00", "01.00", "01.00", 2, None)
        assert [tuple(e) for e in r.entries] == [("BIG.BIN", 0, 100, 30), ("BIG.BIN", 1, 5, 31), ("DIR/IN.BIN", 2, 7, 40)]
        assert [tuple(h) for h in r.hashes] == [(30, "01" * 16), (40, "02" * 16)] and r.regions == ["aa" * 16]
    assert all(got[k].error and got[k].entries is None for k in "cde")


CATALOGUE = '<?xml version="1.0"?><datafile><header><name>{n}</name><version>{v}</version><clrmamepro header="{h}"/></header><game name="G"><description>G</description><rom name="g.bin" size="3" crc="AA"/></game></datafile>'


def test_deliveries(spark, tmp_path):
    landing, work = tmp_path / "landing", str(tmp_path / "work")
    landing.mkdir()
    for name, members in {"one": ["one"], "two": ["two"], "many": ["x", "y"], "none": []}.items():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for m in members:
                z.writestr(f"{m}.dat", CATALOGUE.format(n=m, v="1", h="No-Intro_NES.xml"))
        (landing / f"{name}.zip").write_bytes(data.getvalue())
    offered, entries, items = delivery.read_delivery(spark, str(landing), work)
    assert sorted(map(tuple, offered.collect())) == [("one", "1"), ("two", "1")]
    assert sorted((r.system, r.name) for r in entries.collect()) == [("one", "G"), ("two", "G")]
    assert sorted((r.system, r.game, r.name, r.size, r.crc) for r in items.collect()) == [("one", "G", "g.bin", 3, "aa"), ("two", "G", "g.bin", 3, "aa")]
    assert delivery.codes(spark).select("code").distinct().count() == len(delivery.CODES) == 52


def test_detectors_beside_a_catalogue_come_first(spark):
    headers = spark.createDataFrame([("a", "No-Intro_NES.xml"), ("b", "own.xml"), ("c", "nobody.xml"), ("d", None)], "name string, detector string")
    beside = spark.createDataFrame([("own.xml", 4, [(0, "ff")]), ("No-Intro_NES.xml", 8, [(1, "00")])], "detector string, size bigint, rules array<struct<start_byte:bigint,hex_value:string>>")
    assert {r.name: r.size for r in catalog_xml.detectors_of(headers).collect()} == {"a": 16}
    assert {r.name: r.size for r in catalog_xml.detectors_of(headers, beside).collect()} == {"a": 8, "b": 4}


@pytest.mark.parametrize(
    "name, regions",
    [("T (1985)(Maker)(FR)(en)", "FR"), ("T (demo) (199x)(-)(PAL)(DE-FR)[a]", "DE-FR"), ("T (1985)(Maker)", ""), ("T (1985)(Maker)(QQ)", ""), ("T (USA, Japan)", "US-JP"), ("T", ""), (None, "")],
)
def test_regions_of_both_conventions(spark, name, regions):
    assert spark.createDataFrame([(name,)], "n string").select(names.regions_of(F.col("n")).alias("r")).first().r == regions


def test_rejected_settings(spark):
    rows = [("PREFER_REGIONS", "broad"), ("PREFER_VERSIONS", "newest"), ("CHD_PARENTS", "yes"), ("RVZ_SCRUB", "true"), ("ZIP_COMPRESSION_LEVEL", "10"), ("RVZ_BLOCK_SIZE", "32"), ("REGIONS_ONE_ARCADE", "bios|x"), ("LANGUAGES", None), ("RVZ_BLOCK_SIZE", "a")]
    got = s.rejected(spark.createDataFrame(rows, "key string, value string")).collect()
    assert sorted(r.value for r in got) == ["10", "a", "bios|x", "newest", "yes"]


def test_cue_sheet_of_tracks():
    sheet = cue.parse('SONGWRITER "S"\nTITLE "D"\nFILE "a.bin" BINARY\n TRACK 01 AUDIO\n  TITLE "T"\n  PERFORMER P\n  PREGAP 00:02:00\n  INDEX 01 00:00:00\n  POSTGAP 00:01:00\n')
    track = sheet["tracks"][0]
    assert (sheet["songwriter"], sheet["title"], track["title"], track["performer"], track["pregap"], track["postgap"], track["songwriter"]) == ("S", "D", "T", "P", "00:02:00", "00:01:00", None)


def _state(spark, roms):
    rows = spark.createDataFrame(roms, "id bigint, name string, size bigint, crc string, md5 string, sha1 string, game_id bigint, romfile_id bigint, parent_id bigint")
    games = spark.createDataFrame([(1, "One", False, 1), (2, "Two", False, 1)], "id bigint, name string, jbfolder boolean, system_id bigint")
    return rows, games, spark.createDataFrame([(1, "Sys", None, False)], "id bigint, name string, custom_name string, arcade boolean")


def test_images_without_a_size(spark):
    """A disc image is found by its data, else by its own checksum with an item of size 0."""
    roms, games, systems = _state(spark, [(1, "a.iso", 10, None, None, "d1", 1, None, None), (2, "b.chd", 0, None, None, "c2", 2, None, None), (3, "c.iso", 5, "e3", None, None, 2, None, None)])
    none = spark.createDataFrame([], "image string, track int, size bigint, crc string, md5 string, sha1 string")
    images = spark.createDataFrame([("x", "dvd", 10, None, None, "D1", "zz"), ("y", "hd", 9, None, None, "no", "c2"), ("z", "ld", 5, "E3", None, "no2", "no3"), ("w", "dvd", 1, None, None, None, None)], "image string, kind string, size bigint, crc string, md5 string, sha1 string, disc_sha1 string")
    got = sorted((r.image, r.rom, r.state, r.path) for r in i.import_discs(images, none, roms, games, systems).collect())
    assert got == [("w", None, "invalid", None), ("x", 1, "valid", "Sys/a.chd"), ("y", 2, "valid", "Sys/b.chd"), ("z", 3, "valid", "Sys/c.chd")]


def test_archives_that_share_contents(spark):
    """Two entries share a content: each archive goes to the entry it holds, whatever the ids' order."""
    roms, games, systems = _state(spark, [(1, "s.bin", 4, "aa", None, None, 1, None, None), (2, "x.bin", 5, "bb", None, None, 1, None, None), (3, "s.bin", 4, "aa", None, None, 2, None, None), (4, "y.bin", 6, "cc", None, None, 2, None, None)])
    members = spark.createDataFrame([("a.zip", "1", 4, "aa"), ("a.zip", "2", 6, "CC"), ("b.zip", "1", 4, "AA"), ("b.zip", "2", 5, "bb"), ("c.zip", "1", 4, "aa"), ("d.zip", "1", 9, None)], "archive string, member string, size bigint, crc string").selectExpr("*", "null::string as md5", "null::string as sha1")
    action, rows = i.import_archives(members, roms, games, systems)
    assert dict(map(tuple, action.collect())) == {"a.zip": "keep", "b.zip": "keep", "c.zip": "trash", "d.zip": "trash"}
    assert sorted((r.archive, r.rom, r.path) for r in rows.where("rom is not null").collect()) == [("a.zip", 3, "Sys/Two.zip"), ("a.zip", 4, "Sys/Two.zip"), ("b.zip", 1, "Sys/One.zip"), ("b.zip", 2, "Sys/One.zip")]
