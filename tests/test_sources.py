import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from stocktake.sources import blobs, catalog_xml, cue
from stocktake.streaming import incremental

CATALOGUE = """<?xml version="1.0"?>
<!DOCTYPE datafile PUBLIC "-//Logiqx//DTD ROM Management Datafile//EN" "http://www.logiqx.com/Dats/datafile.dtd">
<datafile>
 <header><name>Things</name><description>Things</description><version>20200101</version><clrmamepro forcenodump="x"/><clrmamepro header="head.xml"/></header>
 <game name="A (USA)"><description>A</description><rom name="a.rom" size="256" crc="CC721E14" md5="AB"/><rom name="gone.rom" size="1" status="nodump"/></game>
 <game name="A (Japan)" cloneof="A (USA)" isbios="yes"><description>B</description><rom name="b.rom" size=""/></game>
 <machine name="m" romof="n" isdevice="yes"><description>M</description><disk name="d" sha1="FF"/></machine>
</datafile>"""


def test_catalogue(spark, tmp_path):
    path = tmp_path / "c.dat"
    path.write_text(CATALOGUE)
    entries = catalog_xml.read_entries(spark, str(path))
    rows = {r.name: r for r in entries.collect()}
    assert set(rows) == {"A (USA)", "A (Japan)", "m"}
    assert rows["A (Japan)"].cloneof == "A (USA)" and rows["A (Japan)"].bios and not rows["A (USA)"].bios and rows["m"].arcade and rows["m"].device
    items = {r.name: r for r in catalog_xml.read_roms(entries).collect()}
    assert set(items) == {"a.rom", "b.rom", "d"}
    assert items["a.rom"].crc == "cc721e14" and items["b.rom"].size == 0 and items["d"].disk
    head = catalog_xml.read_header(spark, str(path)).first()
    assert (head.name, head.version, head.detector) == ("Things", "20200101", "head.xml")


def test_catalogue_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("x & y", 'q".bin', 3, "00", "11", "22"), ("z", "z.bin", 4, "33", "44", "55")], "game string, rom string, size bigint, crc string, md5 string, sha1 string")
    path = tmp_path / "w.dat"
    path.write_text("\n".join(r.line for r in catalog_xml.catalogue_xml("N", "1", rows).collect()))
    got = sorted((r.game, r.name, r.size, r.crc, r.md5, r.sha1) for r in catalog_xml.read_roms(catalog_xml.read_entries(spark, str(path))).collect())
    assert got == sorted(map(tuple, rows.collect()))


def test_detector(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text('<?xml version="1.0"?><detector><name>N</name><version>1</version><rule start_offset="10"><data offset="A" value="4E4553"/><data offset="0" value="FF"/></rule></detector>')
    row = catalog_xml.read_detectors(spark, str(path)).first()
    assert row.size == 16 and [tuple(r) for r in row.rules] == [(10, "4e4553"), (0, "ff")]


def test_zip_members_and_listings(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.dat", "hello")
        z.writestr("b.txt", "x")
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    (tmp_path / "y.zip").write_bytes(b"no zip")
    rows = blobs.zip_members(blobs.read_files(spark, str(tmp_path), "*.zip"), "dat").collect()
    assert [(r.member, r.size, r.crc, bytes(r.content)) for r in rows] == [("a.dat", 5, "3610a686", b"hello")]
    text = "Path = x.7z\nType = 7z\n\nPath = in/a.rom\nSize = 256\nCRC = CC721E14\n\nPath = b\nSize = 1\nCRC = 00AA00AA\n"
    got = spark.createDataFrame([(text,)], "t string").select(blobs.listed_members(F.col("t")).alias("m")).first().m
    assert [tuple(x) for x in got] == [("in/a.rom", 256, "cc721e14"), ("b", 1, "00aa00aa")]


def test_disc_info(spark):
    text = "Logical size: 1,404,928 bytes\nSHA1:         aa11\nData SHA1:    bb22\nParent SHA1:  cc33\nMetadata:     Tag='CHT2'  Index=0  Length=93 bytes\n              TRACK:1 TYPE:MODE1\nMetadata:     Tag='CHT2'\n TRACK:2 TYPE:AUDIO\n"
    row = spark.createDataFrame([(text,)], "t string").select(blobs.disc_info(F.col("t")).alias("i")).first().i
    assert tuple(row) == ("cd", 1404928, "bb22", "aa11", "cc33", 2)
    images = spark.createDataFrame([("d/c", "d", "1", "2"), ("d/p", "d", "2", None), ("d/o", "d", "3", "9")], "path string, dir string, sha1 string, parent_sha1 string")
    assert {r.path: r.parent_path for r in blobs.parents_of_images(images).collect()} == {"d/c": "d/p", "d/o": None}


def test_cue_sheet(spark):
    text = 'CATALOG 0000000000000\nREM made\nFILE "a b.bin" BINARY\n  TRACK 01 MODE1/2352\n    INDEX 00 00:00:00\n    INDEX 01 00:03:06\nFILE "c.bin" BINARY\n  TRACK 02 AUDIO\n    INDEX 01 00:00:00\n'
    row = cue.read_sheets(spark.createDataFrame([("p", bytearray(text.encode()))], "path string, content binary")).first()
    assert row.catalog == "0000000000000" and row.comments == ["made"]
    assert [(t.number, t.data_type, t.file, len(t.indices)) for t in row.tracks] == [(1, "MODE1/2352", "a b.bin", 2), (2, "AUDIO", "c.bin", 1)]
    assert tuple(row.tracks[0].indices[1]) == (1, 0, 3, 6)


def test_incremental_import(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    digest = hashlib.md5(b"same").hexdigest()
    items = spark.createDataFrame([(1, 4, digest)], "rom bigint, size bigint, digest string")
    for k, text in enumerate((b"same", b"same", b"else")):
        (folder / f"f{k}").write_bytes(text)
        incremental.import_stream(incremental.arriving(spark, str(folder)), items, out, mark).awaitTermination()
    got = sorted((r.file.rsplit("/", 1)[-1], r.rom, r.state) for r in spark.read.parquet(out).collect())
    assert got == [("f0", 1, "valid"), ("f1", None, "duplicate"), ("f2", None, "invalid")]
