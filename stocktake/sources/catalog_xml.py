"""Reference catalogues and header detectors in XML, both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.operators.delta import flag

_ROM = "array<struct<_name:string,_merge:string,_size:string,_crc:string,_md5:string,_sha1:string,_status:string>>"
GAME = f"_name string, description string, comment string, _cloneof string, _romof string, _isdevice string, _isbios string, rom {_ROM}, disk {_ROM}"
DETECTOR = "name string, version string, rule struct<_start_offset:string,data:array<struct<_offset:string,_value:string>>>"


#: Header detectors known without a file of their own, as (name, version, size, ((start byte, hex value), ...)).
DETECTORS = {
    "No-Intro_A7800.xml": ("No-Intro Atari 7800 Dat Header Skipper", "20130123", 128, ((1, "415441524937383030"), (96, "0000000041435455414c20434152542044415441205354415254532048455245"))),
    "No-Intro_FDS.xml": ("No-Intro FDS Dat FWnes Header Skipper", "20070421", 16, ((0, "464453"),)),
    "No-Intro_LNX.xml": ("No-Intro Lynx Dat LNX Header Skipper", "20070408", 64, ((0, "4c594e58"),)),
    "No-Intro_NES.xml": ("No-Intro NES Dat iNES Header Skipper", "20070321", 16, ((0, "4e4553"),)),
}


def read_entries(spark: SparkSession, path: str, with_file: bool = False) -> DataFrame:
    """Entries of catalogues (``game`` or ``machine`` elements): one row each, with their items.

    Sizes are read as strings, since an empty one means 0; ``arcade`` says which
    element it was.
    """
    parts = [_read(spark, path, tag, GAME).withColumn("arcade", F.lit(tag == "machine")) for tag in ("game", "machine")]
    rows = parts[0].unionByName(parts[1])
    empty = F.array().cast(_ROM)

    def items(column: str, disk: bool):
        return F.transform(F.coalesce(column, empty), lambda r: F.struct(
            r["_name"].alias("name"), r["_merge"].alias("merge"), F.coalesce(r["_size"].try_cast("bigint"), F.lit(0)).alias("size"), F.lower(r["_crc"]).alias("crc"), F.lower(r["_md5"]).alias("md5"),
            F.lower(r["_sha1"]).alias("sha1"), r["_status"].alias("status"), F.lit(disk).alias("disk"),
        ))

    both = F.concat(items("rom", False), items("disk", True))
    return rows.select(
        F.col("_name").alias("name"), "description", "comment", F.col("_cloneof").alias("cloneof"), F.col("_romof").alias("romof"), flag(F.col("_isdevice")).alias("device"), flag(F.col("_isbios")).alias("bios"), "arcade",
        F.filter(both, lambda r: F.coalesce(r["status"], F.lit("")) != "nodump").alias("roms"), *(["file"] if with_file else []),
    )


def read_roms(entries: DataFrame) -> DataFrame:
    """One row per item of ``read_entries``."""
    return entries.select(F.col("name").alias("game"), F.explode("roms").alias("r")).select("game", "r.*")


def read_header(spark: SparkSession, path: str, with_file: bool = False) -> DataFrame:
    """name, description, version and the detector file of each catalogue."""
    schema = "name string, description string, version string, date string, author string, url string, clrmamepro array<struct<_header:string>>"
    rows = _read(spark, path, "header", schema)
    return rows.select("name", "description", "version", "url", F.get(F.filter(F.transform("clrmamepro", lambda c: c["_header"]), lambda h: h.isNotNull()), 0).alias("detector"), *(["file"] if with_file else []))


def read_detectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, size, rules): the header's size and, per rule, start byte and hex value."""
    rows = spark.read.format("xml").option("rowTag", "detector").schema(DETECTOR).load(path)
    number = lambda c: F.conv(c, 16, 10).cast("bigint")
    rules = F.transform("rule.data", lambda d: F.struct(number(d["_offset"]).alias("start_byte"), F.lower(d["_value"]).alias("hex_value")))
    return rows.select("name", "version", number(F.col("rule._start_offset")).alias("size"), rules.alias("rules"))


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").schema(schema).load(path).withColumn("file", F.col("_metadata.file_path"))


def detectors_of(headers: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """(name, detector, size, rules) of catalogues that name a detector: from the file beside them, else a known one.

    ``headers``: name, detector; ``beside``: detector (a file's name), size, rules.
    Catalogues whose detector nobody knows are left out.
    """
    rules = "array<struct<start_byte:bigint,hex_value:string>>"
    known = headers.sparkSession.createDataFrame([(file, size, list(found)) for file, (_, _, size, found) in DETECTORS.items()], f"detector string, size bigint, rules {rules}")
    if beside is not None:
        beside = beside.select("detector", "size", F.col("rules").cast(rules).alias("rules"))
        known = beside.unionByName(known.join(beside.select("detector"), "detector", "left_anti"))
    return headers.where("detector is not null").select("name", "detector").join(known, "detector").select("name", "detector", "size", "rules")


def read_catalogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The offered catalogues, entries and items of all files of ``path``, as ``import_catalogues`` takes them.

    An entry belongs to the catalogue whose header is in its file.
    """
    head = read_header(spark, path, with_file=True).withColumnRenamed("name", "system")
    entries = read_entries(spark, path, with_file=True).join(head.select("file", "system"), "file")
    listed = entries.select("system", "name", "description", "bios", "cloneof", "romof")
    items = entries.select("system", F.col("name").alias("game"), F.explode("roms").alias("r")).select("system", "game", "r.name", "r.size", "r.crc", "r.md5", "r.sha1", F.col("r.status").alias("rom_status"))
    return head.select(F.col("system").alias("name"), "version"), listed, items


def unpacked(members: DataFrame, folder: str) -> str:
    """Write catalogues that were delivered as archives of exactly one member each below ``folder``; its path.

    ``members``: path, member, content. Archives with none or several members are left out.
    """
    single = members.groupBy("path").agg(F.count("*").alias("n")).where("n = 1").select("path")
    rows = members.join(single, "path").select(F.decode("content", "UTF-8").alias("value"), F.md5("path").alias("archive"))
    rows.write.mode("overwrite").partitionBy("archive").text(folder)
    return folder


def catalogue_xml(name: str, version: str, entries: DataFrame) -> DataFrame:
    """Lines of a catalogue of (game, rom, size, crc, md5, sha1) rows, in order of ``n``; one file is one collection."""
    quote = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    line = F.concat(
        F.lit('  <game name="'), quote(F.col("game")), F.lit('"><description>'), quote(F.col("game")), F.lit('</description><rom name="'), quote(F.col("rom")), F.lit('" size="'), F.col("size").cast("string"),
        F.lit('" crc="'), "crc", F.lit('" md5="'), "md5", F.lit('" sha1="'), "sha1", F.lit('"/></game>'),
    )
    spark = entries.sparkSession
    head = ['<?xml version="1.0"?>', '<!DOCTYPE datafile PUBLIC "-//Logiqx//DTD ROM Management Datafile//EN" "http://www.logiqx.com/Dats/datafile.dtd">', "<datafile>", f"  <header><name>{name}</name><description>{name}</description><version>{version}</version></header>"]
    edge = spark.createDataFrame([(0, "", k, x) for k, x in enumerate(head)] + [(2, "", 0, "</datafile>")], "part int, game string, k int, line string")
    body = entries.select(F.lit(1).alias("part"), "game", F.lit(0).alias("k"), line.alias("line"))
    return edge.unionByName(body).orderBy("part", "game", "k", "line")
