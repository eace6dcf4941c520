"""What is missing, orphaned, foreign, trashed or damaged, and the plans that put it right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.functions.hashing import crc32


def foreign_files(listing: DataFrame, romfiles: DataFrame) -> DataFrame:
    """Files on disk that the state does not know."""
    return listing.join(romfiles.select("path"), "path", "left_anti")


def missing_files(romfiles: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of the state that are not on disk."""
    return romfiles.join(listing.select("path"), "path", "left_anti")


def checked(expected: DataFrame, actual: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """(file, status) of each stored file against its item.

    ``expected``: file, size, crc, md5, sha1; ``actual``: file, content. The first
    checksum known counts; size 0 is not compared. The bytes are digested before
    the join.
    """
    content = F.col("content")
    read = actual.where("content is not null").select("file", F.octet_length(content).alias("_size"), crc32(content).alias("_crc"), F.md5(content).alias("_md5"), F.sha1(content).alias("_sha1"))
    return compared(expected, read)


def compared(expected: DataFrame, read: DataFrame) -> DataFrame:
    """``checked`` of files digested where they were read, so that no content is shuffled. ``read``: file, _size, _crc, _md5, _sha1."""
    rows = expected.join(read, "file", "left")
    digest = F.coalesce(*[F.col(f"_{a}") == F.lower(a) for a in ("crc", "md5", "sha1")])
    status = F.when(F.col("_size").isNull(), "missing").when((F.col("size") > 0) & (F.col("_size") != F.col("size")), "size mismatch").when(digest.isNull(), "no checksum").when(~digest, "checksum mismatch").otherwise("ok")
    return rows.select("file", status.alias("status"))


def checked_archives(expected: DataFrame, members: DataFrame) -> DataFrame:
    """(archive, status): as many members as items, each by name.

    ``expected``: archive, name, size, crc; ``members``: archive, name, size, crc.
    """
    e = expected.groupBy("archive").agg(F.count("*").alias("wanted"))
    m = members.groupBy("archive").agg(F.count("*").alias("found"))
    met = expected.alias("e").join(members.alias("m"), ["archive", "name"]).groupBy("archive").agg(
        F.count("*").alias("named"), F.count_if((F.col("e.size") > 0) & (F.col("e.size") != F.col("m.size"))).alias("sizes"), F.count_if(F.lower("e.crc") != F.lower("m.crc")).alias("sums")
    )
    rows = e.join(m, "archive", "left").join(met, "archive", "left")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("wanted") != F.col("found"), "member count").when(F.coalesce("named", F.lit(0)) != F.col("wanted"), "member name").when(F.col("sizes") > 0, "size mismatch").when(F.col("sums") > 0, "checksum mismatch").otherwise("ok")
    return rows.select("archive", status.alias("status"))


def purge_plan(romfiles: DataFrame, roms: DataFrame, games: DataFrame, listing: DataFrame) -> DataFrame:
    """(kind, path) of everything that purging would touch."""
    from stocktake.operators.catalogue import trashed_romfiles
    from stocktake.operators.joins import orphan_romfiles

    kinds = {"missing": missing_files(romfiles, listing), "trash": trashed_romfiles(romfiles, include_global=True), "orphan": orphan_romfiles(romfiles, roms, games), "foreign": foreign_files(listing, romfiles)}
    parts = [df.select(F.lit(kind).alias("kind"), "path") for kind, df in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def empty_files_to_create(games: DataFrame, roms: DataFrame) -> DataFrame:
    """Missing items of size 0 without CRC in partial entries."""
    return roms.where("romfile_id is null and size = 0 and crc is null").join(games.where("completion = 1").select(F.col("id").alias("game_id")), "game_id", "left_semi")


def conversion_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sums of original, old and new sizes, and the ratios in percent. Both: key, size; ``before`` has original."""
    sums = before.join(after.select("key", F.col("size").alias("new")), "key").agg(F.sum("original").alias("original"), F.sum("size").alias("old"), F.sum("new").alias("new"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(100.0 * F.col(a) / F.col(b), 6))
    return sums.select("original", "old", "new", ratio("old", "original").alias("old_ratio"), ratio("new", "original").alias("new_ratio"), ratio("new", "old").alias("change_ratio"))
