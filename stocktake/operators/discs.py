"""Disc images and packages: order of work, parents, tracks, extents, patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stocktake.functions.paths import extension


def children_first(games: DataFrame, roms: DataFrame, romfiles: DataFrame) -> DataFrame:
    """(id, rank): entries with an image that builds on another come first (rank 0), as a parent is replaced last."""
    images = romfiles.where("parent_id is not null").select(F.col("id").alias("romfile_id")).distinct()
    own = roms.join(images, "romfile_id", "left_semi").select(F.col("game_id").alias("id")).distinct().withColumn("rank", F.lit(0))
    return games.select("id").join(own, "id", "left").select("id", F.coalesce("rank", F.lit(1)).alias("rank"))


def parent_images(games: DataFrame, roms: DataFrame, romfiles: DataFrame) -> DataFrame:
    """(id, parent_romfile_id): for entries of a playlist, the image of the playlist's first entry by name that has one."""
    listed = games.where("playlist_id is not null").select("id", "name", "playlist_id")
    images = romfiles.where(F.lower(extension(F.col("path"))) == "chd").select(F.col("id").alias("romfile_id"))
    have = roms.select("game_id", "romfile_id").join(images, "romfile_id", "left_semi").groupBy(F.col("game_id").alias("id")).agg(F.min("romfile_id").alias("romfile_id"))
    first = listed.join(have, "id").groupBy("playlist_id").agg(F.min(F.struct("name", "id", "romfile_id")).alias("first"))
    return listed.join(first, "playlist_id").where(F.col("id") != F.col("first.id")).select("id", F.col("first.romfile_id").alias("parent_romfile_id"))


def hash_order(disc: Column) -> Column:
    """The algorithms in the order in which they are tried; reversed for disc images."""
    tried = ("crc", "md5", "sha1")
    return F.when(disc, F.array(*map(F.lit, reversed(tried)))).otherwise(F.array(*map(F.lit, tried)))


def zipped(left: DataFrame, right: DataFrame, group: str, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The rows of both sides of a group, joined by their places in order; rows beyond the shorter side go."""
    a = left.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*left_order)))
    b = right.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*right_order)))
    return a.join(b, [group, "place"])


def extents(entries: DataFrame) -> DataFrame:
    """(image, path, size, location): the extents of a file in one, at the place of the first. ``entries``: image, path, ordinal, size, location."""
    return entries.groupBy("image", "path").agg(F.sum(F.col("size").cast("bigint")).alias("size"), F.min_by("location", "ordinal").alias("location"))


def package_members(lines: DataFrame) -> DataFrame:
    """(package, member, size) from a package tool's listing. ``lines``: package, number, line.

    A content's id and size stand in lines of their own; the size belongs to the
    last id before it. The title version makes a member ``tmd.<version>``.
    """
    so_far = W.partitionBy("package").orderBy("number").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    marked = lines.withColumn("content", F.last(found(r"(?i)^\s*Content id:?\s+(?:0x)?([0-9a-f]+)"), ignorenulls=True).over(so_far)).withColumn("bytes", found(r"(?i)^\s*Content size:?\s+(?:0x)?([0-9a-f]+)"))
    contents = marked.where("bytes is not null and content is not null").select("package", F.lower("content").alias("member"), F.conv("bytes", 16, 10).cast("bigint").alias("size"))
    titles = lines.withColumn("version", found(r"(?i)^\s*Title version:?\s+(?:0x)?([0-9a-f]+)")).where("version is not null")
    return contents.unionByName(titles.select("package", F.concat(F.lit("tmd."), F.conv("version", 16, 10)).alias("member"), F.lit(None).cast("bigint").alias("size")))


def new_patches(have: DataFrame, added: DataFrame) -> DataFrame:
    """(rom_id, name, index): added patches with the next free places of their item; names it has already go.

    ``have``: rom_id, name; ``added``: rom_id, name.
    """
    fresh = added.distinct().join(have.select("rom_id", "name"), ["rom_id", "name"], "left_anti")
    counts = have.groupBy("rom_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("rom_id").orderBy("name")) - 1
    return fresh.withColumn("place", place).join(counts, "rom_id", "left").select("rom_id", "name", (F.coalesce("n", F.lit(0)) + F.col("place")).cast("int").alias("index"))


def unique_by_path(romfiles: DataFrame) -> DataFrame:
    """(path, id): each path once, with its least id."""
    return romfiles.groupBy("path").agg(F.min("id").alias("id"))


def not_imported(codes: DataFrame, systems: DataFrame) -> DataFrame:
    """Names and codes of published collections that no collection has."""
    return codes.join(systems.select("name"), "name", "left_anti")


def human_size(size: Column) -> Column:
    """Bytes with a binary unit and two decimals: ``512 B``, ``1.50 KiB``."""
    units = ("KiB", "MiB", "GiB", "TiB", "PiB")
    shown = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        made = F.format_string(f"%.2f {unit}", size / F.lit(float(1024**k)))
        shown = shown.when(size < 1024 ** (k + 1), made) if k < len(units) else shown.otherwise(made)
    return shown


def supports(version: Column, since: str) -> Column:
    """Whether a tool's version, compared as text, has a capability."""
    return version >= F.lit(since)
