"""Semi, anti and navigation joins between the model's tables.

No side is hinted: sizes are known from the files, and adaptive execution picks
broadcast or shuffle and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roms_of_systems(roms: DataFrame, games: DataFrame) -> DataFrame:
    return roms.join(games.select(F.col("id").alias("game_id"), "system_id"), "game_id")


def patched_romfiles(romfiles: DataFrame, patches: DataFrame, roms: DataFrame, games: DataFrame) -> DataFrame:
    """Patch files of each collection; a file used twice appears twice."""
    owner = roms_of_systems(roms.select(F.col("id").alias("rom_id"), "game_id"), games).select("rom_id", "system_id")
    used = patches.select("rom_id", F.col("romfile_id").alias("id")).join(owner, "rom_id")
    return romfiles.join(used.select("id", "system_id"), "id")


def romfiles_of_system(romfiles: DataFrame, roms: DataFrame, games: DataFrame, system_id: int, extension: str | None = None) -> DataFrame:
    """Files that back an item of one collection, each once; with an extension, parentless ones that end so."""
    inside = roms.join(games.where(F.col("system_id") == system_id).select(F.col("id").alias("game_id")), "game_id", "left_semi")
    if extension is not None:
        romfiles = romfiles.where(F.col("path").ilike(f"%.{extension}") & F.col("parent_id").isNull())
    return romfiles.join(inside.select(F.col("romfile_id").alias("id")), "id", "left_semi")


def playlist_romfiles(romfiles: DataFrame, games: DataFrame) -> DataFrame:
    return romfiles.join(games.select(F.col("playlist_id").alias("id")), "id", "left_semi")


def orphan_romfiles(romfiles: DataFrame, roms: DataFrame, games: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """Files that no item and no playlist uses; given ``patches``, no patch either."""
    left = romfiles.join(roms.select(F.col("romfile_id").alias("id")), "id", "left_anti").join(games.select(F.col("playlist_id").alias("id")), "id", "left_anti")
    return left if patches is None else left.join(patches.select(F.col("romfile_id").alias("id")), "id", "left_anti")


def empty_systems(systems: DataFrame, games: DataFrame) -> DataFrame:
    return systems.where("completion = 0").join(games.where("completion <> 0").select(F.col("system_id").alias("id")), "id", "left_anti")


def navigate(roms: DataFrame, games: DataFrame, systems: DataFrame, romfiles: DataFrame) -> DataFrame:
    """Every item with the names of its entry and collection and, where there is one, its file."""
    named = roms.select("id", "game_id", "romfile_id").join(games.select(F.col("id").alias("game_id"), F.col("name").alias("game"), "system_id"), "game_id")
    named = named.join(systems.select(F.col("id").alias("system_id"), F.col("name").alias("system")), "system_id")
    return named.join(romfiles.select(F.col("id").alias("romfile_id"), "path"), "romfile_id", "left").select("id", "game", "system", "path")


def files_by_romfile(roms: DataFrame) -> DataFrame:
    """(romfile_id, n, first_id, last_id): how many items are behind each file, and the least and greatest of them."""
    return roms.where("romfile_id is not null").groupBy("romfile_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def clones_by_parent(games: DataFrame) -> DataFrame:
    """(parent_id, n, first_name) of entries that have clones."""
    return games.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def vanished_games(games: DataFrame, listed: DataFrame) -> DataFrame:
    """Entries that a newer catalogue (name) no longer lists."""
    return games.join(listed.select("name"), "name", "left_anti")


def vanished_roms(roms: DataFrame, listed: DataFrame) -> DataFrame:
    """Items that a newer catalogue (game_id, name) no longer lists; inherited ones stay."""
    return roms.where("parent_id is null").join(listed.select("game_id", "name"), ["game_id", "name"], "left_anti")


def parent_rom(children: DataFrame, candidates: DataFrame, roms: DataFrame) -> DataFrame:
    """The item that each child takes over: of its candidate entries in order, the first with an equal (size, crc).

    ``children``: id, size, crc; ``candidates``: id, ordinal, game_id.
    """
    pool = roms.where("parent_id is null").groupBy("game_id", "size", "crc").agg(F.min("id").alias("parent"))
    met = children.join(candidates, "id").join(pool, ["game_id", "size", "crc"])
    return met.groupBy("id").agg(F.min_by("parent", "ordinal").alias("parent_rom_id"))
