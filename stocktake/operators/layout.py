"""Where each file belongs, and the moves that bring it there. Paths are relative to the collection root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stocktake.functions.paths import alpha_folder, extension
from stocktake.schema import ARCHIVE_EXTENSIONS, IGNORED, NON_ORIGINAL_EXTENSIONS, ONE_REGION

_SYSTEM = r"^(Non-Redump - |Unofficial - )?([^()]+)( \(.*\))?$"


def system_directory(name: Column, custom_name: Column, group: bool = False) -> Column:
    """The folder of a collection: its custom name, else its own; grouped without prefix and closing parentheses."""
    own = F.coalesce(custom_name, name)
    return F.btrim(F.regexp_extract(own, _SYSTEM, 2)) if group else F.coalesce(custom_name, F.btrim(name))


def sorted_path(system_dir: Column, game: Column, rom: Column, path: Column, sorting: Column, arcade: Column, jbfolder: Column, custom_extension: Column, one_alpha: bool = False, all_alpha: bool = False) -> Column:
    """The place of a stored file by its entry's class and the layout's rules."""
    ext = extension(path)
    archive = ext.isin(*ARCHIVE_EXTENSIONS)
    folder = F.concat(system_dir, F.when(sorting == ONE_REGION, "/1G1R").when(sorting == IGNORED, "/Trash").otherwise(""))
    alpha = F.when(sorting == ONE_REGION, F.lit(one_alpha)).when(sorting == IGNORED, F.lit(False)).otherwise(F.lit(all_alpha))
    letter = F.when(alpha, F.concat(F.lit("/"), alpha_folder(game))).otherwise("")
    own = F.when((arcade & ~archive) | jbfolder, F.concat(F.lit("/"), game)).otherwise("")
    converted = F.concat(F.when(arcade & ~archive, rom).otherwise(game), F.lit("."), ext)
    name = F.when(ext.isin(*NON_ORIGINAL_EXTENSIONS), converted).when(custom_extension.isNotNull(), F.concat(game, F.lit("."), custom_extension)).otherwise(rom)
    return F.concat(folder, letter, own, F.lit("/"), name)


def playlist_path(system_dir: Column, game: Column, sorting: Column) -> Column:
    folder = F.concat(system_dir, F.when(sorting == ONE_REGION, "/1G1R").when(sorting == IGNORED, "/Trash").otherwise(""))
    return F.concat(folder, F.lit("/"), F.regexp_replace(game, r" \(Disc \d+\).*", ""), F.lit(".m3u"))


def placed_roms(systems: DataFrame, games: DataFrame, roms: DataFrame, romfiles: DataFrame, group: bool = False, one_alpha: bool = False, all_alpha: bool = False) -> DataFrame:
    """(rom_id, romfile_id, src, dst) of every present item."""
    s = systems.select(F.col("id").alias("system_id"), system_directory(F.col("name"), F.col("custom_name"), group).alias("dir"), "arcade", "custom_extension")
    g = games.select(F.col("id").alias("game_id"), F.col("name").alias("game"), "sorting", "jbfolder", "system_id")
    rows = roms.where("romfile_id is not null").select(F.col("id").alias("rom_id"), F.col("name").alias("rom"), "game_id", "romfile_id")
    rows = rows.join(romfiles.select(F.col("id").alias("romfile_id"), F.col("path").alias("src")), "romfile_id").join(g, "game_id").join(s, "system_id")
    dst = sorted_path(F.col("dir"), F.col("game"), F.col("rom"), F.col("src"), F.col("sorting"), F.col("arcade"), F.col("jbfolder"), F.col("custom_extension"), one_alpha, all_alpha)
    return rows.select("rom_id", "romfile_id", "src", dst.alias("dst"))


def patch_moves(moves: DataFrame, patches: DataFrame, romfiles: DataFrame) -> DataFrame:
    """Patches follow their item under its new stem, with their own extension."""
    files = romfiles.select(F.col("id").alias("romfile_id"), F.col("path").alias("psrc"))
    rows = patches.select("rom_id", "romfile_id").join(files, "romfile_id").join(moves.select("rom_id", "dst"), "rom_id")
    return rows.select("rom_id", "romfile_id", F.col("psrc").alias("src"), F.concat(F.regexp_replace("dst", r"(?<=[^/])\.[^./]*$", ""), F.lit("."), extension(F.col("psrc"))).alias("dst"))


def move_plan(moves: DataFrame) -> DataFrame:
    """Moves that change a path, one per destination, the least item first."""
    changed = moves.where("src <> dst")
    return changed.withColumn("_k", F.row_number().over(W.partitionBy("dst").orderBy("rom_id", "romfile_id"))).where("_k = 1").drop("_k")
