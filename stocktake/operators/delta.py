"""Changing the state: upserts, deletions with their cascades, and catalogue deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stocktake.state import settle


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; the rest stay."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def inserted(old: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """``new`` with fresh ids after the largest of ``old``, numbered in ``order``.

    Numbers come from counts per range partition, so no task sees all rows. The
    partitions are written down before they are counted, as range borders may
    fall otherwise when they are made again.
    """
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("top"))
    ranged = new.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = settle(ranged, "ranged")
    ranked = ranged.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    sizes = ranked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranked.join(before, "_p").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("_b") + F.col("_k")).drop("_p", "_k", "_b", "top")


def updated(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``old`` with the values of ``new``, nulls too, in the rows whose id it has."""
    given = new.select("id", F.lit(True).alias("_given"), *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(given, "id", "left").select(*[F.when(F.col("_given"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def deleted(old: DataFrame, gone: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti").select(*old.columns)


def _nulled(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    marks = gone.select(F.col("id").alias(column), F.lit(True).alias("_gone"))
    return df.join(marks, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*df.columns)


def delete_systems(state: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Collections with their entries, items, headers, rules and patches."""
    games = state["games"].join(gone.select(F.col("id").alias("system_id")), "system_id", "left_semi")
    out = delete_games(state, games.select("id"))
    headers = state["headers"].join(gone.select(F.col("id").alias("system_id")), "system_id", "left_semi")
    out["headers"] = deleted(state["headers"], headers)
    out["rules"] = deleted(state["rules"], headers.select(F.col("id").alias("header_id")), ["header_id"])
    out["systems"] = deleted(state["systems"], gone)
    return out


def delete_games(state: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Entries with their clones of all levels, and their items and patches."""
    every = level = settle(gone.select("id").distinct(), "level")
    tree = state["games"].where("parent_id is not null").select("id", "parent_id")
    while not level.isEmpty():
        level = tree.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").distinct()
        level = settle(level.join(every, "id", "left_anti"), "level")
        every = every.unionByName(level)
    roms = state["roms"].join(every.select(F.col("id").alias("game_id")), "game_id", "left_semi").select("id")
    return state | {
        "games": deleted(state["games"], every), "roms": deleted(state["roms"], roms), "patches": deleted(state["patches"], roms.select(F.col("id").alias("rom_id")), ["rom_id"]),
    }


def delete_romfiles(state: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Stored files; what pointed to them points nowhere, and their patches go."""
    return state | {
        "romfiles": _nulled(deleted(state["romfiles"], gone), "parent_id", gone), "roms": _nulled(state["roms"], "romfile_id", gone),
        "games": _nulled(state["games"], "playlist_id", gone), "patches": deleted(state["patches"], gone.select(F.col("id").alias("romfile_id")), ["romfile_id"]),
    }


def wanted_update(have: DataFrame, offered: DataFrame) -> DataFrame:
    """(name, status) of each collection: update, current, or gone when it is no longer offered. Both: name, version."""
    met = have.join(offered.select("name", F.col("version").alias("offered")), "name", "left")
    return met.select("name", F.when(F.col("offered").isNull(), "gone").when(F.col("offered") > F.col("version"), "update").otherwise("current").alias("status"))


def resolved_parents(catalogue: DataFrame) -> DataFrame:
    """Entries with the names of their parent and bios, and the wave in which they can be imported.

    ``catalogue``: name, cloneof, romof, bios. A parent is named by cloneof, else
    by romof; entries whose chain never ends at one without a parent are left out.
    """
    rows = catalogue.withColumn("parent", F.coalesce("cloneof", "romof"))
    done = rows.where("parent is null").select("name", F.lit(0).alias("wave"))
    level, wave = done, 0
    while True:
        wave += 1
        level = rows.where("parent is not null").join(level.select(F.col("name").alias("parent")), "parent", "left_semi").select("name", F.lit(wave).alias("wave"))
        level = settle(level.join(done, "name", "left_anti"), "wave")
        if level.isEmpty():
            break
        done = done.unionByName(level)
    out = rows.join(done.groupBy("name").agg(F.min("wave").alias("wave")), "name").distinct()
    parent = rows.where("not bios").select(F.col("name").alias("_p")).distinct()
    bios = rows.where("bios").select(F.col("name").alias("_b")).distinct()
    out = out.join(parent, F.col("parent") == F.col("_p"), "left").join(bios, F.col("romof") == F.col("_b"), "left")
    return out.select("name", F.col("_p").alias("parent_name"), F.col("_b").alias("bios_name"), "wave")


def changed_roms(old: DataFrame, new: DataFrame) -> DataFrame:
    """(game_id, name, change) of a catalogue's items: added, removed, changed or same.

    Checksums compare in lower case; an unknown one changes nothing. Changed
    items lose their file and are matched again.
    """
    a = old.select("game_id", "name", F.col("size").alias("s0"), F.lower("crc").alias("c0"), F.lit(True).alias("was"))
    b = new.select("game_id", "name", F.col("size").alias("s1"), F.lower("crc").alias("c1"), F.lit(True).alias("is_now"))
    met = a.join(b, ["game_id", "name"], "full")
    differs = (F.col("s0") != F.col("s1")) | F.coalesce(F.col("c0") != F.col("c1"), F.lit(False))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "removed").when(differs, "changed").otherwise("same")
    return met.select("game_id", "name", change.alias("change"))


def flag(column: Column) -> Column:
    """Catalogue attribute to boolean."""
    return F.coalesce(column == "yes", F.lit(False))
