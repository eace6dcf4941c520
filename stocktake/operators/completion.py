"""Completion of entries and collections, counts and sizes.

Every variant is one conditional aggregate over the items and a left join from
the entries, so entries without items count as full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.schema import FULL, IGNORED, NONE, PARTIAL

_PS3 = "lower(name) like 'ps3_content/%' or lower(name) like 'ps3_extra/%' or lower(name) like 'ps3_update/%'"


def state(missing: Column, present: Column) -> Column:
    return F.when(F.coalesce(missing, F.lit(0)) == 0, FULL).when(F.coalesce(present, F.lit(0)) == 0, NONE).otherwise(PARTIAL)


def _rolled(games: DataFrame, roms: DataFrame, missing: Column, present: Column) -> DataFrame:
    counted = roms.groupBy("game_id").agg(F.count_if(missing & F.col("romfile_id").isNull()).alias("_m"), F.count_if(present & F.col("romfile_id").isNotNull()).alias("_p"))
    return games.drop("completion").join(counted.withColumnRenamed("game_id", "id"), "id", "left").withColumn("completion", state(F.col("_m"), F.col("_p"))).drop("_m", "_p")


def plain(games: DataFrame, roms: DataFrame) -> DataFrame:
    every = F.lit(True)
    return _rolled(games, roms, every, every)


def split(games: DataFrame, roms: DataFrame) -> DataFrame:
    own = F.col("parent_id").isNull()
    return _rolled(games, roms, own, own)


def _with_source(games: DataFrame, roms: DataFrame) -> DataFrame:
    """Items with ``taken``: whether they are inherited from an entry that is no bios."""
    source = roms.select(F.col("id").alias("parent_id"), F.col("game_id").alias("_g")).join(games.where("not bios").select(F.col("id").alias("_g")), "_g").select("parent_id", F.lit(True).alias("taken"))
    return roms.join(source, "parent_id", "left")


def non_merged(games: DataFrame, roms: DataFrame) -> DataFrame:
    counts = F.col("parent_id").isNull() | F.coalesce("taken", F.lit(False))
    return _rolled(games, _with_source(games, roms), counts, counts)


def jbfolder(games: DataFrame, roms: DataFrame) -> DataFrame:
    """The missing side looks at inherited items outside three folders, the present side at all."""
    wanted = F.col("parent_id").isNotNull() & ~F.expr(_PS3)
    return _rolled(games, roms, wanted, F.lit(True))


def dispatched(systems: DataFrame, games: DataFrame, roms: DataFrame) -> DataFrame:
    """Each entry by the rule of its collection, in one pass over the items."""
    own = F.col("parent_id").isNull()
    taken = own | F.coalesce("taken", F.lit(False))
    inherited = F.col("parent_id").isNotNull() & ~F.expr(_PS3)
    here, gone = F.col("romfile_id").isNotNull(), F.col("romfile_id").isNull()
    counted = _with_source(games, roms).groupBy(F.col("game_id").alias("id")).agg(
        F.count_if(gone).alias("m_all"), F.count_if(here).alias("p_all"), F.count_if(gone & own).alias("m_own"), F.count_if(here & own).alias("p_own"),
        F.count_if(gone & taken).alias("m_taken"), F.count_if(here & taken).alias("p_taken"), F.count_if(gone & inherited).alias("m_jb"),
    )
    rows = games.drop("completion").join(systems.select(F.col("id").alias("system_id"), "arcade", "merging"), "system_id").join(counted, "id", "left")
    by_merging = F.when(F.col("merging") == 0, state(F.col("m_own"), F.col("p_own"))).when(F.col("merging").isin(1, 2), state(F.col("m_taken"), F.col("p_taken"))).otherwise(state(F.col("m_all"), F.col("p_all")))
    simple = F.when(F.col("jbfolder"), state(F.col("m_jb"), F.col("p_all"))).otherwise(state(F.col("m_all"), F.col("p_all")))
    return rows.select(*[c for c in games.columns if c != "completion"], F.when(F.col("arcade"), by_merging).otherwise(simple).alias("completion"))


def of_systems(systems: DataFrame, games: DataFrame) -> DataFrame:
    """Collections over their wanted entries; one without any is full."""
    counted = games.where(F.col("sorting") != IGNORED).groupBy(F.col("system_id").alias("id")).agg(F.count_if(F.col("completion") != FULL).alias("_short"), F.count_if(F.col("completion") != NONE).alias("_some"))
    done = F.when(F.coalesce("_short", F.lit(0)) == 0, FULL).when(F.coalesce("_some", F.lit(0)) == 0, NONE).otherwise(PARTIAL)
    return systems.drop("completion").join(counted, "id", "left").withColumn("completion", done).drop("_short", "_some")


def original_sizes(systems: DataFrame, games: DataFrame, roms: DataFrame) -> DataFrame:
    """Bytes of present items of each collection, of all entries and of one-region ones, in one pass."""
    inside = roms.where("romfile_id is not null").select("game_id", "size").join(games.select(F.col("id").alias("game_id"), "system_id", "sorting"), "game_id")
    summed = inside.groupBy(F.col("system_id").alias("id")).agg(F.sum("size").alias("t"), F.sum(F.when(F.col("sorting") == 1, F.col("size"))).alias("o"))
    zero = F.lit(0).cast("bigint")
    return systems.select("id").join(summed, "id", "left").select("id", F.coalesce("t", zero).alias("total_original_size"), F.coalesce("o", zero).alias("one_region_original_size"))


def actual_sizes(systems: DataFrame, games: DataFrame, roms: DataFrame, romfiles: DataFrame) -> DataFrame:
    """Bytes of the distinct files behind present items; a file counts once per collection."""
    used = roms.where("romfile_id is not null").select("game_id", F.col("romfile_id").alias("file")).join(games.select(F.col("id").alias("game_id"), "system_id", "sorting"), "game_id")
    used = used.groupBy("system_id", "file").agg(F.max(F.col("sorting") == 1).alias("one"))
    summed = used.join(romfiles.select(F.col("id").alias("file"), "size"), "file").groupBy(F.col("system_id").alias("id")).agg(F.sum("size").alias("t"), F.sum(F.when(F.col("one"), F.col("size"))).alias("o"))
    zero = F.lit(0).cast("bigint")
    return systems.select("id").join(summed, "id", "left").select("id", F.coalesce("t", zero).alias("total_actual_size"), F.coalesce("o", zero).alias("one_region_actual_size"))


def ignored_roms(systems: DataFrame, games: DataFrame, roms: DataFrame) -> DataFrame:
    """(id, ignored): by the entry's sorting, and in arcade collections by merging mode for inherited items."""
    source = roms.select(F.col("id").alias("parent_id"), F.col("game_id").alias("_g")).join(games.select(F.col("id").alias("_g"), F.col("bios").alias("_bios")), "_g").select("parent_id", "_bios")
    rows = roms.select("id", "game_id", "parent_id").join(games.select(F.col("id").alias("game_id"), "system_id", "sorting"), "game_id")
    rows = rows.join(systems.select(F.col("id").alias("system_id"), "arcade", "merging"), "system_id").join(source, "parent_id", "left")
    arcade = F.when(F.col("merging") == 0, True).when(F.col("merging").isin(1, 2), F.coalesce("_bios", F.lit(False))).otherwise(False)
    return rows.select("id", F.when(F.col("sorting") == IGNORED, True).when(~F.col("arcade") | F.col("parent_id").isNull(), False).otherwise(arcade).alias("ignored"))
