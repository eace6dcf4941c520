"""Content matching: files to expected items by size and checksum.

One equi-join on (size, checksum) replaces the cascade of lookups; which of the
narrower lookups would have hit is a computed tier, and the least tier wins. The
k-th file of a key takes the k-th item, so that each item is used once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stocktake.functions.similarity import jaro_winkler_udf
from stocktake.state import settle

VALID, DUPLICATE, INVALID = "valid", "duplicate", "invalid"
KEY = ["size", "digest"]


def hash_rows(roms: DataFrame, *algorithms: str) -> DataFrame:
    """(id, game_id, name, size, algorithm, digest, open): a row per checksum that an item has.

    Open items are missing and not inherited; the rest are present ones.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(a).alias("algorithm"), F.lower(F.col(a)).alias("digest")) for k, a in enumerate(algorithms or ("crc", "md5", "sha1"))])
    rows = roms.withColumn("_h", F.explode(pairs)).where("_h.digest is not null")
    return rows.select("id", "game_id", "name", "size", "_h.rank", "_h.algorithm", "_h.digest", F.expr("romfile_id is null and parent_id is null").alias("open"), F.expr("romfile_id is not null").alias("present"))


def candidates(files: DataFrame, roms: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """(file, rom, tier): open items of equal size and checksum.

    ``files``: file, size, algorithm, digest, and the names it is known by: rom_name, game_names.
    Tier 1: item and entry names agree; 2: the entry's does; 3: only the content.
    """
    named = roms if "game" in roms.columns else roms.withColumn("game", F.lit(None).cast("string"))
    met = files.join(named.where("open"), ["size", "algorithm", "digest"])
    in_games = F.coalesce(F.array_contains("game_names", F.col("game")), F.lit(False))
    tier = F.when(in_games & (F.col("rom_name") == F.col("name")), 1).when(in_games, 2).otherwise(3)
    met = met.select("file", F.col("id").alias("rom"), "game_id", "name", tier.alias("tier"))
    best = met.groupBy("file").agg(F.min("tier").alias("tier"))
    return met.join(best, ["file", "tier"])


def closest(found: DataFrame, legacy_order: bool = False) -> DataFrame:
    """Of several items of one tier, the one named most like the file. ``found`` has ``wanted``; ``legacy_order`` takes the least like."""
    if not legacy_order:
        # An equal name is the closest there is; only files without one are compared.
        equal = found.where("wanted = name").groupBy("file").agg(F.min("rom").alias("rom"))
        exact = found.join(equal, ["file", "rom"]).where("wanted = name").withColumn("likeness", F.lit(1.0))
        found = found.join(equal.select("file"), "file", "left_anti")
    scored = found.withColumn("likeness", jaro_winkler_udf("wanted", "name"))
    order = F.col("likeness").asc() if legacy_order else F.col("likeness").desc()
    best = scored.withColumn("_k", F.row_number().over(W.partitionBy("file").orderBy(order, "rom"))).where("_k = 1").drop("_k")
    return best if legacy_order else best.unionByName(exact.select(*best.columns))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """``df`` with ``_k``, the place from 1 of each row among those of equal ``keys``, in ``order``.

    Rows are parted by ranges of (keys, order), so that one key may fill many
    tasks; the places of a part begin where the parts before it end. Given
    ``known`` (distinct keys), ``_known`` says whether it holds the row's key.
    Rows with a null key have places too, and are not known.
    """
    columns = df.columns
    ranged = df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id())
    ranged = settle(ranged, "numbered").withColumn("_i", F.row_number().over(W.partitionBy("_p", *keys).orderBy(*order)))
    part = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("_p", *keys).agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(part), F.lit(0))).drop("_n")
    if known is not None:
        starts = starts.join(known.select(*keys, F.lit(True).alias("_known")), list(keys), "left")
    starts = starts.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_q_{c}") for c in keys], "_b", *(["_known"] if known is not None else []))
    same = F.col("_p") == F.col("_q")
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    place = (F.col("_i") + F.col("_b")).cast("bigint").alias("_k")
    return ranged.join(starts, same).select(*columns, place, *([F.coalesce("_known", F.lit(False)).alias("_known")] if known is not None else []))


def assigned(files: DataFrame, items: DataFrame) -> DataFrame:
    """(file, rom, state) when every file may take one item of its (size, digest).

    Keys are numbered on both sides and met once; files in excess are duplicates,
    files of a key without any item invalid.
    """
    f = numbered(files, KEY, ["file"], items.select(*KEY).distinct())
    i = numbered(items, KEY, ["rom"])
    met = f.join(i.select(*KEY, "_k", "rom"), [*KEY, "_k"], "left")
    return met.select("file", "rom", F.when(F.col("rom").isNotNull(), VALID).when(F.col("_known"), DUPLICATE).otherwise(INVALID).alias("state"))


def missing_items(files: DataFrame, roms: DataFrame, algorithm: str, names: str | None = None, systems: DataFrame | None = None) -> DataFrame:
    """(file, rom): open items of a file's size and checksum.

    ``files``: file, size, a column named like the algorithm, rom_name, game_names;
    ``roms`` has game and system_id. ``names``: None for the content alone,
    ``game`` for items of entries named so, ``item`` for those whose own name
    agrees too. ``systems``: system_id of the collections searched, else all.
    """
    items = roms.where("romfile_id is null and parent_id is null")
    items = items if systems is None else items.join(systems.select("system_id"), "system_id", "left_semi")
    items = items.select("size", F.lower(algorithm).alias("digest"), F.col("id").alias("rom"), "name", "game")
    wanted = files.select("file", "size", F.lower(algorithm).alias("digest"), "rom_name", "game_names")
    if names is None:
        met = wanted.join(items, KEY)
    else:
        # Names are part of the key, so that a content many entries share is not paired with all of them.
        wanted = wanted.withColumn("game", F.explode(F.array_distinct("game_names")))
        met = wanted.join(items, [*KEY, "game"]) if names == "game" else wanted.withColumnRenamed("rom_name", "name").join(items, [*KEY, "game", "name"])
    return met.select("file", "rom")


def present_items(files: DataFrame, roms: DataFrame, algorithm: str, systems: DataFrame | None = None) -> DataFrame:
    """(file, n): how many items of a file's size and checksum have a file already."""
    items = roms.where("romfile_id is not null")
    items = items if systems is None else items.join(systems.select("system_id"), "system_id", "left_semi")
    counts = items.groupBy("size", F.lower(algorithm).alias("digest")).agg(F.count("*").alias("n"))
    return files.select("file", "size", F.lower(algorithm).alias("digest")).join(counts, KEY).select("file", "n")


def present_counts(roms: DataFrame, algorithm: str) -> DataFrame:
    """Present items by (size, checksum)."""
    return hash_rows(roms, algorithm).where("present").groupBy("size", "digest").agg(F.count("*").alias("n"))


def by_system(roms: DataFrame, games: DataFrame) -> DataFrame:
    return roms.join(games.select(F.col("id").alias("game_id"), "system_id", F.col("name").alias("game")), "game_id")


def anchors(roms: DataFrame, games: DataFrame, name: str, size: int, md5: str, present: bool = False) -> DataFrame:
    """Inherited items that anchor a folder, by name, size and MD5, in order of entry name."""
    state = F.col("romfile_id").isNotNull() if present else F.col("romfile_id").isNull()
    rows = roms.where((F.col("name") == name) & (F.col("size") == size) & (F.col("md5") == md5) & F.col("parent_id").isNotNull() & state)
    return by_system(rows, games).orderBy("game")


def children(roms: DataFrame, parents: DataFrame) -> DataFrame:
    """Missing items by (size, md5) under each parent."""
    return roms.where("romfile_id is null").join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").groupBy("parent_id", "size", "md5").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def set_cover(members: DataFrame, roms: DataFrame, superset: bool = False) -> DataFrame:
    """Archives that stay whole: their members match all own items of one entry and nothing else.

    ``members``: archive, member, size, digest; ``roms``: id, game_id, size, digest. With
    ``superset`` further members do no harm.
    """
    total = members.groupBy("archive").agg(F.count("*").alias("members"))
    needed = roms.groupBy("game_id").agg(F.count_distinct("id").alias("needed"))
    met = members.join(roms, ["size", "digest"]).groupBy("archive", "game_id").agg(F.count_distinct("id").alias("items"), F.count_distinct("member").alias("matched"))
    whole = met.join(needed, "game_id").where("items = needed").join(total, "archive")
    whole = whole if superset else whole.where("matched = members")
    games = met.groupBy("archive").agg(F.count("*").alias("games"))
    return whole.join(games, "archive").where("games = 1").select("archive", "game_id", "members")
