"""Ranking the variants of a family, electing one of them, and sorting entries into classes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stocktake.functions import names
from stocktake.schema import ALL_REGIONS, FULL, IGNORED, ONE_REGION

#: Java checks comparators for consistency from this many elements on.
COMPARED = 32


@dataclass(frozen=True)
class Preferences:
    """What the election prefers. Regions: none, broad or narrow; versions: none, new or old."""

    parents: bool = False
    regions: str = "none"
    versions: str = "none"
    flags: tuple[str, ...] = ()
    one_regions: tuple[str, ...] = ()
    all_regions: tuple[str, ...] = ()
    strict: bool = False
    languages: tuple[str, ...] = ()
    ignored_releases: tuple[str, ...] = ()
    ignored_flags: tuple[str, ...] = ()


def votes(a: Column, b: Column, prefer: Preferences) -> Column:
    """Votes for ``a`` less votes for ``b``: pairwise, as the criteria do not add up to one key."""
    net = F.lit(0)
    if prefer.parents:
        net = net + F.when(a["parentless"], 1).when(b["parentless"], -1).otherwise(0)
    if prefer.regions != "none":
        sign = 1 if prefer.regions == "broad" else -1
        net = net + sign * F.signum(a["breadth"] - b["breadth"]).cast("int")
    if prefer.versions != "none":
        sign = 1 if prefer.versions == "new" else -1
        va, vb = a["version"], b["version"]
        order = F.when(va.isNotNull() & vb.isNotNull(), F.when(va > vb, 1).when(va < vb, -1).otherwise(0)).when(va.isNotNull(), 1).when(vb.isNotNull(), -1).otherwise(0)
        net = net + sign * order
    if prefer.flags:
        net = net + a["liked"] - b["liked"]
    return net


def ranked(games: DataFrame, prefer: Preferences) -> DataFrame:
    """``games`` with ``family`` (its parent, else itself) and ``place`` (from 0) within it.

    Members start in order of name, the parent last, and are sorted by pairwise
    votes. Votes of several criteria need not be transitive; families too large
    for a comparator then rank by their net votes over all members.
    """
    liked = F.size(F.filter(names.flag_parts(F.col("name")), lambda f: f.isin(*prefer.flags))) if prefer.flags else F.lit(0)
    member = F.struct(
        F.col("parent_id").isNull().alias("parentless"), F.col("name").alias("name"), F.col("id").alias("id"), F.size(F.split("regions", "-")).alias("breadth"), names.version(F.col("name")).alias("version"), liked.alias("liked")
    )
    family = F.coalesce("parent_id", "id")
    grouped = games.withColumn("_m", member).groupBy(family.alias("family")).agg(F.sort_array(F.collect_list("_m")).alias("_all"))
    compared = F.array_sort("_all", lambda a, b: -F.signum(votes(a, b, prefer)).cast("int"))
    worth = lambda x: F.aggregate("_all", F.lit(0), lambda n, y: n + votes(x, y, prefer))
    summed = F.transform(F.sort_array(F.transform("_all", lambda x, i: F.struct((-worth(x)).alias("w"), i.alias("i"), x.alias("m")))), lambda s: s["m"])
    placed = grouped.select("family", F.posexplode(F.when(F.size("_all") < COMPARED, compared).otherwise(summed)).alias("place", "_m")).select("family", "place", F.col("_m.id").alias("id"))
    return games.join(placed, "id")


def sorted_games(games: DataFrame, prefer: Preferences, arcade: Column | None = None) -> DataFrame:
    """``games`` with their new ``sorting``.

    With one-region preferences each family elects at most one member: for the
    first region that an eligible member has, the first member in rank. What is
    left goes by the list of all regions; Unknown (ZZ) there takes everything.
    Without them, the list alone decides.
    """
    arcade = F.lit(False) if arcade is None else arcade
    games = games.drop("sorting").withColumn("_trim", names.ignored(F.col("name"), F.col("comment"), arcade, prefer.languages, prefer.ignored_releases, prefer.ignored_flags))
    regions = F.split("regions", "-")
    listed = F.arrays_overlap(regions, F.array(*map(F.lit, prefer.all_regions))) if prefer.all_regions else F.lit(False)
    if not prefer.one_regions:
        kept = F.when(F.col("_trim"), IGNORED).when(listed, ALL_REGIONS).otherwise(IGNORED if prefer.all_regions else ALL_REGIONS)
        return games.withColumn("sorting", kept).drop("_trim")
    rows = ranked(games, prefer)
    someone = F.max(~F.col("_trim") & (F.col("completion") == FULL)).over(W.partitionBy("family"))
    rows = rows.withColumn("_eligible", ~F.col("_trim") & ((F.col("completion") == FULL) | F.lit(prefer.strict) | ~someone))
    at = F.array_min(F.filter(F.transform(F.array(*map(F.lit, prefer.one_regions)), lambda r, i: F.when(F.array_contains(regions, r), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("_region", F.when(F.col("_eligible"), at))
    best = F.min(F.when(F.col("_region").isNotNull(), F.struct("_region", "place", "id"))).over(W.partitionBy("family"))
    elected = F.coalesce(best["id"] == F.col("id"), F.lit(False))
    everything = listed | F.lit("ZZ" in prefer.all_regions)
    sorting = F.when(F.col("_trim"), IGNORED).when(elected, ONE_REGION).when(everything, ALL_REGIONS).otherwise(IGNORED)
    return rows.withColumn("sorting", sorting).drop("_trim", "_eligible", "_region")


def changed_sorting(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries whose sorting changes: id, before, after."""
    return old.select("id", F.col("sorting").alias("before")).join(new.select("id", F.col("sorting").alias("after")), "id").where("before <> after")


def wanted(games: DataFrame, roms: DataFrame) -> DataFrame:
    """Missing items of kept entries that are not full, with the first checksum known."""
    kept = games.where((F.col("sorting") != IGNORED) & (F.col("completion") != FULL)).select(F.col("id").alias("game_id"), F.col("name").alias("game"))
    return roms.where("romfile_id is null and parent_id is null").join(kept, "game_id").select("id", "game", F.col("name").alias("rom"), "size", F.coalesce("crc", "md5", "sha1").alias("checksum"))


def region_list(value: str, keep_order: bool) -> Sequence[str]:
    """A stored list; election order is the user's, other lists are sets in order."""
    items = [x for x in value.split("|") if x]
    return items if keep_order else sorted(set(items))
