"""Point and list access to the model's tables. All order is binary, as Spark's default is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.schema import FULL, IGNORED, PARTIAL


def like_ci(column: Column | str, pattern: str) -> Column:
    """LIKE without regard to ASCII case, where a backslash is an ordinary character."""
    return F.col(column).ilike(pattern.replace("\\", "\\\\")) if isinstance(column, str) else column.ilike(pattern.replace("\\", "\\\\"))


def system_key(name: Column) -> Column:
    """A collection's name without its parent-clone mark."""
    return F.replace(name, F.lit(" (Parent-Clone)"), F.lit(""))


def systems(df: DataFrame, *, arcade: bool | None = None, url: str | None = None, name_like: str | None = None, name: str | None = None, id: int | None = None) -> DataFrame:
    if arcade is not None:
        df = df.where(F.col("arcade") == arcade)
    if url is not None:
        df = df.where(F.col("url") == url)
    if name_like is not None:
        df = df.where(like_ci("name", name_like))
    if name is not None:
        df = df.where(system_key(F.col("name")) == name.replace(" (Parent-Clone)", ""))
    if id is not None:
        df = df.where(F.col("id") == id)
    return df.orderBy("name")


def games(
    df: DataFrame, *, system_id: int | None = None, wanted: bool = False, ids: Sequence[int] | None = None, parents: bool | None = None, completion: int | None = None,
    name_like: str | None = None, name: str | None = None, bios: bool | None = None, jbfolder: bool | None = None, sorting: int | None = None,
) -> DataFrame:
    """Entries by any mix of conditions, in order of name. ``parents``: True for entries without a parent, False for clones."""
    for column, value in (("system_id", system_id), ("completion", completion), ("name", name), ("bios", bios), ("jbfolder", jbfolder), ("sorting", sorting)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if wanted:
        df = df.where(F.col("sorting") != IGNORED)
    if ids is not None:
        df = df.where(F.col("id").isin(*ids))
    if parents is not None:
        df = df.where(F.col("parent_id").isNull() if parents else F.col("parent_id").isNotNull())
    if name_like is not None:
        df = df.where(like_ci("name", name_like))
    return df.orderBy("name")


def partial_games(df: DataFrame) -> DataFrame:
    return games(df, completion=PARTIAL)


def full_games(df: DataFrame, name_like: str | None = None) -> DataFrame:
    return games(df, completion=FULL, name_like=name_like)


OWN = "parent_id is null"
OWN_OR_INHERITED = "parent_id is null or (parent_id is not null and not bios)"
INHERITED = "parent_id is not null"
INHERITED_BIOS = "parent_id is not null and bios"


def roms(df: DataFrame, scope: str = "true", **equal) -> DataFrame:
    """Items within a scope, by equality on any columns."""
    df = df.where(scope)
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    return df.orderBy("name")


def missing_roms(df: DataFrame, games: DataFrame) -> DataFrame:
    return df.where("romfile_id is null and parent_id is null").join(games.select(F.col("id").alias("game_id")), "game_id", "left_semi").select(*df.columns)


def present_roms(df: DataFrame, games: DataFrame, original: bool = False) -> DataFrame:
    df = df.where("romfile_id is not null and original" if original else "romfile_id is not null")
    return df.join(games.select(F.col("id").alias("game_id")), "game_id", "left_semi").select(*df.columns)


def first_rom(df: DataFrame, *keys: str) -> DataFrame:
    """For lookups that take the first row met: the least id of each key."""
    return df.groupBy(*keys).agg(F.min("id").alias("id"))


def trashed_romfiles(df: DataFrame, include_global: bool = False) -> DataFrame:
    inner = like_ci("path", "%/Trash/%")
    return df.where(inner | like_ci("path", "Trash/%") if include_global else inner).orderBy("path")


def region_member(regions: Column, region: str) -> Column:
    return F.array_contains(F.split(regions, "-"), region)


def ui_games(df: DataFrame, *, full: bool = True, partial: bool = True, none: bool = True, ignored: bool = True, one_region_only: bool = False, text: str = "") -> DataFrame:
    """The browser's stack of filters."""
    for keep, code in ((full, 2), (partial, 1), (none, 0)):
        if not keep:
            df = df.where(F.col("completion") != code)
    if not ignored:
        df = df.where(F.col("sorting") != IGNORED)
    if one_region_only:
        df = df.where("sorting = 1")
    return df.where(F.contains(F.lower("name"), F.lit(text.lower()))) if text else df


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """Page ``number`` from 1, after a total order."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def pages(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("bigint").alias("pages"))
