"""Settings: typed reads, changes and their validation. One row per key, so the table stays small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "|"
# Keys by type, with their choices and ranges.
BOOLEANS = ("CHD_PARENTS", "GROUP_SUBSYSTEMS", "PREFER_PARENTS", "REGIONS_ONE_STRICT", "RVZ_SCRUB", "SEVENZIP_SOLID_COMPRESSION")
CHOICES = {
    "PREFER_REGIONS": ("none", "broad", "narrow"),
    "PREFER_VERSIONS": ("none", "new", "old"),
    "REGIONS_ALL_SUBFOLDERS": ("none", "alpha"),
    "REGIONS_ONE_SUBFOLDERS": ("none", "alpha"),
    "RVZ_COMPRESSION_ALGORITHM": ("none", "zstd", "bzip", "lzma", "lzma2"),
}
CHOICE_LISTS = {
    "CHD_CD_COMPRESSION_ALGORITHMS": ("none", "cdfl", "cdlz", "cdzl", "cdzs"),
    "CHD_DVD_COMPRESSION_ALGORITHMS": ("none", "flac", "huff", "lzma", "zlib", "zstd"),
    "CHD_HD_COMPRESSION_ALGORITHMS": ("none", "flac", "huff", "lzma", "zlib", "zstd"),
    "CHD_LD_COMPRESSION_ALGORITHMS": ("none", "avhu"),
    "REGIONS_ALL_ARCADE": ("bios", "clone", "parent"),
    "REGIONS_ONE_ARCADE": ("bios", "clone", "parent"),
}
RANGES = {
    "CHD_CD_HUNK_SIZE": (16, 1048576), "CHD_DVD_HUNK_SIZE": (16, 1048576), "CHD_HD_HUNK_SIZE": (16, 1048576), "CHD_LD_HUNK_SIZE": (16, 1048576),
    "RVZ_BLOCK_SIZE": (32, 2048), "RVZ_COMPRESSION_LEVEL": (1, 22), "SEVENZIP_COMPRESSION_LEVEL": (1, 9), "ZIP_COMPRESSION_LEVEL": (1, 9),
}


def setting(settings: DataFrame, key: str) -> DataFrame:
    return settings.where(F.col("key") == key)


def as_bool(value: Column) -> Column:
    return F.lower(value).isin("true", "1", "yes")


def as_list(value: Column) -> Column:
    """The items of a list setting; none for null or empty."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), "[|]"), lambda x: x != "")


def _changed(settings: DataFrame, key: str, value: Column) -> DataFrame:
    return settings.withColumn("value", F.when(F.col("key") == key, value).otherwise(F.col("value")))


def set_value(settings: DataFrame, key: str, value: str | None) -> DataFrame:
    """The key with a value, which replaces the one it had; null unsets it."""
    return _changed(settings, key, F.lit(value).cast("string"))


def add_to_list(settings: DataFrame, key: str, item: str) -> DataFrame:
    """The item at the end of the key's list, unless it is in it; lists are sorted."""
    return _changed(settings, key, F.array_join(F.array_sort(F.array_union(as_list(F.col("value")), F.array(F.lit(item)))), SEPARATOR))


def remove_from_list(settings: DataFrame, key: str, item: str) -> DataFrame:
    """The key's list without the item; null if nothing is left."""
    left = F.array_remove(as_list(F.col("value")), item)
    return _changed(settings, key, F.when(F.size(left) > 0, F.array_join(left, SEPARATOR)))


def invalid(settings: DataFrame, choices: dict[str, Sequence[str]], ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, value) of settings outside their choices (any item of a list) or ranges; nulls are valid."""
    bad = F.lit(False)
    for key, allowed in choices.items():
        bad |= (F.col("key") == key) & (F.size(F.array_except(as_list(F.col("value")), F.array(*map(F.lit, allowed)))) > 0)
    for key, (low, high) in ranges.items():
        number = F.expr("try_cast(value as bigint)")
        bad |= (F.col("key") == key) & ~F.coalesce(number.between(low, high), F.lit(False))
    return settings.where(F.col("value").isNotNull() & bad).select("key", "value")


def rejected(settings: DataFrame) -> DataFrame:
    """(key, value) of settings that break the rules of their key: choices, lists of choices, ranges, and true or false."""
    single = F.lit(False)
    for key, allowed in CHOICES.items():
        single |= (F.col("key") == key) & ~F.col("value").isin(*allowed)
    single |= F.col("key").isin(*BOOLEANS) & ~F.col("value").isin("true", "false")
    listed = invalid(settings, CHOICE_LISTS, RANGES)
    return listed.unionByName(settings.where(F.col("value").isNotNull() & single).select("key", "value"))
