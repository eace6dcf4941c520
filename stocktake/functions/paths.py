"""Parts of paths, checks of versions and times on discs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocktake.schema import NON_ORIGINAL_EXTENSIONS


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Without the dot, as written; empty without one. A leading dot makes no extension."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def is_original(path: Column) -> Column:
    return (extension(path) != "") & ~extension(path).isin(*NON_ORIGINAL_EXTENSIONS)


def alpha_folder(name: Column) -> Column:
    return F.when(name.rlike("^[A-Za-z]"), F.upper(F.substring(name, 1, 1))).otherwise("#")


def trashed_name(path: Column, algorithm: Column, digest: Column) -> Column:
    tail = F.when(extension(path) != "", F.concat(F.lit("."), extension(path))).otherwise("")
    return F.concat(stem(path), F.lit(" ["), algorithm, F.lit(":"), digest, F.lit("]"), tail)


def frames(minutes: Column, seconds: Column, rest: Column) -> Column:
    return rest + 75 * seconds + 4500 * minutes


def newer(have: Column, offered: Column) -> Column:
    """Whether the offered version is newer; versions compare as strings."""
    return offered > have
