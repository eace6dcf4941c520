"""Conversion, export, rebuild and playlist plans: what would be done to which files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stocktake.schema import ARCHIVE_EXTENSIONS

_DECODED = ("chd", "cso", "nsz", "rvz", "zso")
_PACKED = ("7z", "zip")
#: For each target, the classes it takes in order of precedence, and the action on each.
CONVERT = {
    "ORIGINAL": dict.fromkeys(_PACKED, "extract") | dict.fromkeys(_DECODED, "decode"),
    "7Z": dict.fromkeys(_DECODED, "archive decoded") | {"zip": "rearchive", "7z": "recompress", "other": "archive"},
    "ZIP": dict.fromkeys(_DECODED, "archive decoded") | {"7z": "rearchive", "zip": "recompress", "other": "archive"},
    "CHD": dict.fromkeys(_PACKED, "encode extracted") | {"cue": "encode", "iso": "encode", "cso": "encode decoded", "zso": "encode decoded", "chd": "recompress", "rdsk": "encode", "riff": "encode"},
    "CSO": dict.fromkeys(_PACKED, "encode extracted") | {"iso": "encode", "chd": "encode decoded", "cso": "recompress", "zso": "encode decoded"},
    "NSZ": dict.fromkeys(_PACKED, "encode extracted") | {"nsp": "encode", "nsz": "recompress"},
    "RVZ": dict.fromkeys(_PACKED, "encode extracted") | {"iso": "encode", "rvz": "recompress"},
    "ZSO": dict.fromkeys(_PACKED, "encode extracted") | {"iso": "encode", "chd": "encode decoded", "cso": "encode decoded", "zso": "recompress"},
}
EXPORT = {
    "ORIGINAL": dict.fromkeys(_PACKED, "extract") | dict.fromkeys(_DECODED, "decode") | {"other": "copy"},
    "7Z": dict.fromkeys(_DECODED, "archive decoded") | {"zip": "rearchive", "7z": "copy", "other": "archive"},
    "ZIP": dict.fromkeys(_DECODED, "archive decoded") | {"7z": "rearchive", "zip": "copy", "other": "archive"},
    "CHD": dict.fromkeys(_PACKED, "encode extracted") | {"cue": "encode", "iso": "encode", "cso": "encode decoded", "zso": "encode decoded", "chd": "copy"},
    "CSO": dict.fromkeys(_PACKED, "encode extracted") | {"iso": "encode", "chd": "encode decoded", "cso": "copy", "zso": "encode decoded"},
    "ZSO": dict.fromkeys(_PACKED, "encode extracted") | {"iso": "encode", "chd": "encode decoded", "zso": "copy"},
    "NSZ": dict.fromkeys(_PACKED, "encode extracted") | {"nsp": "encode"},
    "RVZ": dict.fromkeys(_PACKED, "encode extracted") | {"iso": "encode", "rvz": "copy"},
    "WBFS": dict.fromkeys(_PACKED, "encode extracted") | {"iso": "encode", "rvz": "encode decoded"},
    "ISO": dict.fromkeys(_PACKED, "extract") | {"cue": "encode", "iso": "copy", "chd": "decode", "cso": "decode", "zso": "decode"},
    "GDI": dict.fromkeys(_PACKED, "encode extracted") | {"cue": "encode", "chd": "encode decoded", "gdi": "copy"},
}
ARCADE_TARGETS = ("ORIGINAL", "ZIP")
#: (target, class) -> the extension of which the entry must have exactly one item, and no other where the flag is set.
CONVERT_SINGLE = {(t, c): ("iso", True) for t in ("CSO", "ZSO") for c in (*_PACKED, "chd")} | {("NSZ", c): ("nsp", True) for c in _PACKED} | {("RVZ", c): ("iso", True) for c in _PACKED}
EXPORT_SINGLE = {("ISO", "cue"): ("bin", False), ("GDI", "gdi"): ("gdi", False)}
CLASSES = (*_PACKED, *_DECODED, "cue", "iso", "nsp", "rdsk", "riff", "gdi")


def file_class(extension: Column) -> Column:
    e = F.lower(extension)
    return F.when(e.isin(*CLASSES), e).otherwise("other")


def extension_class(extension: Column) -> Column:
    """The class of a file where all kinds of archives count as one."""
    return F.when(F.lower(extension).isin(*ARCHIVE_EXTENSIONS), "archive").otherwise(file_class(extension))


def game_classes(games: DataFrame, roms: DataFrame, romfiles: DataFrame) -> DataFrame:
    """(id, classes, files, items, has_children, single): what each entry with files is made of.

    ``classes`` are the classes of its files, ``single`` the extensions that
    exactly one of its items has.
    """
    from stocktake.functions.paths import extension

    files = romfiles.select(F.col("id").alias("romfile_id"), "path", file_class(extension(F.col("path"))).alias("c"))
    parents = romfiles.where("parent_id is not null").select(F.col("parent_id").alias("romfile_id"), F.lit(True).alias("has_children")).distinct()
    rows = roms.where("romfile_id is not null").join(games.select(F.col("id").alias("game_id")), "game_id", "left_semi").join(files, "romfile_id").join(parents, "romfile_id", "left")
    own = F.lower(extension(F.col("name")))
    counts = [F.when(F.count(F.when(own == e, 1)) == 1, F.lit(e)) for e in ("bin", "gdi", "iso", "nsp")]
    return rows.groupBy(F.col("game_id").alias("id")).agg(
        F.sort_array(F.collect_set("c")).alias("classes"), F.count_distinct("path").alias("files"), F.count("*").alias("items"), F.coalesce(F.bool_or("has_children"), F.lit(False)).alias("has_children"), F.array_compact(F.array(*counts)).alias("single")
    )


def class_for(target: str, matrix: dict[str, dict[str, str]]) -> Column:
    """The class by which a target takes an entry: the first of its own order that a file has, else other."""
    return F.coalesce(*[F.when(F.array_contains("classes", c), F.lit(c)) for c in matrix[target] if c != "other"], F.lit("other"))


def planned(classes: DataFrame, target: str, matrix: dict[str, dict[str, str]], recompress: bool = False, arcade: Column | None = None) -> DataFrame:
    """(id, class, action) of the entries that the target takes.

    The matrix is a constant table, so joining it needs no shuffle. A disc image
    that others build on is left alone; recompression is done on demand only;
    arcade entries go to ARCADE_TARGETS alone.
    """
    allowed = matrix[target]
    cells = F.create_map(*[F.lit(x) for pair in allowed.items() for x in pair])
    row = classes.withColumn("class", class_for(target, matrix)).withColumn("action", F.try_element_at(cells, F.col("class")))
    row = row.where(F.col("action").isNotNull() & ~((F.col("class") == "chd") & F.col("has_children")))
    for (of, c), (wanted, alone) in (CONVERT_SINGLE if matrix is CONVERT else EXPORT_SINGLE).items():
        if of == target:
            fits = F.array_contains("single", wanted) & ((F.col("items") == 1) | F.lit(not alone))
            row = row.where((F.col("class") != c) | fits)
    if not recompress:
        row = row.where("action <> 'recompress'")
    if arcade is not None and target not in ARCADE_TARGETS:
        row = row.where(~arcade)
    return row.select("id", "class", "action")


def playlists(games: DataFrame, roms: DataFrame, romfiles: DataFrame) -> DataFrame:
    """(system_id, playlist, lines) for sets of discs that are full throughout.

    The files listed are those of the first extension, of chd, cso, cue, iso and
    rvz, that the set has.
    """
    from stocktake.functions.paths import basename, extension

    discs = games.where(F.col("name").rlike(r" \(Disc \d+\)")).withColumn("playlist", F.regexp_replace("name", r" \(Disc \d+\).*", ""))
    whole = discs.groupBy("system_id", "playlist").agg(F.bool_and(F.col("completion") == 2).alias("whole")).where("whole").drop("whole")
    files = discs.join(whole, ["system_id", "playlist"]).select("system_id", "playlist", F.col("id").alias("game_id")).join(roms.where("romfile_id is not null").select("game_id", "romfile_id"), "game_id")
    files = files.join(romfiles.select(F.col("id").alias("romfile_id"), "path"), "romfile_id").select("system_id", "playlist", "path").distinct()
    rank = F.array_position(F.array(*map(F.lit, ("chd", "cso", "cue", "iso", "rvz"))), F.lower(extension(F.col("path"))))
    files = files.withColumn("rank", rank).where("rank > 0")
    best = files.withColumn("best", F.min("rank").over(W.partitionBy("system_id", "playlist"))).where("rank = best")
    return best.groupBy("system_id", "playlist").agg(F.concat(F.array_join(F.sort_array(F.collect_list(basename(F.col("path")))), "\n"), F.lit("\n")).alias("lines"))


def rebuild_sources(roms: DataFrame, games: DataFrame) -> DataFrame:
    """(id, source): missing items that a present item of their collection can fill.

    Sources are looked up by CRC, then MD5, then SHA-1; the least id is taken.
    """
    rows = roms.join(games.select(F.col("id").alias("game_id"), "system_id"), "game_id")
    need = rows.where("romfile_id is null and not disk").select("id", "system_id", "size", "crc", "md5", "sha1")
    have = rows.where("romfile_id is not null and not disk")
    out = need
    for algorithm in ("crc", "md5", "sha1"):
        known = have.where(F.col(algorithm).isNotNull()).groupBy("system_id", "size", algorithm).agg(F.min("id").alias(f"by_{algorithm}"))
        out = out.join(known, ["system_id", "size", algorithm], "left")
    return out.select("id", F.coalesce("by_crc", "by_md5", "by_sha1").alias("source")).where("source is not null")


def rebuild_plan(roms: DataFrame, games: DataFrame, mode: int) -> DataFrame:
    """(id, action) on inherited items: expand adds what the mode wants, trim deletes what it does not.

    An entry is expanded as a whole or not at all.
    """
    from stocktake.schema import FULL_NON_MERGED, NON_MERGED, SPLIT

    source = roms.select(F.col("id").alias("parent_id"), F.col("game_id").alias("_g")).join(games.select(F.col("id").alias("_g"), F.col("bios").alias("_bios")), "_g").select("parent_id", "_bios")
    rows = roms.where("parent_id is not null").join(source, "parent_id", "left").withColumn("_bios", F.coalesce("_bios", F.lit(False)))
    kept = {SPLIT: F.lit(False), NON_MERGED: ~F.col("_bios"), FULL_NON_MERGED: F.lit(True)}[mode]
    trim = rows.where(~kept & F.col("romfile_id").isNotNull()).select("id", F.lit("delete").alias("action"))
    fill = rows.where(kept & F.col("romfile_id").isNull() & ~F.col("disk")).select("id", "game_id").join(rebuild_sources(roms, games), "id", "left")
    whole = fill.groupBy("game_id").agg(F.bool_and(F.col("source").isNotNull()).alias("whole")).where("whole").select("game_id")
    return trim.unionByName(fill.join(whole, "game_id", "left_semi").select("id", F.lit("add").alias("action")))


def gdi_lines(tracks: Column) -> Column:
    """The lines of a GDI sheet from tracks (number, audio, stem, sectors, gap, indices, dense).

    A fold, since the floor after the low-density area is no plain running sum.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("lines"))

    def step(acc: Column, t: Column) -> Column:
        at = acc["at"] + F.when(t["indices"] > 1, t["gap"]).otherwise(0)
        name = F.concat(t["stem"], F.when(t["audio"], ".raw").otherwise(".bin"))
        line = F.concat_ws(" ", t["number"].cast("string"), at.cast("string"), F.when(t["audio"], "0").otherwise("4"), F.lit("2352"), F.concat(F.lit('"'), name, F.lit('"')), F.lit("0"))
        after = at + t["sectors"]
        return F.struct(F.when(t["dense"], F.greatest(after, F.lit(45000))).otherwise(after).cast("bigint").alias("at"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    return F.aggregate(tracks, start, step, lambda a: F.concat(F.array(F.size(tracks).cast("string")), a["lines"]))
