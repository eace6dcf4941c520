"""Composed imports: catalogues into the state, and files to its items.

All collections of a delivery are imported in one plan; every step is a join on
(collection, entry, item) names, so that no collection needs a loop of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stocktake.functions.paths import basename, extension
from stocktake.operators.delta import delete_games, delete_romfiles, deleted, inserted, updated
from stocktake.operators.discs import extents
from stocktake.operators.layout import system_directory
from stocktake.operators.match import DUPLICATE, INVALID, VALID, hash_rows, numbered
from stocktake.schema import ARCHIVE_EXTENSIONS, PS3_EXTENSIONS
from stocktake.state import release, settle

ALGORITHMS = ("crc", "md5", "sha1")
#: Kinds of files that are looked into when they are imported.
OPENED = (*ARCHIVE_EXTENSIONS, "chd", "cia", "cso", "nsz", "rvz", "zso")
#: The file by which a folder of a disc is known.
ANCHOR = "PS3_DISC.SFB"


def import_catalogues(state: dict[str, DataFrame], offered: DataFrame, entries: DataFrame, items: DataFrame, force: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The state with the offered catalogues, and the files (romfile_id) that lost their item.

    ``offered``: name, version; ``entries``: system, name, description, bios,
    cloneof, romof; ``items``: system, game, name, size, crc, md5, sha1,
    rom_status. A catalogue is taken if it is new or newer, or with ``force``.
    Entries that vanished go with their clones, and clones that are still listed
    are made again; items that vanished go unless they are inherited; items of
    another size or checksum lose their file.
    """
    had = state["systems"].select("name", "id", F.col("version").alias("_had"))
    taken = offered.join(had, "name", "left")
    taken = settle(taken if force else taken.where("_had is null or version > _had"), "taken")
    fresh = inserted(state["systems"], taken.where("id is null").select("id", "name", "version"), ["name"])
    systems = updated(state["systems"], taken.where("id is not null"), ["version"]).unionByName(fresh, allowMissingColumns=True)
    systems = settle(systems, "systems")
    ids = systems.join(taken.select("name"), "name", "left_semi").select(F.col("id").alias("system_id"), F.col("name").alias("system"))

    listed = settle(entries.join(ids, "system").drop("system"), "listed")
    own = state["games"].join(ids, "system_id", "left_semi")
    vanished = settle(own.join(listed, ["system_id", "name"], "left_anti").select("id"), "vanished")
    backed = state["roms"].where("parent_id is null and romfile_id is not null")
    orphans = backed.join(vanished.select(F.col("id").alias("game_id")), "game_id", "left_semi").select("romfile_id")
    left = delete_games(state, vanished)

    met = listed.join(left["games"].select("id", "system_id", "name"), ["system_id", "name"], "left")
    new = inserted(state["games"], met.where("id is null").select("id", "system_id", "name", "description", "bios"), ["system_id", "name"])
    games = settle(updated(left["games"], met.where("id is not null"), ["description", "bios"]).unionByName(new, allowMissingColumns=True), "games")
    keyed = games.join(ids, "system_id", "left_semi").select("system_id", "name", "id")
    parent = keyed.select("system_id", F.col("name").alias("parent"), F.col("id").alias("parent_id"))
    parents = listed.withColumn("parent", F.coalesce("cloneof", "romof")).join(keyed, ["system_id", "name"]).join(parent, ["system_id", "parent"], "left")
    games = settle(updated(games, parents.select("id", "parent_id"), ["parent_id"]), "games")

    named = ids.join(keyed.withColumnRenamed("name", "game").withColumnRenamed("id", "game_id"), "system_id").select("system", "game", "game_id")
    wanted = settle(items.join(named, ["system", "game"]).drop("system", "game"), "items")
    roms = left["roms"]
    inside = roms.join(named, "game_id", "left_semi")
    gone = settle(inside.where("parent_id is null").join(wanted, ["game_id", "name"], "left_anti").select("id", "romfile_id"), "gone")
    was = inside.select("id", "game_id", "name", F.col("size").alias("_size"), F.col("crc").alias("_crc"), "romfile_id")
    both = wanted.join(was, ["game_id", "name"], "left")
    differs = (F.col("size") != F.col("_size")) | F.coalesce(F.lower("crc") != F.lower("_crc"), F.lit(False))
    both = settle(both.withColumn("_changed", F.col("id").isNotNull() & F.coalesce(differs, F.lit(False))), "met-items")
    orphans = orphans.unionByName(gone.select("romfile_id")).unionByName(both.where("_changed").select("romfile_id")).where("romfile_id is not null").distinct()
    kept = both.where("id is not null").withColumn("romfile_id", F.when(~F.col("_changed"), F.col("romfile_id")))
    more = inserted(state["roms"], both.where("id is null").select("id", "game_id", "name", "size", "crc", "md5", "sha1", "rom_status"), ["game_id", "name"])
    roms = updated(deleted(roms, gone), kept, ["size", "crc", "md5", "sha1", "rom_status", "romfile_id"]).unionByName(more, allowMissingColumns=True)
    return left | {"systems": systems, "games": games, "roms": settle(roms, "roms")}, settle(orphans, "orphans")


def import_files(files: DataFrame, roms: DataFrame, tried: Sequence[str] = ALGORITHMS) -> DataFrame:
    """(file, rom, algorithm, state): each file by its first checksum that any item knows.

    ``files``: file, size and a column per algorithm. Items are counted by key
    before they meet the files; the k-th file of a key takes its k-th open item,
    and files beyond are duplicates.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(a).alias("algorithm"), F.lower(F.col(a)).alias("digest")) for k, a in enumerate(tried)])
    rows = files.select("file", "size", F.explode(pairs).alias("h")).select("file", "size", "h.*").where("digest is not null")
    items = hash_rows(roms, *tried).where("open or present")
    known = items.groupBy("size", "algorithm", "digest").agg(F.lit(True).alias("known"))
    best = rows.join(known, ["size", "algorithm", "digest"]).groupBy("file").agg(F.min(F.struct("rank", "algorithm", "size", "digest")).alias("b")).select("file", "b.algorithm", "b.size", "b.digest")
    key = ["size", "algorithm", "digest"]
    free = numbered(items.where("open").select(*key, F.col("id").alias("rom")), key, ["rom"])
    met = numbered(best, key, ["file"]).join(free, [*key, "_k"], "left")
    # An item has several checksums: of the files that reach it by different ones, the first takes it.
    first = F.row_number().over(W.partitionBy("rom").orderBy("file"))
    met = met.withColumn("rom", F.when(first == 1, F.col("rom"))) if len(tried) > 1 else met
    found = files.select("file").join(met.select("file", "rom", "algorithm"), "file", "left")
    return found.select("file", "rom", "algorithm", F.when(F.col("algorithm").isNull(), INVALID).when(F.col("rom").isNull(), DUPLICATE).otherwise(VALID).alias("state"))


def reimport_orphans(state: dict[str, DataFrame], orphans: DataFrame, digests: DataFrame, tried: Sequence[str] = ALGORITHMS) -> dict[str, DataFrame]:
    """The state after orphaned files are matched again: they back an open item, or move to the Trash.

    ``orphans``: romfile_id; ``digests``: id, size and a column per algorithm, of
    files that exist. Files without digests are forgotten.
    """
    gone = orphans.select(F.col("romfile_id").alias("id")).distinct()
    back = settle(state["romfiles"].join(gone, "id", "left_semi").join(digests.select("id"), "id", "left_semi"), "orphans")
    left = delete_romfiles(state, gone)
    roms = settle(left["roms"], "roms")
    known = digests.join(back.select("id"), "id", "left_semi").withColumnRenamed("id", "file")
    found = settle(import_files(known, roms, tried), "reimported")
    linked = found.where(F.col("state") == VALID).select(F.col("rom").alias("id"), F.col("file").alias("romfile_id"))
    states = back.join(found.select(F.col("file").alias("id"), "state"), "id")
    path = F.when(F.col("state") == VALID, F.col("path")).otherwise(F.concat(F.lit("Trash/"), basename(F.col("path"))))
    again = states.withColumn("path", path).select(*state["romfiles"].columns)
    return left | {"roms": updated(roms, linked, ["romfile_id"]), "romfiles": left["romfiles"].unionByName(again)}


def route(files: DataFrame, romfiles: DataFrame, force: bool = False, as_is: bool = False) -> DataFrame:
    """(path, action, kind): what an import does with each file, and by which way.

    ``files``: path, size, extension (by content, else by name). Empty files are
    deleted, known ones skipped unless ``force``; with ``as_is`` nothing is opened.
    """
    known = romfiles.select("path", F.lit(True).alias("_known")).distinct()
    kind = F.lower("extension")
    kind = F.lit("plain") if as_is else F.when(kind.isin(*ARCHIVE_EXTENSIONS), "archive").when(kind.isin(*OPENED), kind).otherwise("plain")
    skipped = F.lit(False) if force else F.col("_known").isNotNull()
    action = F.when(F.col("size") == 0, "delete").when(skipped, "skip").otherwise("import")
    return files.join(known, "path", "left").select("path", action.alias("action"), kind.alias("kind"))


#: Contents meet in so many turns, so that the shuffle of one turn only is on disk at a time.
TURNS = 4
#: A content in a bucket of more rows than this, and than four mean ones, is numbered over many tasks.
LOTS, BUCKETS = 20_000, 1 << 16


def _keyed(rows: DataFrame, tried: Sequence[str], *keep: str) -> DataFrame:
    """``keep``, and for each checksum two hashes (``_a0``, ``_b0``, ...) of it and the size; null without either."""
    columns = []
    for k, name in enumerate(tried):
        digest = F.lower(F.col(name))
        there = digest.isNotNull() & F.col("size").isNotNull()
        columns += [F.when(there, F.xxhash64("size", digest)).alias(f"_a{k}"), F.when(there, F.xxhash64(digest, "size")).alias(f"_b{k}")]
    return rows.select(*keep, *columns)


def _fingerprints(keyed: DataFrame, owner: str, tried: Sequence[str], *more: Column) -> DataFrame:
    """(owner, rank, n, f1, f2, f3, f4): a set of contents as their number and sums of hashes, for each checksum that all of them have."""
    half = lambda c: (F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(c, 32)))
    sums = keyed.groupBy(owner).agg(F.count("*").alias("n"), *more, *[x.alias(f"_{c}{k}{i}") for k in range(len(tried)) for c in ("a", "b") for i, x in enumerate(half(f"_{c}{k}"))], *[F.count(f"_a{k}").alias(f"_n{k}") for k in range(len(tried))])
    each = F.array(*[F.when(F.col(f"_n{k}") == F.col("n"), F.struct(F.lit(k).alias("rank"), *[F.col(f"_{c}{k}{i}").alias(f"f{j}") for j, (c, i) in enumerate((("a", 0), ("a", 1), ("b", 0), ("b", 1)), 1)])) for k in range(len(tried))])
    kept = [c for c in sums.columns if not c.startswith("_")]
    return sums.select(*kept, F.explode(F.array_compact(each)).alias("h")).select(*kept, "h.*")


def whole_sets(members: DataFrame, items: DataFrame, tried: Sequence[str] = ALGORITHMS) -> DataFrame:
    """(archive, game_id, rank): archives that hold exactly the items of an entry, by the first checksum that says so.

    ``members``: archive and hashes by ``_keyed``; ``items``: game_id, open and the
    same. Only entries with all items open count. Sets meet as fingerprints, so
    contents that many archives or entries share make no pairs. The k-th archive
    of a fingerprint takes its k-th entry.
    """
    key = ["rank", "n", "f1", "f2", "f3", "f4"]
    want = settle(_fingerprints(items, "game_id", tried, F.bool_and("open").alias("free")).where("free").drop("free"), "wanted")
    known = _fingerprints(members, "archive", tried).join(want.select(*key), key, "left_semi")
    known = known.groupBy("archive").agg(F.min(F.struct(*key)).alias("b")).select("archive", "b.*") if len(tried) > 1 else known
    first = settle(known, "first")
    open_sets = settle(want.join(first.select(*key), key, "left_semi"), "open-sets")
    release(want)
    met = numbered(first, key, ["archive"]).join(numbered(open_sets, key, ["game_id"]), [*key, "_k"])
    # An entry may be reached through several checksums; the first archive takes it.
    place = F.row_number().over(W.partitionBy("game_id").orderBy("archive"))
    sets = settle(met.withColumn("_k", place).where("_k = 1").select("archive", "game_id", "rank"), "whole")
    release(first, open_sets)
    return sets


def _exploded(rows: DataFrame, tried: Sequence[str], *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("rank"), F.col(f"_a{k}").alias("_ha"), F.col(f"_b{k}").alias("_hb")) for k in range(len(tried))])
    return rows.select(*keep, F.explode(pairs).alias("h")).select(*keep, "h.*").where("_ha is not null")


def _full(key: Sequence[str], *tables: DataFrame) -> tuple[Column, list[int]]:
    """The bucket of a key, and the buckets with far more rows than others."""
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")
    rows = tables[0].select(bucket.alias("_c"))
    for t in tables[1:]:
        rows = rows.unionByName(t.select(bucket.alias("_c")))
    sizes = rows.groupBy("_c").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.collect_list(F.when(F.col("n") > LOTS, F.struct("n", "_c"))).alias("full")).first()
    return bucket, [r["_c"] for r in sizes["full"] if r["n"] > 4 * sizes["rows"] // BUCKETS]


def _met(files: DataFrame, items: DataFrame) -> list[DataFrame]:
    """Parts of (archive, member, rom, name, game_id, known): the k-th file of a content takes its k-th open item.

    ``files``: archive, member, ``_g``, rank, ``_ha``, ``_hb``; ``items``: rom, name, game_id, open
    and the same, and archive if they are ordered by it before rom. ``known``: whether any item has the content.
    """
    # Keys without nulls, as those meet nothing in a join.
    files, items = (df.withColumn("_w", F.col("_g").isNotNull()).withColumn("_g", F.coalesce("_g", F.lit(0))) for df in (files, items))
    key = ["_w", "_g", "rank", "_ha", "_hb"]
    bucket, hot = _full(key, files, items)
    none = lambda kind: F.lit(None).cast(kind)
    parts = []
    for turn in range(TURNS):
        mine = (F.pmod(F.col("_hb"), F.lit(TURNS)) == turn) & ~(bucket.isin(hot) if hot else F.lit(False))
        left = files.where(mine).select(*key, F.lit(0).alias("_s"), F.lit(True).alias("open"), "archive", "member", none("bigint").alias("rom"), none("string").alias("name"), none("bigint").alias("game_id"))
        right = items.where(mine).select(*key, F.lit(1).alias("_s"), "open", (F.col("archive") if "archive" in items.columns else none("string")).alias("archive"), none("string").alias("member"), "rom", "name", "game_id")
        both = left.unionByName(right).repartition("_ha")
        both = both.withColumn("_k", F.row_number().over(W.partitionBy(*key, "_s", "open").orderBy("archive", "member", "rom"))).withColumn("known", F.max("_s").over(W.partitionBy(*key)) == 1)
        place = W.partitionBy(*key, "open", "_k")
        both = both.select("_s", "archive", "member", *[F.max(c).over(place).alias(c) for c in ("rom", "name", "game_id")], "known")
        parts.append(settle(both.where("_s = 0").drop("_s"), "met"))
    if hot:
        some = files.where(bucket.isin(hot)).select(*key, "archive", "member")
        free = numbered(items.where(bucket.isin(hot) & F.col("open")).select(*key, *(["archive"] if "archive" in items.columns else []), "rom", "name", "game_id"), key, [*(["archive"] if "archive" in items.columns else []), "rom"])
        known = items.where(bucket.isin(hot)).select(*key).distinct()
        some = numbered(some, key, ["archive", "member"], settle(known, "known"))
        free = free.select(*[F.col(c).alias(f"_{c}") for c in (*key, "_k")], "rom", "name", "game_id")
        on = [some[c].eqNullSafe(free[f"_{c}"]) for c in (*key, "_k")]
        parts.append(settle(some.join(free, on, "left").select("archive", "member", "rom", "name", "game_id", F.col("_known").alias("known")), "met"))
    return parts


def _imported(members: DataFrame, roms: DataFrame, tried: Sequence[str], covers: str) -> DataFrame:
    """(archive, member, rom, name, game_id, state, n, one, trashed, first): each member with its item, and what its archive amounts to.

    ``members``: archive, member and hashes by ``_keyed``. ``one``: all members are own
    items of one entry; ``first`` marks one row of each archive.
    """
    columns = [f"_{c}{k}" for k in range(len(tried)) for c in "ab"]
    items = _keyed(roms.withColumn("own", F.col("parent_id").isNull()).withColumn("open", F.expr("romfile_id is null and parent_id is null")).withColumn("present", F.col("romfile_id").isNotNull()), tried, F.col("id").alias("rom"), "name", "game_id", "own", "open", "present")
    sets = whole_sets(members.select("archive", *columns), items.where("own").select("game_id", "open", *columns), tried)
    rows = settle(members.join(sets.withColumnRenamed("game_id", "_g").withColumnRenamed("rank", "_r"), "archive", "left"), "members")

    # Items of an entry that goes to an archive as a whole are kept for it, and there already for any other.
    inside = _exploded(rows.where("_g is not null"), tried, "archive", "member", "_g", "_r").where("rank = _r").drop("_r")
    counts = sum(F.col(f"_a{k}").isNotNull().cast("int") for k in range(len(tried)))
    rest = rows.where("_g is null").withColumn("_several", counts)
    every = _exploded(items, tried, "rom", "name", "game_id", "own", "open", "present").join(sets.select("game_id", F.lit(True).alias("_set"), F.col("rank").alias("_r")), "game_id", "left")
    taken = F.col("_set").isNotNull() & F.col("own")
    both = F.array_compact(F.array(F.when(taken & (F.col("rank") == F.col("_r")), F.struct(F.col("game_id").alias("_g"), F.lit(True).alias("open"))), F.when(F.col("open") | F.col("present"), F.struct(F.lit(None).cast("bigint").alias("_g"), (F.col("open") & ~taken).alias("open")))))
    wanted = every.select(F.explode(both).alias("e"), "rom", "name", "game_id", "rank", "_ha", "_hb").select("e.*", "rom", "name", "game_id", "rank", "_ha", "_hb")

    files = _exploded(rest, tried, "archive", "member", "_g", "_several")
    many = len(tried) > 1 and not rest.where("_several > 1").isEmpty()
    if many:
        # The first checksum that any item has stands for a member that has several.
        have = _exploded(items.where("open or present"), tried).select("rank", "_ha", "_hb")
        best = files.where("_several > 1").join(have, ["rank", "_ha", "_hb"], "left_semi").groupBy("archive", "member").agg(F.min("rank").alias("_best"))
        files = files.join(best, ["archive", "member"], "left").where("_several = 1 or rank = coalesce(_best, -1)").drop("_best")
        lost = rest.where("_several > 1").join(best, ["archive", "member"], "left_anti").unionByName(rest.where("_several = 0"))
    else:
        lost = rest.where("_several = 0")
    files = files.drop("_several")
    several = len(tried) > 1 and not items.where(counts > 1).isEmpty()
    met = _met(inside.unionByName(files), wanted)
    nothing = lost.select("archive", "member", F.lit(None).cast("bigint").alias("rom"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("game_id"), F.lit(False).alias("known"))
    met.append(settle(nothing, "met"))
    release(rows, sets)
    found = met[0]
    for part in met[1:]:
        found = found.unionByName(part)
    if several:
        # An item has several checksums: of the members that reach it by different ones, the first takes it.
        place = F.row_number().over(W.partitionBy("rom").orderBy("archive", "member"))
        one = found.where("rom is not null").withColumn("_k", place).select("archive", "member", "known", *[F.when(F.col("_k") == 1, F.col(c)).alias(c) for c in ("rom", "name", "game_id")])
        found = settle(one.unionByName(found.where("rom is null")), "once")

    w = W.partitionBy("archive")
    state = F.when(F.col("rom").isNotNull(), VALID).when(F.col("known"), DUPLICATE).otherwise(INVALID)
    n, again, unknown = F.count("*").over(w), F.max((F.col("state") == DUPLICATE).cast("int")).over(w) == 1, F.max((F.col("state") == INVALID).cast("int")).over(w) == 1
    one = (F.count("rom").over(w) == n) & (F.min("game_id").over(w) == F.max("game_id").over(w))
    first = F.row_number().over(w.orderBy("member")) == 1
    told = found.withColumn("state", state).drop("known").select("*", n.alias("n"), F.coalesce(one, F.lit(False)).alias("one"), (again | (unknown & ((n == 1) if covers == "entry" else F.lit(True)))).alias("trashed"), first.alias("first"))
    parts = [settle(told.where(F.pmod(F.xxhash64("archive"), F.lit(TURNS)) == turn), "told") for turn in range(TURNS)]
    release(*met)
    told = parts[0]
    for part in parts[1:]:
        told = told.unionByName(part)
    return told


def import_archives(members: DataFrame, roms: DataFrame, games: DataFrame, systems: DataFrame, tried: Sequence[str] = ALGORITHMS, covers: str = "entry", suffix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What becomes of archives: (archive, action) and (archive, member, rom, state, path).

    ``members``: archive (its path), member, size and a column per algorithm.
    An archive whose members are all own items of one entry is kept as it is
    (``keep``) if they are all of them; with ``covers="part"``, as for packages and
    tracks, also if they are some. Of others, members that back an open item are
    taken out (``split``); an archive with a member that is there already, or of
    one member that nothing knows, is trashed besides (``trash``). Entries with
    all items open go first, to archives that hold just these. Null columns match
    nothing; a repeated member of an archive counts as often as it occurs.
    Contents are compared by 128 bits. ``members`` and ``roms`` are read several
    times: they should be stored tables, or cheap to make.
    """
    told = _imported(_keyed(members, tried, "archive", F.col("member").cast("string").alias("member")), roms, tried, covers)
    return _placed(told, roms, games, systems, covers, suffix)


def _placed(told: DataFrame, roms: DataFrame, games: DataFrame, systems: DataFrame, covers: str, suffix: str | None) -> tuple[DataFrame, DataFrame]:
    named = games.select(F.col("id").alias("game_id"), F.col("name").alias("game"), "jbfolder", "system_id").join(systems.select(F.col("id").alias("system_id"), system_directory(F.col("name"), F.col("custom_name")).alias("dir"), "arcade"), "system_id").drop("system_id")
    needed = roms.where("parent_id is null").groupBy("game_id").agg(F.count("*").alias("needed"))
    keep = F.col("one") & ((F.col("n") == F.coalesce("needed", F.lit(0))) if covers == "entry" else F.lit(True))
    action = F.when(keep, "keep").when(F.col("trashed"), "trash").otherwise("split")
    firsts = told.where("first")
    outcome = (firsts.join(needed, "game_id", "left") if covers == "entry" else firsts).select("archive", action.alias("action"))

    named = named.join(needed, "game_id", "left") if covers == "entry" else named
    rows = told.where("rom is not null").join(named, "game_id", "left")
    ext = F.lit(suffix) if suffix else extension(F.col("archive"))
    by_game = (F.col("n") > 1) | F.col("arcade") | F.lower(extension(F.col("name"))).isin(*PS3_EXTENSIONS) | F.lit(covers != "entry")
    bare = F.regexp_replace("name", r"(?<=[^/])\.[^./]*$", "")
    kept = F.concat(F.when(by_game, F.col("game")).otherwise(bare), F.lit("."), ext)
    out = F.when(F.col("arcade") | F.col("jbfolder"), F.concat("game", F.lit("/"), "name")).otherwise(F.col("name"))
    path = F.concat("dir", F.lit("/"), F.when(keep, kept).otherwise(out))
    placed = rows.select("archive", "member", "rom", "state", path.alias("path"))
    return outcome, placed.unionByName(told.where("rom is null").select("archive", "member", "rom", "state", F.lit(None).cast("string").alias("path")))


def import_discs(images: DataFrame, tracks: DataFrame, roms: DataFrame, games: DataFrame, systems: DataFrame) -> DataFrame:
    """(image, rom, state, path) of disc images: one row per track of a CD, else one per image.

    ``images``: image (its path), kind (cd, dvd, hd, ld), size, crc, md5, sha1 of the
    decoded data, and disc_sha1 of the image itself; ``tracks``: image, track, size,
    crc, md5, sha1. The tracks of a CD must all be items of one entry, or none is
    taken. Other images go by the data's SHA-1, then by their own SHA-1 with an
    item of size 0, then by the other checksums.
    """
    reverse = tuple(reversed(ALGORITHMS))
    discs = images.where("kind = 'cd'").select("image")
    keyed = _keyed(tracks, reverse, F.col("image").alias("archive"), F.col("track").cast("string").alias("member"))
    members = keyed.join(discs.withColumnRenamed("image", "archive"), "archive", "left_semi")
    bins = roms.where(F.lower(extension(F.col("name"))) != "cue")
    told = _imported(members, bins, reverse, "part")
    # The tracks of an image that is not kept take nothing.
    told = told.withColumn("state", F.when(F.col("one") | (F.col("state") != VALID), F.col("state")).otherwise(INVALID)).withColumn("rom", F.when(F.col("one"), F.col("rom")))
    kept = _placed(told, bins, games, systems, "part", "chd")[1].select(F.col("archive").alias("image"), "rom", "state", "path")

    rest = settle(images.where("kind <> 'cd'"), "images")
    if rest.isEmpty():
        return kept
    taken = roms.join(told.where("rom is not null").select(F.col("rom").alias("id")), "id", "left_anti")
    by_sha1 = settle(import_files(rest.select(F.col("image").alias("file"), "size", "sha1"), taken, ["sha1"]), "by-sha1")
    unknown = lambda df: df.where(F.col("state") == INVALID).select(F.col("file").alias("image"))
    own = rest.join(unknown(by_sha1), "image", "left_semi").select(F.col("image").alias("file"), F.lit(0).cast("bigint").alias("size"), F.col("disc_sha1").alias("sha1"))
    free = taken.join(by_sha1.where("rom is not null").select(F.col("rom").alias("id")), "id", "left_anti")
    by_disc = settle(import_files(own, free, ["sha1"]), "by-disc")
    free = free.join(by_disc.where("rom is not null").select(F.col("rom").alias("id")), "id", "left_anti")
    by_rest = import_files(rest.join(unknown(by_disc), "image", "left_semi").withColumnRenamed("image", "file"), free, ["md5", "crc"])
    decided = by_sha1.where(F.col("state") != INVALID).unionByName(by_disc.where(F.col("state") != INVALID)).unionByName(by_rest)
    where = games.select(F.col("id").alias("game_id"), "system_id").join(systems.select(F.col("id").alias("system_id"), system_directory(F.col("name"), F.col("custom_name")).alias("dir")), "system_id")
    named = roms.select(F.col("id").alias("rom"), "name", "game_id").join(where, "game_id")
    path = F.concat("dir", F.lit("/"), F.regexp_replace("name", r"(?<=[^/])\.[^./]*$", ""), F.lit(".chd"))
    others = decided.join(named, "rom", "left").select(F.col("file").alias("image"), "rom", "state", path.alias("path"))
    return kept.unionByName(others)


def import_folders(files: DataFrame, roms: DataFrame, games: DataFrame, systems: DataFrame) -> DataFrame:
    """(folder, path, rom, state, target) of the files of disc folders.

    ``files``: folder, path (within the folder), size, md5. A folder is known by its
    anchor file, an inherited item of that name, size and MD5; the k-th folder of
    an anchor takes its k-th open entry by name. Its other files take the missing
    items of the anchor's parent by size and MD5: those of the same path first,
    the rest in order of path and name. Files of folders without an entry are invalid.
    """
    both = _keyed(files, ["md5"], "folder", "path").withColumnsRenamed({"_a0": "_ha", "_b0": "_hb"})
    below = roms.where("parent_id is not null")
    items = _keyed(below.withColumn("open", F.col("romfile_id").isNull()), ["md5"], F.col("id").alias("rom"), "name", "game_id", "parent_id", "open").withColumnsRenamed({"_a0": "_ha", "_b0": "_hb"}).where("_ha is not null")

    alike = [F.lit(None).cast("bigint").alias("_g"), F.lit(0).alias("rank"), "_ha", "_hb"]
    have = both.where((F.col("path") == ANCHOR) & F.col("_ha").isNotNull()).select(F.col("folder").alias("archive"), F.lit(None).cast("string").alias("member"), *alike)
    named = games.select(F.col("id").alias("game_id"), F.col("name").alias("game"))
    wanted = items.where((F.col("name") == ANCHOR) & F.col("open")).join(named, "game_id").select(*alike, F.col("game").alias("archive"), F.col("game_id").alias("rom"), F.lit(None).cast("string").alias("name"), F.col("parent_id").alias("game_id"), "open")
    anchors = _met(have, wanted)
    anchored = anchors[0]
    for part in anchors[1:]:
        anchored = anchored.unionByName(part)
    anchored = anchored.where("rom is not null").select(F.col("archive").alias("folder"), F.col("rom").alias("game_id"), F.col("game_id").alias("parent_id"))
    rows = []
    for turn in range(TURNS):
        mine = F.pmod(F.xxhash64("folder"), F.lit(TURNS)) == turn
        rows.append(settle(both.where(mine).join(anchored.where(mine), "folder", "left").select("folder", "path", "game_id", F.when(F.col("_ha").isNotNull(), F.col("parent_id")).alias("_g"), "_ha", "_hb"), "files"))
    release(*anchors)

    inside = rows[0]
    for part in rows[1:]:
        inside = inside.unionByName(part)
    found = _met_by_path(inside.where("_g is not null"), items.select(F.col("parent_id").alias("_g"), "_ha", "_hb", "rom", "name", "open"))
    found.append(settle(inside.where("_g is null").select("folder", "path", "game_id", F.lit(None).cast("bigint").alias("rom"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("known")), "met"))
    release(*rows)
    told = found[0]
    for part in found[1:]:
        told = told.unionByName(part)
    told = told.withColumn("state", F.when(F.col("rom").isNotNull(), VALID).when(F.col("known"), DUPLICATE).otherwise(INVALID)).drop("known")
    dirs = systems.select(F.col("id").alias("system_id"), system_directory(F.col("name"), F.col("custom_name")).alias("dir"))
    where = games.select(F.col("id").alias("game_id"), F.col("name").alias("game"), "system_id").join(dirs, "system_id", "left").select("game_id", F.concat_ws("/", "dir", "game").alias("dir"))
    # Names that are those of the files are not carried along.
    placed = told.where("rom is not null").join(where, "game_id", "left").select("folder", "path", "rom", "state", F.concat_ws("/", "dir", F.coalesce("name", "path")).alias("target"))
    return placed.unionByName(told.where("rom is null").select("folder", "path", "rom", "state", F.lit(None).cast("string").alias("target")))


def _met_by_path(files: DataFrame, items: DataFrame) -> list[DataFrame]:
    """Parts of (folder, path, game_id, rom, name, known): files of a content take its open items of the same path, the rest in order.

    ``files``: folder, path, game_id, ``_g``, ``_ha``, ``_hb``; ``items``: rom, name, open and the
    same key. ``name`` is null where it is the path.
    """
    key = ["_g", "_ha", "_hb"]
    bucket, hot = _full(key, files, items)
    none = lambda kind: F.lit(None).cast(kind)
    parts = []
    for turn in range(TURNS):
        mine = (F.pmod(F.col("_hb"), F.lit(TURNS)) == turn) & ~(bucket.isin(hot) if hot else F.lit(False))
        left = files.where(mine).select(*key, F.lit(0).alias("_s"), F.lit(True).alias("open"), "folder", "path", "game_id", none("bigint").alias("rom"))
        right = items.where(mine).select(*key, F.lit(1).alias("_s"), "open", none("string").alias("folder"), F.col("name").alias("path"), none("bigint").alias("game_id"), "rom")
        both = left.unionByName(right).repartition("_ha")
        alike = W.partitionBy(*key, "open", "path")
        both = both.withColumn("_same", F.min("rom").over(alike)).withColumn("_met", F.min("_s").over(alike) == 0)
        done = F.when(F.col("_s") == 0, F.col("_same").isNotNull()).otherwise(F.col("_met") & (F.col("rom") == F.col("_same")))
        both = both.withColumn("_done", F.coalesce(done, F.lit(False)))
        both = both.withColumn("_k", F.row_number().over(W.partitionBy(*key, "open", "_done", "_s").orderBy("path", "folder", "rom"))).withColumn("known", F.max(F.when(~F.col("open"), 1).otherwise(0)).over(W.partitionBy(*key)) == 1)
        place = W.partitionBy(*key, "open", "_done", "_k")
        both = both.withColumn("_rom", F.max("rom").over(place)).withColumn("_name", F.max(F.when(F.col("_s") == 1, F.col("path"))).over(place)).where("_s = 0")
        parts.append(settle(both.select("folder", "path", "game_id", F.when(F.col("_done"), F.col("_same")).otherwise(F.col("_rom")).alias("rom"), F.when(~F.col("_done"), F.col("_name")).alias("name"), "known"), "met"))
    if hot:
        some, pool = files.where(bucket.isin(hot)), items.where(bucket.isin(hot))
        free = pool.where("open").select(*key, "rom", "name")
        same = settle(some.join(free.withColumnRenamed("name", "path"), [*key, "path"]).groupBy("folder", "path").agg(F.min("rom").alias("rom")), "same")
        others = numbered(some.join(same, ["folder", "path"], "left_anti").select(*key, "folder", "path", "game_id"), key, ["path", "folder"], settle(pool.where("not open").select(*key).distinct(), "known"))
        rest = numbered(free.join(same.select("rom"), "rom", "left_anti").select(*key, "rom", "name"), key, ["name", "rom"])
        parts.append(settle(some.join(same, ["folder", "path"]).select("folder", "path", "game_id", "rom", none("string").alias("name"), F.lit(False).alias("known")), "met"))
        parts.append(settle(others.join(rest, [*key, "_k"], "left").select("folder", "path", "game_id", "rom", "name", F.col("_known").alias("known")), "met"))
    return parts


def import_listings(state: dict[str, DataFrame], listings: DataFrame, entries: DataFrame, hashes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The state with the files of disc images as items of their entries, and the files (romfile_id) that lost their item.

    ``listings``: image, game_id, files (their number by the listing); ``entries``:
    image, path, ordinal, size, location; ``hashes``: image, location, md5. Items
    hang on the first own item of their entry. Images without one, or with
    another number of files than listed, are left out.
    """
    whole = extents(entries)
    counts = whole.groupBy("image").agg(F.count("*").alias("files"))
    parents = state["roms"].where("parent_id is null").groupBy("game_id").agg(F.min("id").alias("parent_id"))
    taken = settle(listings.join(counts, ["image", "files"]).join(parents, "game_id").select("image", "game_id", "parent_id"), "listings")
    rows = whole.join(taken, "image").join(hashes, ["image", "location"]).select("game_id", "parent_id", F.col("path").alias("name"), "size", "md5")
    was = state["roms"].select("id", "game_id", "name", F.col("size").alias("_size"), F.col("md5").alias("_md5"), "romfile_id")
    met = settle(rows.join(was, ["game_id", "name"], "left"), "listed")
    same = (F.col("size") == F.col("_size")) & F.coalesce(F.lower("md5") == F.lower("_md5"), F.lit(False))
    kept = met.where("id is not null").withColumn("_lost", ~same)
    orphans = kept.where("_lost and romfile_id is not null").select("romfile_id").distinct()
    kept = kept.withColumn("romfile_id", F.when(~F.col("_lost"), F.col("romfile_id")))
    new = inserted(state["roms"], met.where("id is null").select("id", "game_id", "parent_id", "name", "size", "md5"), ["game_id", "name"])
    roms = updated(state["roms"], kept, ["size", "md5", "parent_id", "romfile_id"]).unionByName(new, allowMissingColumns=True)
    marked = taken.select(F.col("game_id").alias("id"), F.lit(True).alias("jbfolder")).distinct()
    return state | {"roms": settle(roms, "roms"), "games": updated(state["games"], marked, ["jbfolder"])}, settle(orphans, "orphans")


def purge_listings(state: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The state without what ``import_listings`` added to entries (id): inherited items go, their files move to the Trash."""
    own = state["roms"].where("parent_id is null").join(gone.select(F.col("id").alias("game_id")), "game_id", "left_semi")
    below = settle(state["roms"].join(own.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", "romfile_id", "game_id"), "below")
    folder = below.where("romfile_id is not null").join(state["games"].select(F.col("id").alias("game_id"), "system_id"), "game_id").join(state["systems"].select(F.col("id").alias("system_id"), system_directory(F.col("name"), F.col("custom_name")).alias("dir")), "system_id")
    folder = folder.groupBy(F.col("romfile_id").alias("id")).agg(F.min("dir").alias("dir"))
    moved = state["romfiles"].join(folder, "id").select("id", F.concat("dir", F.lit("/Trash/"), basename(F.col("path"))).alias("path"))
    unmarked = gone.select("id", F.lit(False).alias("jbfolder")).distinct()
    return state | {"roms": deleted(state["roms"], below), "romfiles": updated(state["romfiles"], moved, ["path"]), "games": updated(state["games"], unmarked, ["jbfolder"])}


def import_patches(state: dict[str, DataFrame], added: DataFrame) -> dict[str, DataFrame]:
    """The state with patch files. ``added``: rom_id, name, path, size; the n-th patch of an item has index n - 1, and a name it has already adds nothing."""
    from stocktake.operators.discs import new_patches

    fresh = settle(new_patches(state["patches"], added.select("rom_id", "name")), "patches")
    about = added.groupBy("rom_id", "name").agg(F.min(F.struct("path", "size")).alias("f")).select("rom_id", "name", "f.*")
    files = fresh.join(about, ["rom_id", "name"])
    stored = settle(inserted(state["romfiles"], files.select(F.lit(None).cast("bigint").alias("id"), "path", "size", F.lit(1).alias("romfile_type")), ["path"]), "patch-files")
    ids = stored.select("path", F.col("id").alias("romfile_id"))
    rows = files.join(ids, "path").select(F.lit(None).cast("bigint").alias("id"), "name", "index", "rom_id", "romfile_id")
    return state | {"romfiles": state["romfiles"].unionByName(stored, allowMissingColumns=True), "patches": state["patches"].unionByName(inserted(state["patches"], rows, ["rom_id", "index"]), allowMissingColumns=True)}
