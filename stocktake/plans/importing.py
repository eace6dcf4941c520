"""Composed imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.functions.paths import extension
from stocktake.operators import imports as i
from stocktake.plans.registry import query
from stocktake.state import release, settle

# Catalogues of half of the nations are offered, those of a part in a newer version. Entries of low priority
# vanish, items without a dump vanish, large ones change their size, and one entry of each collection is new.


def _imported(m):
    systems = m.systems.where("version < '20200015'").select("name", "id", F.when(F.col("version") < "20200008", F.concat("version", F.lit(".1"))).otherwise(F.col("version")).alias("version"))
    roms = m.roms.withColumn("name", F.concat("name", F.lit("#"), "id"))
    games = m.games.withColumn("parent_id", F.lit(None).cast("bigint"))
    state = {n: getattr(m, n) for n in ("systems", "romfiles", "patches", "headers", "rules")} | {"games": games, "roms": roms}
    listed = games.where("description <> '5-LOW'").join(systems.select(F.col("id").alias("system_id"), F.col("name").alias("system")), "system_id")
    none = F.lit(None).cast("string")
    entries = listed.select("system", "name", "description", "bios", none.alias("cloneof"), none.alias("romof"))
    entries = entries.unionByName(systems.select(F.col("name").alias("system"), F.lit("New").alias("name"), F.lit("new").alias("description"), F.lit(False).alias("bios"), none.alias("cloneof"), none.alias("romof")))
    items = roms.where("coalesce(rom_status, '') <> 'nodump'").join(listed.select(F.col("id").alias("game_id"), "system", F.col("name").alias("game")), "game_id")
    items = items.select("system", "game", "name", F.when(F.col("size") > 45, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "crc", "md5", "sha1", "rom_status")
    return i.import_catalogues(state, systems.select("name", "version"), entries, items)


_TAKEN = """tk AS (SELECT r.*, g.name AS game, g.description, s.version < '20200008' AS newer FROM roms r JOIN games g ON g.id = r.game_id JOIN systems s ON s.id = g.system_id),
    ky AS (SELECT *, newer AND (rom_status IS DISTINCT FROM 'nodump') AS listed FROM tk WHERE NOT newer OR (description <> '5-LOW' AND (rom_status IS DISTINCT FROM 'nodump' OR parent_id IS NOT NULL)))"""
query("p1_import_catalogues", f"+ {_TAKEN} SELECT id, game, CASE WHEN listed AND size > 45 THEN size + 1 ELSE size END AS size, CASE WHEN NOT listed OR size <= 45 THEN romfile_id END AS romfile_id FROM ky")(
    lambda m: (lambda s: s["roms"].join(s["games"].select(F.col("id").alias("game_id"), F.col("name").alias("game")), "game_id").select("id", "game", "size", "romfile_id"))(_imported(m)[0])
)
query("p1_systems", "SELECT id, version || CASE WHEN version < '20200008' THEN '.1' ELSE '' END AS version FROM systems")(lambda m: _imported(m)[0]["systems"].select("id", "version"))
query("p1_games", "+ nw AS (SELECT id FROM systems WHERE version < '20200008') SELECT system_id, name FROM games g WHERE g.description <> '5-LOW' OR g.system_id NOT IN (SELECT id FROM nw) UNION ALL SELECT id, 'New' FROM nw")(
    lambda m: _imported(m)[0]["games"].select("system_id", "name")
)
query("p3_orphans", f"+ {_TAKEN} SELECT DISTINCT romfile_id FROM tk WHERE newer AND romfile_id IS NOT NULL AND (parent_id IS NULL AND (description = '5-LOW' OR rom_status = 'nodump') OR description <> '5-LOW' AND rom_status IS DISTINCT FROM 'nodump' AND size > 45)")(
    lambda m: _imported(m)[1]
)


def _files(m):
    return m.table("part").select(F.col("p_partkey").alias("file"), F.col("p_size").cast("bigint").alias("size"), F.md5(F.concat(F.lit("m"), "p_partkey")).alias("md5"))


query(
    "m3_import_files",
    """+ it AS (SELECT id, size, md5, romfile_id IS NULL AND parent_id IS NULL AS open FROM roms WHERE md5 IS NOT NULL AND (romfile_id IS NOT NULL OR parent_id IS NULL)),
    fl AS (SELECT p_partkey AS file, p_size::BIGINT AS size, md5('m' || p_partkey) AS md5 FROM part)
    SELECT file, (SELECT min(id) FROM it WHERE it.open AND it.size = fl.size AND it.md5 = fl.md5) AS rom,
      CASE WHEN EXISTS (SELECT 1 FROM it WHERE it.open AND it.size = fl.size AND it.md5 = fl.md5) THEN 'valid' WHEN EXISTS (SELECT 1 FROM it WHERE it.size = fl.size AND it.md5 = fl.md5) THEN 'duplicate' ELSE 'invalid' END AS state FROM fl""",
)(lambda m: i.import_files(_files(m), m.roms, ["md5"]).select("file", "rom", "state"))


query(
    "m2_route",
    """SELECT f.path, CASE WHEN f.size < 10 THEN 'delete' WHEN f.romfile_type = 0 THEN 'skip' ELSE 'import' END AS action, CASE WHEN f.path LIKE '%.zip' THEN 'archive' WHEN f.path LIKE '%.chd' THEN 'chd' ELSE 'plain' END AS kind FROM romfiles f""",
)(lambda m: i.route(m.romfiles.select("path", F.when(F.col("size") >= 10, F.col("size")).otherwise(0).alias("size"), extension(F.col("path")).alias("extension")), m.romfiles.where("romfile_type = 0")))


# Every entry has an archive of its items but those without a dump; bad dumps have other contents, and items
# of bios entries are there already. Contents differ between items.


def _stored(m):
    """The items, written down once: numbering the line items of an entry shuffles them all."""
    if not hasattr(m, "stored"):
        m.stored = settle(m.roms.select("id", "name", "bios", "size", "rom_status", "game_id"), "items")
    return m.stored


def _contents(m):
    digest = F.md5(F.concat(F.lit("r"), "id"))
    roms = _stored(m).withColumn("md5", digest).withColumn("crc", F.lit(None).cast("string")).withColumn("sha1", F.lit(None).cast("string")).withColumn("parent_id", F.lit(None).cast("bigint"))
    return roms.withColumn("romfile_id", F.when(F.col("bios"), F.col("id")))


def _members(m):
    rows = _contents(m).where("coalesce(rom_status, '') <> 'nodump'")
    other = F.when(F.coalesce(F.col("rom_status"), F.lit("")) == "baddump", F.sha1("md5")).otherwise(F.col("md5"))
    return rows.select(F.concat(F.lit("in/"), "game_id", F.lit(".zip")).alias("archive"), F.concat(F.lit("m"), "id").alias("member"), "size", "crc", other.alias("md5"), "sha1")


def _archives(m, covers):
    return i.import_archives(_members(m), _contents(m), m.games, m.systems, covers=covers)


_COUNTS = """+ st AS (SELECT *, rom_status IS NOT DISTINCT FROM 'baddump' AS bad, rom_status IS NOT DISTINCT FROM 'nodump' AS gone FROM roms),
    gc AS (SELECT game_id, count(*) FILTER (NOT gone) AS n, count(*) FILTER (NOT gone AND NOT bad AND NOT bios) AS valid, count(*) FILTER (NOT gone AND NOT bad AND bios) AS again, count(*) FILTER (bad) AS unknown, count(*) AS needed FROM st GROUP BY 1),
    ac AS (SELECT *, CASE WHEN valid = n AND {whole} THEN 'keep' WHEN again > 0 OR (unknown > 0 AND {lone}) THEN 'trash' ELSE 'split' END AS action FROM gc WHERE n > 0)"""
_ENTRY, _PART = _COUNTS.format(whole="n = needed", lone="n = 1"), _COUNTS.format(whole="true", lone="true")
query("m4_archives", f"{_ENTRY} SELECT 'in/' || game_id || '.zip' AS archive, action FROM ac")(lambda m: _archives(m, "entry")[0])
query(
    "m4_members",
    f"""{_ENTRY} SELECT 'in/' || st.game_id || '.zip' AS archive, 'm' || st.id AS member, CASE WHEN NOT bad AND NOT st.bios THEN st.id END AS rom, CASE WHEN bad THEN 'invalid' WHEN st.bios THEN 'duplicate' ELSE 'valid' END AS state,
      CASE WHEN NOT bad AND NOT st.bios THEN coalesce(s.custom_name, s.name) || '/' || CASE WHEN action = 'keep' THEN CASE WHEN n > 1 OR s.arcade THEN g.name ELSE regexp_replace(st.name, '[.][a-z]+$', '') END || '.zip'
        WHEN s.arcade OR g.jbfolder THEN g.name || '/' || st.name ELSE st.name END END AS path
    FROM st JOIN ac USING (game_id) JOIN games g ON g.id = st.game_id JOIN systems s ON s.id = g.system_id WHERE NOT gone""",
)(lambda m: _archives(m, "entry")[1])
query("m6_packages", f"{_PART} SELECT 'in/' || game_id || '.zip' AS archive, action FROM ac")(lambda m: _archives(m, "part")[0])


def _discs(m):
    tracks = _members(m).select(F.col("archive").alias("image"), F.col("member").alias("track"), "size", "crc", "md5", "sha1")
    none = F.lit(None).cast("string")
    images = tracks.select("image").distinct().select("image", F.lit("cd").alias("kind"), F.lit(0).cast("bigint").alias("size"), none.alias("crc"), none.alias("md5"), none.alias("sha1"), none.alias("disc_sha1"))
    return i.import_discs(images, tracks, _contents(m).withColumn("name", F.regexp_replace("name", "[.]cue$", ".bin")), m.games, m.systems)


query(
    "m5_discs",
    f"""{_PART} SELECT 'in/' || st.game_id || '.zip' AS image, CASE WHEN action = 'keep' THEN st.id END AS rom, CASE WHEN action <> 'keep' AND NOT bad AND st.bios THEN 'duplicate' WHEN action = 'keep' THEN 'valid' ELSE 'invalid' END AS state,
      CASE WHEN action = 'keep' THEN coalesce(s.custom_name, s.name) || '/' || g.name || '.chd' END AS path
    FROM st JOIN ac USING (game_id) JOIN games g ON g.id = st.game_id JOIN systems s ON s.id = g.system_id WHERE NOT gone""",
)(_discs)


def _folders(m):
    roms = _stored(m).withColumn("name", F.concat("name", F.lit("#"), "id")).withColumn("md5", F.md5(F.concat(F.lit("r"), "id"))).withColumn("parent_id", F.col("game_id")).withColumn("romfile_id", F.when(F.col("bios"), F.col("id")))
    anchors = m.games.select((-F.col("id")).alias("id"), F.lit(i.ANCHOR).alias("name"), F.lit(1).cast("bigint").alias("size"), F.md5(F.concat(F.lit("a"), "id")).alias("md5"), F.col("id").alias("game_id"), F.col("id").alias("parent_id"))
    folder = F.concat(F.lit("f"), "game_id").alias("folder")
    status = F.coalesce(F.col("rom_status"), F.lit(""))
    files = roms.select(folder, F.when(status == "baddump", F.concat("name", F.lit(".moved"))).otherwise(F.col("name")).alias("path"), "size", F.when(status == "nodump", F.sha1("md5")).otherwise(F.col("md5")).alias("md5"))
    files = files.unionByName(anchors.select(folder, F.col("name").alias("path"), "size", "md5"))
    found = i.import_folders(files, roms.unionByName(anchors, allowMissingColumns=True), m.games, m.systems)
    release(_stored(m))
    return found


query(
    "m7_folders",
    """SELECT 'f' || r.game_id AS folder, r.name || '#' || r.id || CASE WHEN r.rom_status = 'baddump' THEN '.moved' ELSE '' END AS path, CASE WHEN r.rom_status IS DISTINCT FROM 'nodump' AND NOT r.bios THEN r.id END AS rom,
      CASE WHEN r.rom_status IS NOT DISTINCT FROM 'nodump' THEN 'invalid' WHEN r.bios THEN 'duplicate' ELSE 'valid' END AS state,
      CASE WHEN r.rom_status IS DISTINCT FROM 'nodump' AND NOT r.bios THEN coalesce(s.custom_name, s.name) || '/' || g.name || '/' || r.name || '#' || r.id END AS target
    FROM roms r JOIN games g ON g.id = r.game_id JOIN systems s ON s.id = g.system_id
    UNION ALL SELECT 'f' || g.id, 'PS3_DISC.SFB', -g.id, 'valid', coalesce(s.custom_name, s.name) || '/' || g.name || '/PS3_DISC.SFB' FROM games g JOIN systems s ON s.id = g.system_id""",
)(_folders)


# Every entry has one own item and a listing of its line items, some of which hang on it already with another
# checksum. Listings of entries with an item without a dump count one file too many and are left out.


def _listed(m):
    lines = m.roms.select("id", "game_id", F.concat("name", F.lit("#"), "id").alias("name"), "size", F.coalesce("rom_status", F.lit("")).alias("status"))
    own = m.games.select((-F.col("id")).alias("id"), F.lit("disc").alias("name"), F.col("id").alias("game_id"))
    old = lines.where("status = 'baddump'").select("id", "game_id", "name", "size", F.lit("old").alias("md5"), F.col("id").alias("romfile_id"), (-F.col("game_id")).alias("parent_id"))
    roms = own.unionByName(old, allowMissingColumns=True)
    romfiles = old.select("id", F.concat(F.lit("at/"), "name").alias("path"), "size")
    listings = lines.groupBy("game_id").agg((F.count("*") + F.max(F.when(F.col("status") == "nodump", 1).otherwise(0))).alias("files")).select(F.col("game_id").cast("string").alias("image"), "game_id", "files")
    entries = lines.select(F.col("game_id").cast("string").alias("image"), F.col("name").alias("path"), F.col("id").alias("ordinal"), "size", F.col("id").alias("location"))
    hashes = entries.select("image", "location", F.md5(F.concat(F.lit("h"), "location")).alias("md5"))
    return {"systems": m.systems, "games": m.games, "roms": roms, "romfiles": romfiles}, listings, entries, hashes


_LISTED = "+ ok AS (SELECT game_id FROM roms GROUP BY 1 HAVING count(*) FILTER (rom_status = 'nodump') = 0)"
query(
    "m8_import_listings",
    f"""{_LISTED} SELECT game_id, name || '#' || id AS name, size, md5('h' || id) AS md5, NULL::BIGINT AS romfile_id, -game_id AS parent_id FROM roms WHERE game_id IN (FROM ok)
    UNION ALL SELECT game_id, name || '#' || id, size, 'old', id, -game_id FROM roms WHERE rom_status = 'baddump' AND game_id NOT IN (FROM ok) UNION ALL SELECT id, 'disc', NULL, NULL, NULL, NULL FROM games""",
)(lambda m: i.import_listings(*_listed(m))[0]["roms"].select("game_id", "name", "size", "md5", "romfile_id", "parent_id"))
query("m8_orphans", f"{_LISTED} SELECT id AS romfile_id FROM roms WHERE rom_status = 'baddump' AND game_id IN (FROM ok)")(lambda m: i.import_listings(*_listed(m))[1])
query(
    "m8_purge_listings",
    "SELECT r.id, CASE WHEN g.jbfolder THEN coalesce(s.custom_name, s.name) || '/Trash/' || parse_filename(r.name || '#' || r.id) ELSE 'at/' || r.name || '#' || r.id END AS path FROM roms r JOIN games g ON g.id = r.game_id JOIN systems s ON s.id = g.system_id WHERE r.rom_status = 'baddump'",
)(lambda m: i.purge_listings(_listed(m)[0], m.games.where("jbfolder").select("id"))["romfiles"].select("id", "path"))


def _patched(m):
    added = m.roms.where("size > 45").select(F.col("id").alias("rom_id"), F.lit("extra").alias("name"), F.concat(F.lit("p/"), "id").alias("path"), "size").unionByName(m.patches.select("rom_id", "name", F.lit("old").alias("path"), F.lit(1).cast("bigint").alias("size")))
    return i.import_patches({"romfiles": m.romfiles, "patches": m.patches}, added)


query("m9_import_patches", "SELECT rom_id, name, index FROM patches UNION ALL SELECT id, 'extra', (SELECT count(*) FROM patches p WHERE p.rom_id = r.id)::INT FROM roms r WHERE size > 45")(lambda m: _patched(m)["patches"].select("rom_id", "name", "index"))
query("m9_patch_files", "SELECT path, size FROM romfiles UNION ALL SELECT 'p/' || id, size FROM roms WHERE size > 45")(lambda m: _patched(m)["romfiles"].select("path", "size"))
