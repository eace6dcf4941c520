"""Audits, deltas and action plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.functions.hashing import crc32
from stocktake.operators import audit as a
from stocktake.operators import delta as d
from stocktake.operators import plan as p
from stocktake.plans.registry import query


def _listing(m):
    return m.romfiles.where("size >= 10").select("path").unionByName(m.files.select("path"))


_LISTING = "listing AS (SELECT path FROM romfiles WHERE size >= 10 UNION ALL SELECT path FROM files)"
query("j16_foreign_files", f"+ {_LISTING} SELECT path FROM listing WHERE path NOT IN (SELECT path FROM romfiles)")(lambda m: a.foreign_files(_listing(m), m.romfiles))
query("j17_missing_files", f"+ {_LISTING} SELECT id, path FROM romfiles WHERE path NOT IN (SELECT path FROM listing)")(lambda m: a.missing_files(m.romfiles, _listing(m)).select("id", "path"))
query(
    "p13_purge_plan",
    f"""+ {_LISTING} SELECT 'missing' AS kind, path FROM romfiles WHERE path NOT IN (SELECT path FROM listing) UNION ALL SELECT 'trash', path FROM romfiles WHERE path ILIKE '%/Trash/%' OR path ILIKE 'Trash/%'
    UNION ALL SELECT 'orphan', path FROM romfiles f WHERE NOT EXISTS (SELECT 1 FROM roms r WHERE r.romfile_id = f.id AND r.size > 45) AND NOT EXISTS (SELECT 1 FROM games g WHERE g.playlist_id = f.id)
    UNION ALL SELECT 'foreign', path FROM listing WHERE path NOT IN (SELECT path FROM romfiles)""",
)(lambda m: a.purge_plan(m.romfiles, m.roms.where("size > 45"), m.games, _listing(m)))


def _expected(m):
    k = F.col("doc_id")
    size = F.octet_length("text").cast("bigint")
    digest = F.when(k % 5 == 1, F.md5(F.lit("x"))).otherwise(F.md5("text"))
    return m.table("documents").select(k.alias("file"), F.when(k % 7 == 0, 0).when(k % 7 == 1, size + 1).otherwise(size).cast("bigint").alias("size"), F.lit(None).cast("string").alias("crc"), F.when(k % 3 != 0, F.upper(digest)).alias("md5"), F.when(k % 2 == 0, F.sha1("text")).alias("sha1"))


query(
    "p8_check",
    """SELECT doc_id AS file, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 1 THEN 'size mismatch' WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 5 = 1 THEN 'checksum mismatch' ELSE 'ok' END
      WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'no checksum' END AS status FROM documents""",
)(lambda m: a.checked(_expected(m), m.files.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("file"), "content")))


def _archives(m):
    items = m.roms.where("md5 is not null").select(F.col("game_id").alias("archive"), F.concat("name", F.lit("#"), "id").alias("name"), "size", F.col("crc"))
    members = m.roms.where("md5 is not null and game_id % 9 <> 0 and not (game_id % 8 = 0 and id % 100 = 1)").select(
        F.col("game_id").alias("archive"), F.concat("name", F.lit("#"), "id", F.when(F.col("game_id") % 10 == 0, "x").otherwise("")).alias("name"), (F.col("size") + F.when(F.col("game_id") % 7 == 0, 1).otherwise(0)).alias("size"), F.upper("crc").alias("crc")
    )
    return a.checked_archives(items, members)


query(
    "p8_check_archives",
    """+ e AS (SELECT game_id, count(*) AS n, count(*) FILTER (game_id % 8 = 0 AND id % 100 = 1) AS cut FROM roms WHERE md5 IS NOT NULL GROUP BY game_id), z AS (SELECT DISTINCT game_id FROM roms WHERE md5 IS NOT NULL AND size > 0)
    SELECT game_id AS archive, CASE WHEN game_id % 9 = 0 OR cut = n THEN 'missing' WHEN cut > 0 THEN 'member count' WHEN game_id % 10 = 0 THEN 'member name' WHEN game_id % 7 = 0 THEN 'size mismatch' ELSE 'ok' END AS status FROM e""",
)(_archives)
query("p15_empty_files", "SELECT r.id FROM roms r JOIN games g ON g.id = r.game_id WHERE r.romfile_id IS NULL AND r.size % 10 = 0 AND r.crc IS NULL AND g.completion = 1")(
    lambda m: a.empty_files_to_create(m.games, m.roms.where("size % 10 = 0").withColumn("size", F.lit(0))).select("id")
)
query(
    "a7_conversion_diff",
    """SELECT sum(size)::BIGINT AS original, sum(size + 2)::BIGINT AS old, sum(size + id % 3)::BIGINT AS new, round(100.0 * sum(size + 2) / sum(size), 6) AS old_ratio, round(100.0 * sum(size + id % 3) / sum(size), 6) AS new_ratio,
      round(100.0 * sum(size + id % 3) / sum(size + 2), 6) AS change_ratio FROM romfiles""",
)(lambda m: a.conversion_diff(m.romfiles.select(F.col("id").alias("key"), F.col("size").alias("original"), (F.col("size") + 2).alias("size")), m.romfiles.select(F.col("id").alias("key"), (F.col("size") + F.col("id") % 3).alias("size"))))

_NEW = "SELECT id, path || '.new' AS path, size, parent_id, romfile_type FROM romfiles WHERE id % 4 = 0"
query("k1_insert", "SELECT (SELECT max(id) FROM romfiles) + row_number() OVER (ORDER BY path) AS id, path FROM files")(lambda m: d.inserted(m.romfiles, m.files.select("path"), ["path"]).select("id", "path"))
query("k2_update", "SELECT id, CASE WHEN id % 4 = 0 THEN path || '.new' ELSE path END AS path, size FROM romfiles")(
    lambda m: d.updated(m.romfiles, m.romfiles.where("id % 4 = 0").select("id", F.concat("path", F.lit(".new")).alias("path")), ["path"]).select("id", "path", "size")
)
query("k2_upsert", f"SELECT * FROM romfiles WHERE id % 4 <> 0 UNION ALL ({_NEW})")(lambda m: d.upserted(m.romfiles, m.romfiles.where("id % 4 = 0").withColumn("path", F.concat("path", F.lit(".new"))), ["id"]))
query("k4_delete_rules", "SELECT id FROM rules WHERE header_id <> 2")(lambda m: d.deleted(m.rules, m.rules.where("header_id = 2").select("header_id").distinct(), ["header_id"]).select("id"))


def _state(m):
    return {n: getattr(m, n) for n in ("systems", "games", "roms", "romfiles", "patches", "headers", "rules")}


def _counts(m, state):
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in state.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_GONE = "gone AS (SELECT id FROM systems WHERE id % 3 = 0), gg AS (SELECT id FROM games WHERE system_id IN (SELECT id FROM gone)), gr AS (SELECT id FROM roms WHERE game_id IN (SELECT id FROM gg)), gh AS (SELECT id FROM headers WHERE system_id IN (SELECT id FROM gone))"
query(
    "p14_purge_systems",
    f"""+ {_GONE} SELECT 'systems' AS name, count(*) AS n FROM systems WHERE id NOT IN (FROM gone) UNION ALL SELECT 'games', count(*) FROM games WHERE id NOT IN (FROM gg) UNION ALL SELECT 'roms', count(*) FROM roms WHERE id NOT IN (FROM gr)
    UNION ALL SELECT 'romfiles', count(*) FROM romfiles UNION ALL SELECT 'patches', count(*) FROM patches WHERE rom_id NOT IN (FROM gr) UNION ALL SELECT 'headers', count(*) FROM headers WHERE id NOT IN (FROM gh)
    UNION ALL SELECT 'rules', count(*) FROM rules WHERE header_id NOT IN (FROM gh)""",
)(lambda m: _counts(m, d.delete_systems(_state(m), m.systems.where("id % 3 = 0").select("id"))))
query("k4_delete_romfiles", "SELECT r.id, CASE WHEN r.romfile_id % 2 <> 0 THEN r.romfile_id END AS romfile_id FROM roms r")(lambda m: d.delete_romfiles(_state(m), m.romfiles.where("id % 2 = 0").select("id"))["roms"].select("id", "romfile_id"))
query(
    "k4_delete_games",
    "+ gg AS (SELECT id FROM games WHERE id % 50 = 0), cl AS (SELECT id FROM gg UNION SELECT id FROM games WHERE parent_id IN (SELECT id FROM gg)) SELECT id FROM games WHERE id NOT IN (SELECT id FROM cl)",
)(lambda m: d.delete_games(_state(m), m.games.where("id % 50 = 0").select("id"))["games"].select("id"))
query("p17_update_check", "SELECT name, CASE WHEN id % 6 = 0 THEN 'gone' WHEN id % 4 = 0 THEN 'update' ELSE 'current' END AS status FROM systems")(
    lambda m: d.wanted_update(m.systems.select("name", "version"), m.systems.where("id % 6 <> 0").select("name", F.when(F.col("id") % 4 == 0, "20300000").otherwise(F.col("version")).alias("version")))
)


def _catalogue(m):
    k = F.col("p_partkey")
    return m.table("part").select(k.cast("string").alias("name"), F.when(k % 4 != 1, (k / 2).cast("bigint").cast("string")).alias("cloneof"), F.when(k % 5 == 0, (k - 1).cast("string")).alias("romof"), (k % 13 == 0).alias("bios"))


query(
    "p2_resolved_parents",
    """RECURSIVE + c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <> 1 THEN p_partkey // 2 END AS cl, CASE WHEN p_partkey % 5 = 0 THEN p_partkey - 1 END AS ro, p_partkey % 13 = 0 AS bios FROM part),
    w AS (SELECT k, 0 AS wave FROM c WHERE coalesce(cl, ro) IS NULL UNION ALL SELECT c.k, w.wave + 1 FROM c JOIN w ON coalesce(c.cl, c.ro) = w.k)
    SELECT c.k::VARCHAR AS name, p.k::VARCHAR AS parent_name, b.k::VARCHAR AS bios_name, w.wave::INT AS wave FROM c JOIN w ON w.k = c.k LEFT JOIN c p ON p.k = coalesce(c.cl, c.ro) AND NOT p.bios LEFT JOIN c b ON b.k = c.ro AND b.bios""",
)(lambda m: d.resolved_parents(_catalogue(m)))


def _items(m, where: str):
    return m.roms.where(where).select("game_id", F.concat("name", F.lit("#"), "id").alias("name"), "size", "crc")


query(
    "p3_changed_roms",
    """SELECT game_id, name || '#' || id AS name, CASE WHEN id % 3 = 0 THEN 'added' WHEN id % 5 = 0 THEN 'removed' WHEN id % 7 = 0 OR id % 11 = 0 AND crc IS NOT NULL THEN 'changed' ELSE 'same' END AS change FROM roms WHERE NOT (id % 3 = 0 AND id % 5 = 0)""",
)(
    lambda m: d.changed_roms(
        _items(m, "id % 3 <> 0"),
        m.roms.where("id % 5 <> 0").select("game_id", F.concat("name", F.lit("#"), "id").alias("name"), (F.col("size") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("id") % 11 == 0, F.reverse(F.concat("crc", F.lit("z")))).otherwise(F.upper("crc")).alias("crc")),
    )
)
#: Every class of file occurs: the extension follows from the size.
_ENDS = ("zip", "7z", "chd", "cso", "nsz", "rvz", "zso", "cue", "iso", "nsp", "rdsk", "riff", "gdi", "bin", "dat")
_HAS = ", ".join(f"bool_or(e = '{e}') AS h_{e}" for e in _ENDS)
_CLASS = f"""fl AS (SELECT r.game_id AS id, list_extract({list(_ENDS)}, (f.size % {len(_ENDS)})::INT + 1) AS e, regexp_extract(r.name, '\\.([^./]*)$', 1) AS own, f.path, f.id IN (SELECT parent_id FROM romfiles WHERE parent_id IS NOT NULL) AS kid FROM roms r JOIN romfiles f ON f.id = r.romfile_id),
 ag AS (SELECT id, count(*) AS items, count(DISTINCT path) AS files, bool_or(kid) AS kids, count(*) FILTER (own = 'iso') AS isos, count(*) FILTER (own = 'nsp') AS nsps, count(*) FILTER (own = 'bin') AS bins, count(*) FILTER (own = 'gdi') AS gdis, {_HAS} FROM fl GROUP BY id)"""


def _classes(m):
    path = F.concat("path", F.lit("."), F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("size") % len(_ENDS)).cast("int") + 1))
    return p.game_classes(m.games, m.roms, m.romfiles.withColumn("path", path))


query("u4_game_classes", f"+ {_CLASS} SELECT id, files, items, kids AS has_children, h_zip AS zipped, isos = 1 AS one_iso FROM ag")(
    lambda m: _classes(m).select("id", "files", "items", "has_children", F.array_contains("classes", "zip").alias("zipped"), F.array_contains("single", "iso").alias("one_iso"))
)
#: The expected cells, written out: class, action and what must hold besides, in order of precedence.
_EXPECTED = {
    "p9_convert_original": "7z extract; zip extract; chd decode; cso decode; nsz decode; rvz decode; zso decode",
    "p9_convert_7z": "chd archive decoded; cso archive decoded; nsz archive decoded; rvz archive decoded; zso archive decoded; zip rearchive; 7z -; * archive",
    "p9_convert_zip": "chd archive decoded; cso archive decoded; nsz archive decoded; rvz archive decoded; zso archive decoded; 7z rearchive; zip -; * archive",
    "p9_convert_chd": "7z encode extracted; zip encode extracted; cue encode; iso encode; cso encode decoded; zso encode decoded; chd -; rdsk encode; riff encode",
    "p9_convert_cso": "7z encode extracted if items = 1 AND isos = 1; zip encode extracted if items = 1 AND isos = 1; iso encode; chd encode decoded if items = 1 AND isos = 1; cso -; zso encode decoded",
    "p9_convert_nsz": "7z encode extracted if items = 1 AND nsps = 1; zip encode extracted if items = 1 AND nsps = 1; nsp encode; nsz -",
    "p9_convert_rvz": "7z encode extracted if items = 1 AND isos = 1; zip encode extracted if items = 1 AND isos = 1; iso encode; rvz -",
    "p9_convert_zso": "7z encode extracted if items = 1 AND isos = 1; zip encode extracted if items = 1 AND isos = 1; iso encode; chd encode decoded if items = 1 AND isos = 1; cso encode decoded; zso -",
    "p10_export_original": "7z extract; zip extract; chd decode; cso decode; nsz decode; rvz decode; zso decode; * copy",
    "p10_export_7z": "chd archive decoded; cso archive decoded; nsz archive decoded; rvz archive decoded; zso archive decoded; zip rearchive; 7z copy; * archive",
    "p10_export_zip": "chd archive decoded; cso archive decoded; nsz archive decoded; rvz archive decoded; zso archive decoded; 7z rearchive; zip copy; * archive",
    "p10_export_chd": "7z encode extracted; zip encode extracted; cue encode; iso encode; cso encode decoded; zso encode decoded; chd copy",
    "p10_export_cso": "7z encode extracted; zip encode extracted; iso encode; chd encode decoded; cso copy; zso encode decoded",
    "p10_export_zso": "7z encode extracted; zip encode extracted; iso encode; chd encode decoded; zso copy",
    "p10_export_nsz": "7z encode extracted; zip encode extracted; nsp encode",
    "p10_export_rvz": "7z encode extracted; zip encode extracted; iso encode; rvz copy",
    "p10_export_wbfs": "7z encode extracted; zip encode extracted; iso encode; rvz encode decoded",
    "p10_export_iso": "7z extract; zip extract; cue encode if bins = 1; iso copy; chd decode; cso decode; zso decode",
    "p10_export_gdi": "7z encode extracted; zip encode extracted; cue encode; chd encode decoded; gdi copy if gdis = 1",
}


def _plan_sql(cells: str) -> str:
    classes, actions = [], []
    for cell in cells.split("; "):
        c, _, rest = cell.partition(" ")
        action, _, guard = rest.partition(" if ")
        guard = " AND ".join(x for x in (guard, "NOT kids" if c == "chd" else "") if x) or "true"
        classes.append("ELSE 'other'" if c == "*" else f"WHEN h_{c} THEN '{c}'")
        if action != "-":
            actions.append(f"WHEN class = '{'other' if c == '*' else c}' AND {guard} THEN '{action}'")
    tail = "" if classes[-1].startswith("ELSE") else " ELSE 'other'"
    return f"+ {_CLASS}, cl AS (SELECT *, CASE {' '.join(classes)}{tail} END AS class FROM ag), ac AS (SELECT id, class, CASE {' '.join(actions)} END AS action FROM cl) SELECT id, class, action FROM ac WHERE action IS NOT NULL"


for _name, _cells in _EXPECTED.items():
    _matrix, _target = (p.CONVERT if _name.startswith("p9") else p.EXPORT), _name.rsplit("_", 1)[1].upper()
    query(_name, _plan_sql(_cells))(lambda m, t=_target, x=_matrix: p.planned(_classes(m), t, x))
query(
    "p11_playlists",
    r"""+ di AS (SELECT id, system_id, regexp_replace(name, ' \(Disc \d+\).*', '') AS playlist, completion FROM games WHERE regexp_matches(name, ' \(Disc \d+\)')),
    wh AS (SELECT system_id, playlist FROM di GROUP BY ALL HAVING bool_and(completion = 0)),
    fi AS (SELECT DISTINCT system_id, playlist, f.path, list_position(['chd', 'cso', 'cue', 'iso', 'rvz'], regexp_extract(f.path, '\.([^./]*)$', 1)) AS rk FROM di JOIN wh USING (system_id, playlist) JOIN roms r ON r.game_id = di.id JOIN romfiles f ON f.id = r.romfile_id),
    be AS (SELECT *, min(rk) OVER (PARTITION BY system_id, playlist) AS best FROM fi WHERE rk > 0)
    SELECT system_id, playlist, string_agg(regexp_extract(path, '([^/]*)$', 1), chr(10) ORDER BY regexp_extract(path, '([^/]*)$', 1)) || chr(10) AS lines FROM be WHERE rk = best GROUP BY system_id, playlist""",
)(lambda m: p.playlists(m.games.withColumn("completion", F.when(F.col("completion") == 0, 2).otherwise(0)), m.roms, m.romfiles))
query(
    "p7_rebuild_sources",
    """+ rw AS (SELECT r.*, g.system_id FROM roms r JOIN games g ON g.id = r.game_id WHERE NOT r.disk), hv AS (SELECT * FROM rw WHERE romfile_id IS NOT NULL)
    SELECT id, source FROM (SELECT n.id, coalesce((SELECT min(h.id) FROM hv h WHERE h.system_id = n.system_id AND h.size = n.size AND h.crc = n.crc), (SELECT min(h.id) FROM hv h WHERE h.system_id = n.system_id AND h.size = n.size AND h.md5 = n.md5),
      (SELECT min(h.id) FROM hv h WHERE h.system_id = n.system_id AND h.size = n.size AND h.sha1 = n.sha1)) AS source FROM rw n WHERE n.romfile_id IS NULL) WHERE source IS NOT NULL""",
)(lambda m: p.rebuild_sources(m.roms, m.games))
query(
    "p7_trim_non_merged",
    "SELECT r.id, 'delete' AS action FROM roms r WHERE r.parent_id IN (SELECT r2.id FROM roms r2 JOIN games g ON g.id = r2.game_id WHERE g.bios) AND r.romfile_id IS NOT NULL",
)(lambda m: p.rebuild_plan(m.roms, m.games, 1).where("action = 'delete'"))
query("p12_catalogue_from_files", "SELECT path, strlen(text)::BIGINT AS size, md5(text) AS md5, sha1(text) AS sha1 FROM files")(lambda m: m.files.select("path", "length", "content").select("path", F.col("length").alias("size"), F.md5("content").alias("md5"), F.sha1("content").alias("sha1")))
query("x1_crc32")(lambda m: m.files.select("doc_id", crc32(F.col("content")).alias("crc")))
