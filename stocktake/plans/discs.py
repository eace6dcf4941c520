"""Queries over disc images, packages, patches and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.operators import discs as d
from stocktake.operators import settings as s
from stocktake.plans.registry import query


def _settings(m):
    return m.table("nation").join(m.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("key"), F.concat_ws("|", "r_name", "n_name").alias("value"))


_SETTINGS = "st AS (SELECT n_nationkey::BIGINT AS id, n_name AS key, r_name || '|' || n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey)"
query("f27_settings", f"+ {_SETTINGS} SELECT id, key, len(string_split(value, '|'))::INT AS items FROM st")(lambda m: _settings(m).select("id", "key", F.size(s.as_list(F.col("value"))).alias("items")))
query("p19_add", f"+ {_SETTINGS} SELECT id, key, CASE WHEN key = 'NATION_0' THEN 'AFRICA|AMERICA|NATION_0' ELSE value END AS value FROM st")(lambda m: s.add_to_list(_settings(m), "NATION_0", "AMERICA"))
query("p19_remove", f"+ {_SETTINGS} SELECT id, key, CASE WHEN key = 'NATION_0' THEN 'NATION_0' ELSE value END AS value FROM st")(lambda m: s.remove_from_list(_settings(m), "NATION_0", "AFRICA"))
query("p19_unset", f"+ {_SETTINGS} SELECT id, key, CASE WHEN key <> 'NATION_0' THEN value END AS value FROM st")(lambda m: s.set_value(_settings(m), "NATION_0", None))
query("p19_invalid", f"+ {_SETTINGS} SELECT key, value FROM st WHERE key = 'NATION_1'")(
    lambda m: s.invalid(_settings(m), {"NATION_0": ["AFRICA", "NATION_0"], "NATION_1": ["AMERICA"]}, {})
)
query("t7_children_first", "SELECT g.id, CASE WHEN EXISTS (SELECT 1 FROM roms r JOIN romfiles f ON f.id = r.romfile_id WHERE r.game_id = g.id AND f.parent_id IS NOT NULL) THEN 0 ELSE 1 END AS rank FROM games g")(
    lambda m: d.children_first(m.games, m.roms, m.romfiles)
)
query(
    "p16_parent_images",
    """+ hv AS (SELECT r.game_id AS id, min(f.id) AS romfile_id FROM roms r JOIN romfiles f ON f.id = r.romfile_id WHERE f.path LIKE '%.chd' GROUP BY 1),
    fs AS (SELECT playlist_id, id, romfile_id FROM (SELECT g.playlist_id, g.id, h.romfile_id, row_number() OVER (PARTITION BY g.playlist_id ORDER BY g.name, g.id) AS k FROM games g JOIN hv h USING (id) WHERE g.playlist_id IS NOT NULL) WHERE k = 1)
    SELECT g.id, fs.romfile_id AS parent_romfile_id FROM games g JOIN fs USING (playlist_id) WHERE g.id <> fs.id""",
)(lambda m: d.parent_images(m.games, m.roms, m.romfiles))
query("t12_hash_order", "SELECT id, CASE WHEN disk THEN 'sha1,md5,crc' ELSE 'crc,md5,sha1' END AS tried FROM roms")(lambda m: m.roms.select("id", F.array_join(d.hash_order(F.col("disk")), ",").alias("tried")))
query(
    "j20_zipped_tracks",
    """+ a AS (SELECT id, game_id, row_number() OVER (PARTITION BY game_id ORDER BY id) AS place FROM roms), b AS (SELECT game_id, size AS track_size, row_number() OVER (PARTITION BY game_id ORDER BY size, id) AS place FROM roms WHERE romfile_id IS NOT NULL)
    SELECT a.id, place::INT AS place, track_size FROM a JOIN b USING (game_id, place)""",
)(lambda m: d.zipped(m.roms.select("id", "game_id"), m.roms.where("romfile_id is not null").select("game_id", F.col("size").alias("track_size"), F.col("id").alias("k")), "game_id", ["id"], ["track_size", "k"]).select("id", "place", "track_size"))
query("a19_extents", "SELECT game_id AS image, name AS path, sum(size)::BIGINT AS size, min(id) AS location FROM roms GROUP BY ALL")(
    lambda m: d.extents(m.roms.select(F.col("game_id").alias("image"), F.col("name").alias("path"), F.col("id").alias("ordinal"), "size", F.col("id").alias("location")))
)
query(
    "m9_new_patches",
    """+ ad AS (SELECT DISTINCT rom_id, name FROM (SELECT rom_id, name || CASE WHEN rom_id % 2 = 0 THEN '' ELSE '.new' END AS name FROM patches UNION ALL SELECT id, 'extra' FROM roms WHERE size > 45)),
    fr AS (SELECT * FROM ad WHERE NOT EXISTS (SELECT 1 FROM patches p WHERE p.rom_id = ad.rom_id AND p.name = ad.name))
    SELECT rom_id, name, ((SELECT count(*) FROM patches p WHERE p.rom_id = fr.rom_id) + row_number() OVER (PARTITION BY rom_id ORDER BY name) - 1)::INT AS index FROM fr""",
)(
    lambda m: d.new_patches(
        m.patches, m.patches.select("rom_id", F.concat("name", F.when(F.col("rom_id") % 2 == 0, "").otherwise(".new")).alias("name")).unionByName(m.roms.where("size > 45").select(F.col("id").alias("rom_id"), F.lit("extra").alias("name")))
    )
)
query("a17_unique_paths", "SELECT path, min(id) AS id FROM romfiles GROUP BY path")(lambda m: d.unique_by_path(m.romfiles))
query("j18_not_imported", "SELECT name, code FROM (SELECT DISTINCT p_brand AS code, 'brand ' || p_brand AS name FROM part UNION SELECT 'known', name FROM systems) WHERE name NOT IN (SELECT name FROM systems)")(
    lambda m: d.not_imported(m.table("part").select(F.col("p_brand").alias("code"), F.concat(F.lit("brand "), "p_brand").alias("name")).union(m.systems.select(F.lit("known").alias("code"), "name")).distinct(), m.systems).select("name", "code")
)
query(
    "x20_human_sizes",
    "SELECT id, CASE WHEN z < 1024 THEN z || ' B' WHEN z < 1048576 THEN printf('%.2f KiB', z / 1024.0::DOUBLE) WHEN z < 1073741824 THEN printf('%.2f MiB', z / 1048576.0::DOUBLE) ELSE printf('%.2f GiB', z / 1073741824.0::DOUBLE) END AS shown FROM (SELECT id, size * size * size * size * size AS z FROM romfiles)",
)(lambda m: m.romfiles.select("id", d.human_size(F.col("size") * F.col("size") * F.col("size") * F.col("size") * F.col("size")).alias("shown")))
query("x23_version_gate", "SELECT id, version >= '2020000012' AS supported FROM systems")(lambda m: m.systems.select("id", d.supports(F.col("version"), "2020000012").alias("supported")))
