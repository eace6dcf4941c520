"""Filters, lookups, joins, counts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.operators import catalogue as c
from stocktake.operators import joins as j
from stocktake.plans.registry import query

query("f1_systems", "SELECT id, name FROM systems")(lambda m: c.systems(m.systems).select("id", "name"))
query("f2_arcade_systems", "SELECT id, name FROM systems WHERE arcade")(lambda m: c.systems(m.systems, arcade=True).select("id", "name"))
query("f3_systems_by_url", "SELECT id, name FROM systems WHERE url = 'https://host/3'")(lambda m: c.systems(m.systems, url="https://host/3").select("id", "name"))
query("f4_systems_like", "SELECT id, name FROM systems WHERE name ILIKE 'sYsTeM 1%(p%'")(lambda m: c.systems(m.systems, name_like="sYsTeM 1%(p%").select("id", "name"))
query("f5_system_by_name", "SELECT id, name FROM systems WHERE replace(name, ' (Parent-Clone)', '') = 'System 12'")(lambda m: c.systems(m.systems, name="System 12").select("id", "name"))
query("f6_games_of_system", "SELECT id, name FROM games WHERE system_id = 7")(lambda m: c.games(m.games, system_id=7).select("id", "name"))
query("f7_wanted_games", "SELECT id, name FROM games WHERE sorting <> 2")(lambda m: c.games(m.games, wanted=True).select("id", "name"))
query("f8_games_by_ids", "SELECT id, name FROM games WHERE id IN (1, 5, 9, 1000000000)")(lambda m: c.games(m.games, ids=[1, 5, 9, 1000000000]).select("id", "name"))
query("f9_parent_games", "SELECT id, name FROM games WHERE parent_id IS NULL")(lambda m: c.games(m.games, parents=True).select("id", "name"))
query("f9_clone_games", "SELECT id, parent_id FROM games WHERE parent_id IS NOT NULL")(lambda m: c.games(m.games, parents=False).select("id", "parent_id"))
query("f10_game_by_name_bios", "SELECT id, name FROM games WHERE name = 'Game 13 (' || regexp_extract(name, '\\(([^()]*)\\)', 1) || ') (Beta)' AND bios")(
    lambda m: c.games(m.games, bios=True).where(F.col("name") == F.concat(F.lit("Game 13 ("), F.regexp_extract("name", r"\(([^()]*)\)", 1), F.lit(") (Beta)"))).select("id", "name")
)
query("f11_partial_games", "SELECT id FROM games WHERE completion = 1")(lambda m: c.partial_games(m.games).select("id"))
query("f11_full_games", "SELECT id FROM games WHERE completion = 2")(lambda m: c.full_games(m.games).select("id"))
query("f12_full_games_like", "SELECT id FROM games WHERE completion = 2 AND name ILIKE '%(JAPAN)%'")(lambda m: c.full_games(m.games, "%(JAPAN)%").select("id"))
query("f13_all_roms", "SELECT id, name, size FROM roms")(lambda m: c.roms(m.roms).select("id", "name", "size"))
query("f14_own_roms", "SELECT id FROM roms WHERE parent_id IS NULL")(lambda m: c.roms(m.roms, c.OWN).select("id"))
query("f15_own_or_inherited_roms", "SELECT id FROM roms WHERE parent_id IS NULL OR NOT bios")(lambda m: c.roms(m.roms, c.OWN_OR_INHERITED).select("id"))
query("f16_roms_of_game", "SELECT id, name FROM roms WHERE game_id = 3")(lambda m: c.roms(m.roms, game_id=3).select("id", "name"))
query("f17_inherited_roms", "SELECT id FROM roms WHERE parent_id IS NOT NULL")(lambda m: c.roms(m.roms, c.INHERITED).select("id"))
query("f17_inherited_bios_roms", "SELECT id FROM roms WHERE parent_id IS NOT NULL AND bios")(lambda m: c.roms(m.roms, c.INHERITED_BIOS).select("id"))
query("f18_child_roms", "SELECT id FROM roms WHERE parent_id = 501")(lambda m: c.roms(m.roms, parent_id=501).select("id"))
query("f19_missing_roms", "SELECT id FROM roms WHERE romfile_id IS NULL AND parent_id IS NULL AND game_id IN (SELECT id FROM games WHERE completion = 1)")(lambda m: c.missing_roms(m.roms, c.partial_games(m.games)).select("id"))
query("f20_present_roms", "SELECT id FROM roms WHERE romfile_id IS NOT NULL AND game_id IN (SELECT id FROM games WHERE sorting <> 2)")(lambda m: c.present_roms(m.roms, c.games(m.games, wanted=True)).select("id"))
query("f21_present_original_roms", "SELECT id FROM roms WHERE romfile_id IS NOT NULL AND original AND game_id IN (SELECT id FROM games WHERE sorting <> 2)")(
    lambda m: c.present_roms(m.roms, c.games(m.games, wanted=True), original=True).select("id")
)
query("f22_first_rom_by_size_crc", "SELECT size, crc, game_id, min(id) AS id FROM roms WHERE crc IS NOT NULL GROUP BY size, crc, game_id")(lambda m: c.first_rom(m.roms.where("crc is not null"), "size", "crc", "game_id"))
query("f23_patches_of_rom", "SELECT rom_id, index, name FROM patches")(lambda m: m.patches.select("rom_id", "index", "name").orderBy("rom_id", "index"))
query("f24_romfiles_by_parent", "SELECT id, parent_id, path FROM romfiles WHERE parent_id IS NOT NULL")(lambda m: m.romfiles.where("parent_id is not null").select("id", "parent_id", "path"))
query("f25_trashed_romfiles", "SELECT id, path FROM romfiles WHERE path ILIKE '%/Trash/%'")(lambda m: c.trashed_romfiles(m.romfiles).select("id", "path"))
query("f25_trashed_romfiles_global", "SELECT id, path FROM romfiles WHERE path ILIKE '%/Trash/%' OR path ILIKE 'Trash/%'")(lambda m: c.trashed_romfiles(m.romfiles, include_global=True).select("id", "path"))
query("f26_headers_with_rules", "SELECT h.system_id, h.size, r.start_byte, r.hex_value FROM headers h JOIN rules r ON r.header_id = h.id")(
    lambda m: m.headers.join(m.rules.withColumnRenamed("id", "rule_id"), F.col("id") == F.col("header_id")).select("system_id", "size", "start_byte", "hex_value")
)
query("f29_region_members", "SELECT id FROM games WHERE list_contains(string_split(regions, '-'), 'EU')")(lambda m: m.games.where(c.region_member(F.col("regions"), "EU")).select("id"))
query("f30_ui_filter_stack", "SELECT id FROM games WHERE completion <> 0 AND sorting <> 2 AND contains(lower(name), 'beta')")(lambda m: c.ui_games(m.games, none=False, ignored=False, text="BETA").select("id"))
query("f31_one_region_games", "SELECT id FROM games WHERE sorting = 1")(lambda m: c.games(m.games, sorting=1).select("id"))
query("f32_jbfolder_games", "SELECT id FROM games WHERE jbfolder")(lambda m: c.games(m.games, jbfolder=True).select("id"))
query("f33_skip_nodump", "SELECT id FROM roms WHERE coalesce(rom_status, '') <> 'nodump'")(lambda m: m.roms.where("coalesce(rom_status, '') <> 'nodump'").select("id"))
query("f34_multi_disc_games", r"SELECT id, name FROM games WHERE regexp_matches(name, ' \(Disc \d+\).*')")(lambda m: m.games.where(F.col("name").rlike(r" \(Disc \d+\).*")).select("id", "name"))

query("j1_roms_of_systems", "SELECT r.id, g.system_id FROM roms r JOIN games g ON r.game_id = g.id")(lambda m: j.roms_of_systems(m.roms, m.games).select("id", "system_id"))
query("j2_patched_romfiles", "SELECT f.id, g.system_id FROM romfiles f JOIN patches p ON p.romfile_id = f.id JOIN roms r ON r.id = p.rom_id JOIN games g ON g.id = r.game_id")(
    lambda m: j.patched_romfiles(m.romfiles, m.patches, m.roms, m.games).select("id", "system_id")
)
query("j3_romfiles_of_system", "SELECT id, path FROM romfiles WHERE id IN (SELECT romfile_id FROM roms WHERE game_id IN (SELECT id FROM games WHERE system_id = 7))")(
    lambda m: j.romfiles_of_system(m.romfiles, m.roms, m.games, 7).select("id", "path")
)
query("j4_romfiles_of_system_by_extension", "SELECT id, path FROM romfiles WHERE path ILIKE '%.chd' AND parent_id IS NULL AND id IN (SELECT romfile_id FROM roms WHERE game_id IN (SELECT id FROM games WHERE system_id = 7))")(
    lambda m: j.romfiles_of_system(m.romfiles, m.roms, m.games, 7, "chd").select("id", "path")
)
query("j5_playlist_romfiles", "SELECT id FROM romfiles WHERE id IN (SELECT playlist_id FROM games)")(lambda m: j.playlist_romfiles(m.romfiles, m.games).select("id"))
query("j6_orphan_romfiles", "SELECT id, path FROM romfiles f WHERE NOT EXISTS (SELECT 1 FROM roms r WHERE r.romfile_id = f.id AND r.size >= 40 AND r.original) AND NOT EXISTS (SELECT 1 FROM games g WHERE g.playlist_id = f.id)")(
    lambda m: j.orphan_romfiles(m.romfiles, m.roms.where("size >= 40 and original"), m.games).select("id", "path")
)
query("j7_empty_systems", "SELECT id FROM systems s WHERE completion = 0 AND NOT EXISTS (SELECT 1 FROM games g WHERE g.system_id = s.id AND g.completion <> 0)")(lambda m: j.empty_systems(m.systems, m.games).select("id"))
query("j13_navigation", "SELECT r.id, g.name AS game, s.name AS system, f.path FROM roms r JOIN games g ON g.id = r.game_id JOIN systems s ON s.id = g.system_id LEFT JOIN romfiles f ON f.id = r.romfile_id")(
    lambda m: j.navigate(m.roms, m.games, m.systems, m.romfiles)
)
query("j14_roms_by_romfile", "SELECT romfile_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM roms WHERE romfile_id IS NOT NULL GROUP BY romfile_id")(
    lambda m: j.files_by_romfile(m.roms)
)
query("j15_vanished_games", "SELECT id FROM games WHERE name NOT IN (SELECT name FROM games WHERE id % 3 <> 0)")(lambda m: j.vanished_games(m.games, m.games.where("id % 3 <> 0")).select("id"))
query("j15_vanished_roms", "SELECT id FROM roms r WHERE parent_id IS NULL AND NOT EXISTS (SELECT 1 FROM roms t WHERE t.game_id = r.game_id AND t.name = r.name AND t.rom_status IS DISTINCT FROM 'baddump')")(
    lambda m: j.vanished_roms(m.roms, m.roms.where("coalesce(rom_status, '') <> 'baddump'")).select("id")
)
query(
    "j19_parent_rom",
    """+ kid AS (SELECT id, size, crc, game_id FROM roms WHERE parent_id IS NOT NULL AND crc IS NOT NULL),
    cand AS (SELECT k.id, 0 AS ordinal, g.parent_id AS game_id FROM kid k JOIN games g ON g.id = k.game_id WHERE g.parent_id IS NOT NULL UNION ALL SELECT id, 1, game_id FROM kid),
    hit AS (SELECT c.id, c.ordinal, min(r.id) AS parent FROM cand c JOIN kid k ON k.id = c.id JOIN roms r ON r.game_id = c.game_id AND r.size = k.size AND r.crc = k.crc AND r.parent_id IS NULL GROUP BY c.id, c.ordinal)
    SELECT id, arg_min(parent, ordinal) AS parent_rom_id FROM hit GROUP BY id""",
)(lambda m: _parent_rom(m))


def _parent_rom(m):
    kids = m.roms.where("parent_id is not null and crc is not null")
    of_parent = kids.select("id", "game_id").join(m.games.where("parent_id is not null").select(F.col("id").alias("game_id"), F.col("parent_id").alias("up")), "game_id").select("id", F.lit(0).alias("ordinal"), F.col("up").alias("game_id"))
    candidates = of_parent.unionByName(kids.select("id", F.lit(1).alias("ordinal"), "game_id"))
    return j.parent_rom(kids.select("id", "size", "crc"), candidates, m.roms)


query("t2_first_game_of_playlist", "SELECT playlist_id, min(name) AS name FROM games WHERE playlist_id IS NOT NULL GROUP BY playlist_id")(lambda m: m.games.where("playlist_id is not null").groupBy("playlist_id").agg(F.min("name").alias("name")))
query("t10_page", "SELECT id, name FROM games WHERE sorting <> 2 ORDER BY name, id LIMIT 20 OFFSET 40")(lambda m: c.page(c.games(m.games, wanted=True), 3, 20, "name", "id").select("id", "name"))
query("t10_pages", "SELECT greatest(ceil(count(*) / 20), 1)::BIGINT AS pages FROM games WHERE sorting <> 2")(lambda m: c.pages(c.games(m.games, wanted=True), 20))
query("t11_first_checksum", "SELECT id, coalesce(crc, md5, sha1) AS checksum FROM roms")(lambda m: m.roms.select("id", F.coalesce("crc", "md5", "sha1").alias("checksum")))
query("u1_roms_and_disks", "SELECT id, disk FROM roms WHERE NOT disk UNION ALL SELECT id, disk FROM roms WHERE disk")(lambda m: m.roms.where("not disk").select("id", "disk").unionByName(m.roms.where("disk").select("id", "disk")))
query("u2_romfiles_in_use", "SELECT romfile_id AS id FROM roms WHERE romfile_id IS NOT NULL UNION SELECT romfile_id FROM patches UNION SELECT playlist_id FROM games WHERE playlist_id IS NOT NULL")(
    lambda m: m.roms.select(F.col("romfile_id").alias("id")).unionByName(m.patches.select(F.col("romfile_id").alias("id"))).unionByName(m.games.select(F.col("playlist_id").alias("id"))).where("id is not null").distinct()
)
query("u3_unused_romfiles", "SELECT id FROM romfiles EXCEPT SELECT romfile_id FROM roms WHERE original")(lambda m: m.romfiles.join(m.roms.where("original").select(F.col("romfile_id").alias("id")), "id", "left_anti").select("id"))
query("u6_systems_by_names", "SELECT id, name FROM systems WHERE name ILIKE 'System 1%' OR name ILIKE 'System 12%'")(
    lambda m: c.systems(m.systems, name_like="System 1%").unionByName(c.systems(m.systems, name_like="System 12%")).dropDuplicates(["id"]).select("id", "name")
)
query("a16_distinct_paths", "SELECT DISTINCT path FROM (SELECT path FROM romfiles UNION ALL SELECT path FROM romfiles)")(lambda m: m.romfiles.unionByName(m.romfiles).dropDuplicates(["path"]).select("path"))
query("a18_one_value_per_key", "SELECT description, max(id) AS id FROM games GROUP BY description")(lambda m: m.games.groupBy("description").agg(F.max("id").alias("id")))
