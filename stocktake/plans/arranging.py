"""Names, election and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.functions import names
from stocktake.operators import election as e
from stocktake.operators import layout as y
from stocktake.plans.registry import query

_G = r"regexp_extract_all(name, '\(([^()]*)\)', 1)"
query(
    "x9_name_information",
    rf"""SELECT id, 'Game ' || id AS title, array_to_string(list_filter({_G}, lambda g: regexp_full_match(g, '[A-Z][a-z](,[A-Z][a-z])*')), ',') AS languages,
      nullif(regexp_extract(name, '\(Rev ([0-9]+)\)', 1), '') AS version, nullif(regexp_extract(name, '\((Beta)\)', 1), '') AS release FROM games""",
)(
    lambda m: m.games.select(
        "id", names.title(F.col("name")).alias("title"), F.array_join(names.languages(F.col("name")), ",").alias("languages"), names.version(F.col("name")).alias("version"), F.get(names.releases(F.col("name")), 0).alias("release")
    )
)
query("x10_regions_of_codes", "SELECT id, regions FROM games")(
    lambda m: m.games.select("id", names.regions_of(F.concat(F.lit("Title "), "id", F.lit(" (demo) (19"), F.when(F.col("bios"), "xx").otherwise("85-01"), F.lit(")(Maker)(Machine)("), "regions", F.lit(")(en)[a2]"))).alias("regions"))
)
query("x10_region_codes", "SELECT id, regions FROM games")(lambda m: m.games.select("id", names.region_codes(F.col("name")).alias("regions")))
query(
    "x11_ignored_games",
    """SELECT g.id, CASE WHEN s.arcade THEN coalesce(g.comment, '') LIKE '%bootleg%' ELSE g.name LIKE '%(Beta)%' OR g.name LIKE '%(En,Fr)%' AND false END AS ignored
    FROM games g JOIN systems s ON s.id = g.system_id""",
)(
    lambda m: m.games.join(m.systems.select(F.col("id").alias("system_id"), "arcade"), "system_id").select(
        "id", names.ignored(F.col("name"), F.col("comment"), F.col("arcade"), ["En"], ["Beta", "bootleg"], []).alias("ignored")
    )
)
query(
    "t4_ranked_families",
    """SELECT id, (row_number() OVER (PARTITION BY coalesce(parent_id, id) ORDER BY len(string_split(regions, '-')) DESC, parent_id IS NULL, name) - 1)::INT AS place FROM games""",
)(lambda m: e.ranked(m.games, e.Preferences(regions="broad")).select("id", "place"))
_FAMILY = """fam AS (SELECT *, coalesce(parent_id, id) AS family, string_split(regions, '-') AS rs FROM games),
 rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY len(rs) DESC, parent_id IS NULL, name) AS place, max(completion = 2) OVER (PARTITION BY family) AS someone FROM fam),
 el AS (SELECT *, CASE WHEN completion = 2 OR NOT someone THEN CASE WHEN list_contains(rs, 'US') THEN 0 WHEN list_contains(rs, 'JP') THEN 1 END END AS region FROM rk),
 wn AS (SELECT family, arg_min(id, region * 1000000 + place) AS winner FROM el WHERE region IS NOT NULL GROUP BY family)"""
query("t5_elected", f"+ {_FAMILY} SELECT winner AS id FROM wn")(lambda m: e.sorted_games(m.games, e.Preferences(regions="broad", one_regions=("US", "JP"))).where("sorting = 1").select("id"))
query(
    "p5_sorting",
    f"+ {_FAMILY} SELECT el.id, CASE WHEN wn.winner = el.id THEN 1 WHEN list_contains(rs, 'EU') THEN 0 ELSE 2 END::INT AS sorting FROM el LEFT JOIN wn USING (family)",
)(lambda m: e.sorted_games(m.games, e.Preferences(regions="broad", one_regions=("US", "JP"), all_regions=("EU",))).select("id", "sorting"))
query("p5_sorting_by_regions", "SELECT id, CASE WHEN name LIKE '%(Beta)%' THEN 2 WHEN list_has_any(string_split(regions, '-'), ['EU', 'JP']) THEN 0 ELSE 2 END::INT AS sorting FROM games")(
    lambda m: e.sorted_games(m.games, e.Preferences(all_regions=("EU", "JP"), ignored_releases=("Beta",))).select("id", "sorting")
)
query("k3_changed_sorting", "SELECT id, sorting AS before, CASE WHEN list_has_any(string_split(regions, '-'), ['EU', 'JP']) THEN 0 ELSE 2 END::INT AS after FROM games WHERE sorting <> CASE WHEN list_has_any(string_split(regions, '-'), ['EU', 'JP']) THEN 0 ELSE 2 END")(
    lambda m: e.changed_sorting(m.games, e.sorted_games(m.games, e.Preferences(all_regions=("EU", "JP"))))
)
query("p6_wanted", "SELECT r.id, g.name AS game, r.name AS rom, r.size, coalesce(r.crc, r.md5, r.sha1) AS checksum FROM roms r JOIN games g ON g.id = r.game_id WHERE g.sorting <> 2 AND g.completion <> 2 AND r.romfile_id IS NULL AND r.parent_id IS NULL")(
    lambda m: e.wanted(m.games, m.roms)
)
query("x4_system_directory", r"SELECT id, coalesce(custom_name, trim(name)) AS plain, trim(regexp_extract(coalesce(custom_name, name), '^(Non-Redump - |Unofficial - )?([^()]+)( \(.*\))?$', 2)) AS grouped FROM systems")(
    lambda m: m.systems.select("id", y.system_directory(F.col("name"), F.col("custom_name")).alias("plain"), y.system_directory(F.col("name"), F.col("custom_name"), True).alias("grouped"))
)
query("x6_alpha_folder", "SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, '^[A-Za-z]') THEN upper(substr(p_name, 1, 1)) ELSE '#' END AS folder FROM part")(
    lambda m: m.table("part").select(F.col("p_partkey").alias("id"), y.alpha_folder(F.col("p_name")).alias("folder"))
)
_PLACED = r"""pl AS (SELECT r.id AS rom_id, r.romfile_id, f.path AS src,
  trim(regexp_extract(coalesce(s.custom_name, s.name), '^(Non-Redump - |Unofficial - )?([^()]+)( \(.*\))?$', 2)) || CASE g.sorting WHEN 1 THEN '/1G1R' WHEN 2 THEN '/Trash' ELSE '' END
  || CASE WHEN g.sorting = 1 THEN '/G' ELSE '' END || CASE WHEN s.arcade AND NOT f.path LIKE '%.zip' OR g.jbfolder THEN '/' || g.name ELSE '' END || '/'
  || CASE WHEN f.path LIKE '%.chd' OR f.path LIKE '%.zip' THEN CASE WHEN s.arcade AND NOT f.path LIKE '%.zip' THEN r.name ELSE g.name END || '.' || regexp_extract(f.path, '\.([^./]*)$', 1)
      WHEN s.custom_extension IS NOT NULL THEN g.name || '.' || s.custom_extension ELSE r.name END AS dst
  FROM roms r JOIN romfiles f ON f.id = r.romfile_id JOIN games g ON g.id = r.game_id JOIN systems s ON s.id = g.system_id)"""
query("x7_sorted_paths", f"+ {_PLACED} SELECT * FROM pl")(lambda m: y.placed_roms(m.systems, m.games, m.roms, m.romfiles, group=True, one_alpha=True))
query("t6_move_plan", f"+ {_PLACED} SELECT rom_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY rom_id, romfile_id) AS k FROM pl WHERE src <> dst) WHERE k = 1")(
    lambda m: y.move_plan(y.placed_roms(m.systems, m.games, m.roms, m.romfiles, group=True, one_alpha=True)).select("rom_id", "src", "dst")
)
query(
    "x7_patch_moves",
    f"+ {_PLACED} SELECT p.rom_id, p.romfile_id, f.path AS src, regexp_replace(pl.dst, '\\.[^./]*$', '') || '.' || regexp_extract(f.path, '\\.([^./]*)$', 1) AS dst FROM patches p JOIN romfiles f ON f.id = p.romfile_id JOIN pl ON pl.rom_id = p.rom_id",
)(lambda m: y.patch_moves(y.placed_roms(m.systems, m.games, m.roms, m.romfiles, group=True, one_alpha=True), m.patches, m.romfiles))
query("x8_playlist_paths", r"SELECT g.id, coalesce(s.custom_name, trim(s.name)) || CASE g.sorting WHEN 1 THEN '/1G1R' WHEN 2 THEN '/Trash' ELSE '' END || '/' || regexp_replace(g.name, ' \(Disc \d+\).*', '') || '.m3u' AS path FROM games g JOIN systems s ON s.id = g.system_id WHERE regexp_matches(g.name, ' \(Disc \d+\).*')")(
    lambda m: m.games.where(F.col("name").rlike(r" \(Disc \d+\).*")).select("id", F.col("name").alias("game"), "sorting", "system_id")
    .join(m.systems.select(F.col("id").alias("system_id"), y.system_directory(F.col("name"), F.col("custom_name")).alias("dir")), "system_id")
    .select("id", y.playlist_path(F.col("dir"), F.col("game"), F.col("sorting")).alias("path"))
)
query("x18_system_key", "SELECT id, replace(name, ' (Parent-Clone)', '') AS key FROM systems")(lambda m: m.systems.select("id", F.replace("name", F.lit(" (Parent-Clone)"), F.lit("")).alias("key")))
