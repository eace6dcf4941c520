"""Completion, counts and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.operators import completion as c
from stocktake.operators import joins as j
from stocktake.plans.registry import query


def _exists(missing: str, present: str) -> str:
    one = "EXISTS (SELECT 1 FROM roms r WHERE r.game_id = g.id AND r.romfile_id IS {} NULL AND ({}))"
    return f"CASE WHEN NOT {one.format('', missing)} THEN 2 WHEN NOT {one.format('NOT', present)} THEN 0 ELSE 1 END"


_TAKEN = "r.parent_id IS NULL OR r.parent_id IN (SELECT r2.id FROM roms r2 JOIN games g2 ON g2.id = r2.game_id WHERE NOT g2.bios)"
_JB = "r.parent_id IS NOT NULL AND NOT r.name ILIKE 'PS3_CONTENT/%' AND NOT r.name ILIKE 'PS3_EXTRA/%' AND NOT r.name ILIKE 'PS3_UPDATE/%'"
PLAIN, SPLIT, NON_MERGED, JB = (_exists(*x) for x in (("true", "true"), ("r.parent_id IS NULL", "r.parent_id IS NULL"), (_TAKEN, _TAKEN), (_JB, "true")))
SYSTEMS = """SELECT s.id, (CASE WHEN NOT EXISTS (SELECT 1 FROM gc g WHERE g.system_id = s.id AND g.completion <> 2 AND g.sorting <> 2) THEN 2
  WHEN NOT EXISTS (SELECT 1 FROM gc g WHERE g.system_id = s.id AND g.completion <> 0 AND g.sorting <> 2) THEN 0 ELSE 1 END)::INT AS completion FROM systems s"""

query("a1_table_counts", "SELECT (SELECT count(*) FROM systems) AS systems, (SELECT count(*) FROM games) AS games, (SELECT count(*) FROM roms) AS roms")(
    lambda m: m.spark.createDataFrame([(m.systems.count(), m.games.count(), m.roms.count())], "systems bigint, games bigint, roms bigint")
)
query(
    "a4_a5_original_sizes",
    """SELECT s.id, coalesce(sum(r.size), 0)::BIGINT AS total_original_size, coalesce(sum(r.size) FILTER (g.sorting = 1), 0)::BIGINT AS one_region_original_size
    FROM systems s LEFT JOIN games g ON g.system_id = s.id LEFT JOIN roms r ON r.game_id = g.id AND r.romfile_id IS NOT NULL GROUP BY s.id""",
)(lambda m: c.original_sizes(m.systems, m.games, m.roms))
query(
    "a6_actual_sizes",
    """+ used AS (SELECT DISTINCT g.system_id, r.romfile_id, 0 AS one FROM roms r JOIN games g ON g.id = r.game_id WHERE r.romfile_id IS NOT NULL
      UNION ALL SELECT DISTINCT g.system_id, r.romfile_id, 1 FROM roms r JOIN games g ON g.id = r.game_id WHERE r.romfile_id IS NOT NULL AND g.sorting = 1)
    SELECT s.id, coalesce(sum(f.size) FILTER (u.one = 0), 0)::BIGINT AS total_actual_size, coalesce(sum(f.size) FILTER (u.one = 1), 0)::BIGINT AS one_region_actual_size
    FROM systems s LEFT JOIN used u ON u.system_id = s.id LEFT JOIN romfiles f ON f.id = u.romfile_id GROUP BY s.id""",
)(lambda m: c.actual_sizes(m.systems, m.games, m.roms, m.romfiles))
query("a8_game_completion", f"SELECT g.id, ({PLAIN})::INT AS completion FROM games g")(lambda m: c.plain(m.games, m.roms).select("id", "completion"))
query("a9_game_completion_split", f"SELECT g.id, ({SPLIT})::INT AS completion FROM games g")(lambda m: c.split(m.games, m.roms).select("id", "completion"))
query("a10_game_completion_non_merged", f"SELECT g.id, ({NON_MERGED})::INT AS completion FROM games g")(lambda m: c.non_merged(m.games, m.roms).select("id", "completion"))
query("a11_game_completion_jbfolder", f"SELECT g.id, ({JB})::INT AS completion FROM games g")(lambda m: c.jbfolder(m.games, m.roms).select("id", "completion"))
query("a12_system_completion", f"+ gc AS (SELECT g.*  EXCLUDE (completion), {PLAIN} AS completion FROM games g) {SYSTEMS}")(lambda m: c.of_systems(m.systems, c.plain(m.games, m.roms)).select("id", "completion"))
_DISPATCH = f"CASE WHEN s.arcade THEN CASE s.merging WHEN 0 THEN {SPLIT} WHEN 1 THEN {NON_MERGED} WHEN 2 THEN {NON_MERGED} ELSE {PLAIN} END WHEN g.jbfolder THEN {JB} ELSE {PLAIN} END"
query("a13_completion_dispatch", f"SELECT g.id, ({_DISPATCH})::INT AS completion FROM games g JOIN systems s ON s.id = g.system_id")(lambda m: c.dispatched(m.systems, m.games, m.roms).select("id", "completion"))
query("a13_system_completion_dispatch", f"+ gc AS (SELECT g.* EXCLUDE (completion), {_DISPATCH} AS completion FROM games g JOIN systems s ON s.id = g.system_id) {SYSTEMS}")(
    lambda m: c.of_systems(m.systems, c.dispatched(m.systems, m.games, m.roms)).select("id", "completion")
)
query("a14_clones_by_parent", "SELECT parent_id, count(*) AS n, min(name) AS first_name FROM games WHERE parent_id IS NOT NULL GROUP BY parent_id")(
    lambda m: j.clones_by_parent(m.games)
)
query("a15_any_all", "SELECT system_id, bool_and(completion = 2) AS all_full, bool_or(completion = 2) AS any_full FROM games GROUP BY system_id")(
    lambda m: m.games.groupBy("system_id").agg(F.bool_and(F.col("completion") == 2).alias("all_full"), F.bool_or(F.col("completion") == 2).alias("any_full"))
)
query(
    "p20_ignored_roms",
    """SELECT r.id, CASE WHEN g.sorting = 2 THEN true WHEN NOT s.arcade OR r.parent_id IS NULL THEN false WHEN s.merging = 0 THEN true
      WHEN s.merging IN (1, 2) THEN r.parent_id IN (SELECT r2.id FROM roms r2 JOIN games g2 ON g2.id = r2.game_id WHERE g2.bios) ELSE false END AS ignored
    FROM roms r JOIN games g ON g.id = r.game_id JOIN systems s ON s.id = g.system_id""",
)(lambda m: c.ignored_roms(m.systems, m.games, m.roms))
