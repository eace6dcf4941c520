"""Content matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.functions.similarity import jaro_winkler_udf
from stocktake.operators import match as x
from stocktake.plans.registry import query

# Files are documents, expected items are other documents of equal text.
_FILES = "docfiles AS (SELECT doc_id AS file, strlen(text)::BIGINT AS size, md5(text) AS digest FROM documents WHERE doc_id % 3 <> 0)"
_ITEMS = "items AS (SELECT doc_id AS rom, strlen(text)::BIGINT AS size, md5(text) AS digest FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0)"


def _hashed(m, where: str, name: str):
    return m.table("documents").where(where).select(F.col("doc_id").alias(name), F.octet_length("text").cast("bigint").alias("size"), F.md5("text").alias("digest"))


query(
    "m1_assignment",
    f"""+ {_FILES}, {_ITEMS},
    f AS (SELECT *, row_number() OVER (PARTITION BY size, digest ORDER BY file) AS k FROM docfiles), i AS (SELECT *, row_number() OVER (PARTITION BY size, digest ORDER BY rom) AS k FROM items)
    SELECT f.file, i.rom, CASE WHEN i.rom IS NOT NULL THEN 'valid' WHEN EXISTS (SELECT 1 FROM items t WHERE t.size = f.size AND t.digest = f.digest) THEN 'duplicate' ELSE 'invalid' END AS state
    FROM f LEFT JOIN i ON i.size = f.size AND i.digest = f.digest AND i.k = f.k""",
)(lambda m: x.assigned(_hashed(m, "doc_id % 3 <> 0", "file"), _hashed(m, "doc_id % 3 = 0 or doc_id % 7 = 0", "rom")))

for _algorithm in ("crc", "md5", "sha1"):
    query(
        f"j8_missing_by_{_algorithm}",
        f"SELECT r.id, g.system_id, r.size, r.{_algorithm} AS digest FROM roms r JOIN games g ON g.id = r.game_id WHERE r.romfile_id IS NULL AND r.parent_id IS NULL AND r.{_algorithm} IS NOT NULL",
    )(lambda m, a=_algorithm: x.hash_rows(m.roms, a).where("open").join(m.games.select(F.col("id").alias("game_id"), "system_id"), "game_id").select("id", "system_id", "size", "digest"))
    query(f"a2_present_counts_{_algorithm}", f"SELECT size, {_algorithm} AS digest, count(*) AS n FROM roms WHERE romfile_id IS NOT NULL AND {_algorithm} IS NOT NULL GROUP BY ALL")(lambda m, a=_algorithm: x.present_counts(m.roms, a))


def _as_files(m):
    roms = x.by_system(m.roms, m.games)
    return roms.select(F.col("id").alias("file"), "size", "crc", "md5", "sha1", F.col("name").alias("rom_name"), F.array("game").alias("game_names")), roms


def _finder(algorithm: str, names: str | None, one: bool):
    def run(m):
        files, roms = _as_files(m)
        return x.missing_items(files, roms, algorithm, names, m.systems.where("arcade").select(F.col("id").alias("system_id")) if one else None)

    return run


# All missing-item lookups: by checksum, by names, over all collections or some.
for _algorithm in ("crc", "md5", "sha1"):
    for _names, _where in ((None, ""), ("game", " AND g.name = h.name"), ("item", " AND g.name = h.name AND r.name = f.name")):
        for _one in (False, True):
            query(
                f"j8_find_{_algorithm}_{_names or 'content'}_{'arcade' if _one else 'all'}",
                f"""SELECT f.id AS file, r.id AS rom FROM roms f JOIN games h ON h.id = f.game_id JOIN roms r ON r.size = f.size AND r.{_algorithm} = f.{_algorithm} JOIN games g ON g.id = r.game_id
                WHERE r.romfile_id IS NULL AND r.parent_id IS NULL{_where}{" AND g.system_id IN (SELECT id FROM systems WHERE arcade)" if _one else ""}""",
            )(_finder(_algorithm, _names, _one))
    query(
        f"j9_find_present_{_algorithm}",
        f"SELECT f.id AS file, count(*) AS n FROM roms f JOIN roms r ON r.size = f.size AND r.{_algorithm} = f.{_algorithm} JOIN games g ON g.id = r.game_id WHERE r.romfile_id IS NOT NULL AND g.system_id IN (SELECT id FROM systems WHERE arcade) GROUP BY f.id",
    )(lambda m, a=_algorithm: x.present_items(*_as_files(m), a, m.systems.where("arcade").select(F.col("id").alias("system_id"))))

query("j9_present_by_md5", "SELECT r.id, g.system_id, r.size, r.md5 AS digest FROM roms r JOIN games g ON g.id = r.game_id WHERE r.romfile_id IS NOT NULL AND r.md5 IS NOT NULL")(
    lambda m: x.hash_rows(m.roms, "md5").where("present").join(m.games.select(F.col("id").alias("game_id"), "system_id"), "game_id").select("id", "system_id", "size", "digest")
)


def _tiers(m):
    stored = m.roms.where("romfile_id is not null and md5 is not null").join(m.games.select(F.col("id").alias("game_id"), F.col("name").alias("game")), "game_id")
    files = stored.select(F.col("id").alias("file"), "size", F.lit("md5").alias("algorithm"), F.col("md5").alias("digest"), F.col("name").alias("rom_name"), F.array("game").alias("game_names"))
    items = x.hash_rows(m.roms, "md5").join(m.games.select(F.col("id").alias("game_id"), F.col("name").alias("game")), "game_id")
    return x.candidates(files, items).select("file", "rom", "tier")


query(
    "m1_tiers",
    """+ fl AS (SELECT r.id AS file, r.size, r.md5, r.name, g.name AS game FROM roms r JOIN games g ON g.id = r.game_id WHERE r.romfile_id IS NOT NULL AND r.md5 IS NOT NULL),
    op AS (SELECT r.id AS rom, r.size, r.md5, r.name, g.name AS game FROM roms r JOIN games g ON g.id = r.game_id WHERE r.romfile_id IS NULL AND r.parent_id IS NULL AND r.md5 IS NOT NULL),
    mt AS (SELECT file, rom, CASE WHEN f.game = o.game AND f.name = o.name THEN 1 WHEN f.game = o.game THEN 2 ELSE 3 END AS tier FROM fl f JOIN op o ON f.size = o.size AND f.md5 = o.md5)
    SELECT file, rom, tier FROM mt WHERE (file, tier) IN (SELECT file, min(tier) FROM mt GROUP BY file)""",
)(_tiers)


def _closest(m):
    found = m.table("part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("wanted"), F.col("p_brand"))
    items = m.table("part").select(F.col("p_partkey").alias("rom"), F.col("p_name").alias("name"), "p_brand")
    return x.closest(found.join(items, "p_brand").where("file <> rom")).select("file", "rom", F.round("likeness", 6).alias("likeness"))


query(
    "j21_closest_name",
    """+ c AS (SELECT a.p_partkey AS file, b.p_partkey AS rom, jaro_winkler_similarity(a.p_name, b.p_name) AS s FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey)
    SELECT file, rom, round(s, 6) AS likeness FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(s, 12) DESC, rom) AS k FROM c) WHERE k = 1""",
)(_closest)
query("j21_fuzzy_rank", "SELECT p_partkey AS id, round(jaro_winkler_similarity(p_name, p_type), 9) AS likeness FROM part")(lambda m: m.table("part").select(F.col("p_partkey").alias("id"), F.round(jaro_winkler_udf("p_name", "p_type"), 9).alias("likeness")))
query("j10_folder_anchors", "SELECT r.id, g.system_id FROM roms r JOIN games g ON g.id = r.game_id WHERE r.name = 'item-2.cue' AND r.size = 10 AND r.md5 = md5('m2') AND r.parent_id IS NOT NULL AND r.romfile_id IS NULL")(
    lambda m: x.anchors(m.roms, m.games, "item-2.cue", 10, "".join(__import__("hashlib").md5(b"m2").hexdigest())).select("id", "system_id")
)
query("j11_children_of_parents", "SELECT parent_id, size, md5, min(id) AS id, count(*) AS n FROM roms WHERE romfile_id IS NULL AND parent_id IN (SELECT id FROM roms WHERE romfile_id IS NOT NULL) GROUP BY parent_id, size, md5")(
    lambda m: x.children(m.roms, m.roms.where("romfile_id is not null").select("id"))
)
query("a3_present_children", "SELECT parent_id, count(*) AS n FROM roms WHERE parent_id IS NOT NULL AND romfile_id IS NOT NULL GROUP BY parent_id")(lambda m: m.roms.where("parent_id is not null and romfile_id is not null").groupBy("parent_id").agg(F.count("*").alias("n")))


def _cover(m):
    items = m.roms.where("parent_id is null and md5 is not null").select("id", "game_id", "size", F.col("md5").alias("digest"))
    members = m.roms.where("parent_id is null and md5 is not null and coalesce(rom_status, '') <> 'nodump'").select(F.col("game_id").alias("archive"), F.col("id").alias("member"), "size", F.col("md5").alias("digest"))
    return x.set_cover(members, items)


query(
    "a20_set_cover",
    """+ it AS (SELECT id, game_id, size, md5, rom_status FROM roms WHERE parent_id IS NULL AND md5 IS NOT NULL), mb AS (SELECT game_id AS archive, id AS member, size, md5 FROM it WHERE coalesce(rom_status, '') <> 'nodump'),
    mt AS (SELECT m.archive, i.game_id, count(DISTINCT i.id) AS items, count(DISTINCT m.member) AS matched FROM mb m JOIN it i ON i.size = m.size AND i.md5 = m.md5 GROUP BY 1, 2)
    SELECT archive, game_id, (SELECT count(*) FROM mb WHERE mb.archive = mt.archive) AS members FROM mt WHERE items = (SELECT count(*) FROM it WHERE it.game_id = mt.game_id)
     AND matched = (SELECT count(*) FROM mb WHERE mb.archive = mt.archive) AND (SELECT count(*) FROM mt t WHERE t.archive = mt.archive) = 1""",
)(_cover)
