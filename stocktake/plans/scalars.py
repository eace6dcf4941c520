"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.functions import hashing as h
from stocktake.functions import paths as p
from stocktake.operators import plan
from stocktake.plans.registry import query

query("x1_checksums", "SELECT doc_id, strlen(text)::BIGINT AS size, md5(text) AS md5, sha1(text) AS sha1 FROM documents")(lambda m: m.files.select("doc_id", h.checksums(F.col("content")).alias("c")).select("doc_id", "c.size", "c.md5", "c.sha1"))


def _headered(m):
    rules = F.array(F.struct(F.lit(0).cast("bigint").alias("start_byte"), F.lit("54").alias("hex_value")), F.struct(F.lit(1).cast("bigint").alias("start_byte"), F.lit("68").alias("hex_value")))
    return m.files.select("doc_id", h.rules_hold(F.col("content"), rules).alias("headed"), F.md5(h.behind_header(F.col("content"), F.lit(4), rules)).alias("md5"))


query("f28_x2_headered_hash", "SELECT doc_id, text LIKE 'Th%' AS headed, md5(CASE WHEN text LIKE 'Th%' THEN decode(encode(text)[5:]) ELSE text END) AS md5 FROM documents")(_headered)
query("s7_sniffed_extension", "SELECT doc_id, CASE WHEN text LIKE 'RIFF%' THEN 'riff' WHEN text LIKE 'PATCH%' THEN 'ips' ELSE 'txt' END AS extension FROM documents")(lambda m: m.files.select("doc_id", h.sniffed(F.col("content"), F.col("path")).alias("extension")))
query("s8_extension_class", "SELECT id, CASE WHEN path LIKE '%.zip' THEN 'archive' WHEN path LIKE '%.chd' THEN 'chd' WHEN path LIKE '%.cue' THEN 'cue' WHEN path LIKE '%.iso' THEN 'iso' ELSE 'other' END AS class FROM romfiles")(
    lambda m: m.romfiles.select("id", plan.extension_class(p.extension(F.col("path"))).alias("class"))
)
query("x3_known_hash", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'abc' ELSE sha1(text) END AS sha1 FROM documents")(lambda m: m.files.select("doc_id", h.known_hash(F.when(F.col("doc_id") % 2 == 0, "ABC"), F.col("content"), "sha1").alias("sha1")))
query(
    "x14_path_parts",
    r"""SELECT id, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '\.([^./]*)$', 1) AS extension, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM romfiles""",
)(lambda m: m.romfiles.select("id", *[f(F.col("path")).alias(n) for n, f in (("base", p.basename), ("parent", p.parent), ("extension", p.extension), ("stem", p.stem))]))
query("x15_trashed_name", r"SELECT id, regexp_extract(path, '([^/]*)\.[^.]*$', 1) || ' [md5:' || md5(path) || '].' || regexp_extract(path, '\.([^./]*)$', 1) AS name FROM romfiles")(
    lambda m: m.romfiles.select("id", p.trashed_name(F.col("path"), F.lit("md5"), F.md5("path")).alias("name"))
)
query("x16_frames", "SELECT event_id, (event_id % 75) + 75 * (event_id % 60) + 4500 * (event_id % 80) AS frames FROM events")(lambda m: m.table("events").select("event_id", p.frames(F.col("event_id") % 80, F.col("event_id") % 60, F.col("event_id") % 75).alias("frames")))
query("x13_newer_version", "SELECT id, '20200012' > version AS newer FROM systems")(lambda m: m.systems.select("id", p.newer(F.col("version"), F.lit("20200012")).alias("newer")))
query("x17_original_extension", r"SELECT id, regexp_extract(path, '\.([^./]*)$', 1) NOT IN ('7z', 'zip', 'chd', 'cso', 'nsz', 'rvz', 'zso') AS original FROM romfiles")(lambda m: m.romfiles.select("id", p.is_original(F.col("path")).alias("original")))
query("x21_event_payload", "SELECT id, '{\"system\":\"' || name || '\",\"id\":' || id || '}' AS payload FROM systems")(lambda m: m.systems.select("id", F.to_json(F.struct(F.col("name").alias("system"), "id")).alias("payload")))
query("x22_local_datetime", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events")(lambda m: m.table("events").select("event_id", F.date_format("ts", "yyyyMMdd-HHmmss").alias("stamp")))
query("t3_import_priority", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'click' THEN 0 WHEN value < 50 THEN 1 ELSE 2 END, event_id) AS place FROM events")(lambda m: _priority(m))
query("t9_first_extension", "SELECT parent_id, min(list_position(['chd', 'cso', 'cue', 'iso', 'rvz'], regexp_extract(path, '\\.([^./]*)$', 1)))::INT AS rank FROM romfiles WHERE parent_id IS NOT NULL GROUP BY parent_id")(lambda m: _first_extension(m))


def _priority(m):
    from pyspark.sql import Window as W

    rank = F.when(F.col("event_type") == "click", 0).when(F.col("value") < 50, 1).otherwise(2)
    return m.table("events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy(rank, "event_id")).cast("bigint").alias("place"))


def _first_extension(m):
    rank = F.array_position(F.array(*map(F.lit, ("chd", "cso", "cue", "iso", "rvz"))), p.extension(F.col("path")))
    return m.romfiles.where("parent_id is not null").groupBy("parent_id").agg(F.min(F.when(rank > 0, rank)).cast("int").alias("rank"))


def _gdi(m):
    track = F.struct(
        F.col("turn").alias("number"), (F.col("role") == "user").alias("audio"), F.concat(F.lit("t"), F.col("turn")).alias("stem"), F.length("text").cast("bigint").alias("sectors"), F.lit(150).cast("bigint").alias("gap"),
        F.when(F.col("turn") % 3 == 0, 2).otherwise(1).alias("indices"), (F.col("turn") == 1).alias("dense"),
    )
    grouped = m.table("conversations").where("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(track)).alias("tracks"))
    return grouped.select("conv_id", F.posexplode(plan.gdi_lines(F.col("tracks"))).alias("pos", "line"))


query("w1_k7_gdi_lines")(_gdi)
