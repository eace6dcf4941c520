"""The collection model bound to the driver's tables, as DataFrames and as SQL.

Customers are collections, orders their entries, line items the expected items,
parts the stored files. Flags are set so that every outcome of an operator
occurs. ``SQL`` says the same as a chain of common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXTENSIONS = ("rom", "iso", "cue", "bin", "chd", "zip")


def _pick(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (key % len(EXTENSIONS) + 1).cast("int"))


class Model:
    """Lazily bound tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def systems(self) -> DataFrame:
        c, k = self.table("customer"), F.col("c_custkey")
        return c.select(
            k.alias("id"),
            F.concat(F.lit("System "), k, F.when(k % 4 == 0, " (Parent-Clone)").otherwise("")).alias("name"),
            F.when(k % 9 == 0, F.concat(F.lit("Unofficial - Custom "), k, F.lit(" (x)"))).alias("custom_name"),
            F.when(k % 11 == 0, "bin").alias("custom_extension"),
            F.col("c_mktsegment").alias("description"),
            (F.lit(20200000) + F.col("c_nationkey")).cast("string").alias("version"),
            F.when(k % 7 != 0, F.concat(F.lit("https://host/"), F.col("c_nationkey"))).alias("url"),
            (k % 3).cast("int").alias("completion"),
            (k % 5 == 0).alias("arcade"),
            (F.col("c_nationkey") % 5).cast("int").alias("merging"),
        )

    @cached_property
    def games(self) -> DataFrame:
        o, k = self.table("orders"), F.col("o_orderkey")
        first = F.min("o_orderkey").over(W.partitionBy("o_custkey"))
        number = F.substring("o_orderpriority", 1, 1).cast("int")
        region = F.element_at(F.array(*map(F.lit, ("USA", "Europe", "Japan", "USA, Europe", "World"))), number)
        code = F.element_at(F.array(*map(F.lit, ("US", "EU", "JP", "US-EU", "US-JP-EU"))), number)
        tail = F.when(k % 4 == 0, F.concat(F.lit(" (Rev "), k % 3, F.lit(")"))).when(k % 4 == 1, " (Beta)").when(k % 4 == 2, " (En,Fr)").otherwise("")
        disc = F.when(k % 6 == 0, F.concat(F.lit(" (Disc "), k % 3 + 1, F.lit(")"))).otherwise("")
        return o.select(
            k.alias("id"),
            F.concat(F.lit("Game "), k, F.lit(" ("), region, F.lit(")"), tail, disc).alias("name"),
            F.col("o_orderpriority").alias("description"),
            F.when(k % 10 == 0, "bootleg").alias("comment"),
            (k % 17 == 0).alias("device"),
            (k % 13 == 0).alias("bios"),
            (k % 7 == 0).alias("jbfolder"),
            code.alias("regions"),
            F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("sorting"),
            (k % 3).cast("int").alias("completion"),
            F.col("o_custkey").alias("system_id"),
            F.when((k != first) & (k % 3 != 0), first).alias("parent_id"),
            F.when(k % 19 == 0, 1 + k % 500).alias("playlist_id"),
        )

    @cached_property
    def roms(self) -> DataFrame:
        li, p, s = self.table("lineitem"), F.col("l_partkey"), F.col("l_suppkey")
        order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
        ordinal = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
        returned = F.col("l_returnflag") == "R"
        return li.select(
            (F.col("l_orderkey") * 100 + ordinal).alias("id"),
            F.concat(F.when(s % 8 == 0, "PS3_EXTRA/").otherwise(""), F.lit("item-"), p, F.lit("."), _pick(p)).alias("name"),
            (returned & (s % 3 == 0)).alias("bios"),
            (p % 17 == 0).alias("disk"),
            F.col("l_quantity").cast("bigint").alias("size"),
            F.when(p % 5 != 0, F.substring(F.md5(F.concat(F.lit("c"), p)), 1, 8)).alias("crc"),
            F.when(p % 7 != 0, F.md5(F.concat(F.lit("m"), p))).alias("md5"),
            F.when(p % 11 != 0, F.sha1(F.concat(F.lit("s"), p))).alias("sha1"),
            F.when(s % 10 == 0, "nodump").when(s % 10 == 1, "baddump").alias("rom_status"),
            F.col("l_orderkey").alias("game_id"),
            F.when(F.col("l_linestatus") == "F", p).alias("romfile_id"),
            F.when(returned, (1 + p % 1000) * 100 + 1).alias("parent_id"),
            (F.col("l_linenumber") % 2 == 1).alias("original"),
        )

    @cached_property
    def romfiles(self) -> DataFrame:
        k = F.col("p_partkey")
        folder = F.when(k % 31 == 0, "Trash/").otherwise(F.concat(F.col("p_brand"), F.when(k % 13 == 0, "/Trash/").otherwise("/")))
        return self.table("part").select(
            k.alias("id"),
            F.concat(folder, F.lit("file-"), k, F.lit("."), _pick(k)).alias("path"),
            F.col("p_size").cast("bigint").alias("size"),
            F.when(k % 29 == 0, k - 1).alias("parent_id"),
            (k % 3).cast("int").alias("romfile_type"),
        )

    @cached_property
    def patches(self) -> DataFrame:
        first = self.roms.where("id % 100 = 1 and game_id % 5 = 0 and romfile_id is not null")
        return first.select("id", F.concat(F.lit("patch-"), "game_id").alias("name"), (F.col("game_id") % 2).cast("int").alias("index"), F.col("id").alias("rom_id"), "romfile_id")

    @cached_property
    def headers(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("v"), F.col("s_nationkey")).alias("version"), (k % 4 * 4).alias("size"), k.alias("system_id"))

    @cached_property
    def rules(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            k.cast("bigint").alias("id"), (k % 2).cast("bigint").alias("start_byte"), F.lower(F.hex(F.substring("n_name", 1, 1))).alias("hex_value"), (F.col("n_regionkey") + 1).cast("bigint").alias("header_id")
        )

    @cached_property
    def files(self) -> DataFrame:
        """Blobs on disk: path and content."""
        return self.table("documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("bigint").alias("length"))


_EXT = "['rom','iso','cue','bin','chd','zip']"
SQL = f"""
systems AS (SELECT c_custkey AS id, 'System ' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN ' (Parent-Clone)' ELSE '' END AS name,
  CASE WHEN c_custkey % 9 = 0 THEN 'Unofficial - Custom ' || c_custkey || ' (x)' END AS custom_name, CASE WHEN c_custkey % 11 = 0 THEN 'bin' END AS custom_extension,
  c_mktsegment AS description, (20200000 + c_nationkey)::VARCHAR AS version, CASE WHEN c_custkey % 7 <> 0 THEN 'https://host/' || c_nationkey END AS url,
  (c_custkey % 3)::INT AS completion, c_custkey % 5 = 0 AS arcade, (c_nationkey % 5)::INT AS merging FROM customer),
games AS (SELECT o_orderkey AS id,
  'Game ' || o_orderkey || ' (' || ['USA','Europe','Japan','USA, Europe','World'][substr(o_orderpriority, 1, 1)::INT] || ')'
   || CASE o_orderkey % 4 WHEN 0 THEN ' (Rev ' || (o_orderkey % 3) || ')' WHEN 1 THEN ' (Beta)' WHEN 2 THEN ' (En,Fr)' ELSE '' END
   || CASE WHEN o_orderkey % 6 = 0 THEN ' (Disc ' || (o_orderkey % 3 + 1) || ')' ELSE '' END AS name,
  o_orderpriority AS description, CASE WHEN o_orderkey % 10 = 0 THEN 'bootleg' END AS comment, o_orderkey % 17 = 0 AS device, o_orderkey % 13 = 0 AS bios, o_orderkey % 7 = 0 AS jbfolder,
  ['US','EU','JP','US-EU','US-JP-EU'][substr(o_orderpriority, 1, 1)::INT] AS regions, CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END AS sorting, (o_orderkey % 3)::INT AS completion,
  o_custkey AS system_id, CASE WHEN o_orderkey <> min(o_orderkey) OVER (PARTITION BY o_custkey) AND o_orderkey % 3 <> 0 THEN min(o_orderkey) OVER (PARTITION BY o_custkey) END AS parent_id,
  CASE WHEN o_orderkey % 19 = 0 THEN 1 + o_orderkey % 500 END AS playlist_id FROM orders),
roms AS (SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS id,
  CASE WHEN l_suppkey % 8 = 0 THEN 'PS3_EXTRA/' ELSE '' END || 'item-' || l_partkey || '.' || {_EXT}[l_partkey % 6 + 1] AS name,
  l_returnflag = 'R' AND l_suppkey % 3 = 0 AS bios, l_partkey % 17 = 0 AS disk, l_quantity::BIGINT AS size,
  CASE WHEN l_partkey % 5 <> 0 THEN substr(md5('c' || l_partkey), 1, 8) END AS crc, CASE WHEN l_partkey % 7 <> 0 THEN md5('m' || l_partkey) END AS md5, CASE WHEN l_partkey % 11 <> 0 THEN sha1('s' || l_partkey) END AS sha1,
  CASE l_suppkey % 10 WHEN 0 THEN 'nodump' WHEN 1 THEN 'baddump' END AS rom_status, l_orderkey AS game_id, CASE WHEN l_linestatus = 'F' THEN l_partkey END AS romfile_id,
  CASE WHEN l_returnflag = 'R' THEN (1 + l_partkey % 1000) * 100 + 1 END AS parent_id, l_linenumber % 2 = 1 AS original FROM lineitem),
romfiles AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 31 = 0 THEN 'Trash/' ELSE p_brand || CASE WHEN p_partkey % 13 = 0 THEN '/Trash/' ELSE '/' END END || 'file-' || p_partkey || '.' || {_EXT}[p_partkey % 6 + 1] AS path,
  p_size::BIGINT AS size, CASE WHEN p_partkey % 29 = 0 THEN p_partkey - 1 END AS parent_id, (p_partkey % 3)::INT AS romfile_type FROM part),
patches AS (SELECT id, 'patch-' || game_id AS name, (game_id % 2)::INT AS index, id AS rom_id, romfile_id FROM roms WHERE id % 100 = 1 AND game_id % 5 = 0 AND romfile_id IS NOT NULL),
headers AS (SELECT s_suppkey AS id, s_name AS name, 'v' || s_nationkey AS version, s_suppkey % 4 * 4 AS size, s_suppkey AS system_id FROM supplier),
rules AS (SELECT n_nationkey::BIGINT AS id, (n_nationkey % 2)::BIGINT AS start_byte, lower(hex(substr(n_name, 1, 1))) AS hex_value, (n_regionkey + 1)::BIGINT AS header_id FROM nation),
files AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, text, strlen(text)::BIGINT AS length FROM documents)
"""
