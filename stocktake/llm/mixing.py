"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, the source's
target over its size. The expected copies are summed up along a fixed order and
shifted by one random offset per source; a document is taken once for each
integer that its stretch of the running sum crosses. The order puts documents of
like size together, so each size is taken in proportion and the words taken come
near the target.

The running sum has three levels, so that no task holds a source: size classes
within the source, blocks of bounded rows within a class, rows within a block.
Block borders follow a hash of the id, which spreads a source of any size and a
size that very many documents share.

Defined results: null text has size 0 and nothing taken; null is a source of its
own, last in order; a null id is ordered by its text; rows that agree in id and
text are interchangeable; very long texts are read whole; an empty table gives no
rows; reruns agree, whatever the partitioning. Only the named columns are read,
so that further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stocktake.llm.common import free_name, materialise, row_mark, table, without_repeats, words_of

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
SEED = "mix-1"
#: Rows of a block: at least the first, and so many that there are about the second number of blocks.
BLOCK_ROWS, BLOCKS = 200, 100_000
_HEX32 = 16**8


def size_class(size: Column) -> Column:
    """A class of like sizes, rising with the size: eight to each power of two."""
    shift = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return (shift * 16 + F.call_function("shiftright", size, shift)).cast("int")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size) -> with target, one row per source.

    Every target is the lesser of ``cap`` times the source and its weight times
    a common level. The level is found in one pass over the sources in order of
    the level at which each meets its cap; there is one row per source here.
    """
    ranked = sources.withColumn("_k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_k") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_at", F.col("_cap") / F.col("_w"))
    before = W.orderBy("_at", "_k").rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy("_at", "_k").rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy(F.lit(1))
    total = F.sum("source_size").over(every) * F.lit(share)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    ranked = ranked.withColumn("_level", level)
    found = F.min(F.when(F.col("_at") >= F.col("_level"), F.struct("_at", "_k", "_level"))).over(every)["_level"]
    return ranked.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(found * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken, key (of id, source and text)."""
    sized = docs.select("doc_id", "source", row_mark(docs, "doc_id", "source", "text")["key"].alias("key"), F.size(words_of(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("text").alias("_text"))
    sized = sized.withColumn("_class", size_class(F.col("size"))).withColumn("_hash", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.col("_text").cast("string")))))
    sized = materialise(sized, "sizes")
    classes = materialise(sized.groupBy("source", "_class").agg(F.count("*").alias("_n"), F.sum("size").alias("_size")), "classes")
    wanted = targets(classes.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, cap)

    rows = classes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    block_rows = max(BLOCK_ROWS, -(-rows // BLOCKS))
    in_source = W.partitionBy("source").orderBy("_class").rowsBetween(W.unboundedPreceding, -1)
    classes = classes.select(
        F.col("source").alias("_source"), F.col("_class").alias("_of"), F.ceil(F.col("_n") / block_rows).alias("_blocks"), F.coalesce(F.sum("_n").over(in_source), F.lit(0)).alias("_before")
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_of"))
    placed = sized.join(classes, same).drop("_source", "_of")
    head = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint")
    placed = materialise(placed.withColumn("_block", F.floor(head * F.col("_blocks") / F.lit(_HEX32)).cast("bigint")).drop("_blocks"), "blocks")

    counts = placed.groupBy("source", "_class", "_block").agg(F.count("*").alias("_n"))
    in_class = W.partitionBy("source", "_class").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("_source"), F.col("_class").alias("_of"), F.col("_block").alias("_at"), F.coalesce(F.sum("_n").over(in_class), F.lit(0)).alias("_ahead"))
    wanted = wanted.select(F.col("source").alias("_named"), "source_size", "target")
    in_block = W.partitionBy("source", "_class", "_block").orderBy("_hash", "doc_id", "size", "_text")
    numbered = placed.withColumn("_rank", F.row_number().over(in_block))
    numbered = numbered.join(counts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_of")) & (F.col("_block") == F.col("_at")))
    numbered = numbered.join(wanted, F.col("source").eqNullSafe(F.col("_named")))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("double") / F.lit(float(16**6))
    place = F.col("_before") + F.col("_ahead") + F.col("_rank")
    copies = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    copies = F.least(copies, F.ceil(rate)).cast("bigint")
    return numbered.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with ``copy`` counting from 1."""
    mark, times = free_name(docs, "_mark"), free_name(docs, "_copies")
    taken = mix(docs, **how).groupBy(F.struct(F.col("doc_id").alias("id"), "key").alias(mark)).agg(F.sum("copies").alias(times)).where(F.col(times) > 0)
    keyed = without_repeats(docs.withColumn(mark, row_mark(docs, "doc_id", "source", "text")), mark)
    return keyed.join(taken, mark).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times))).alias(free_name(docs, "copy")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH RECURSIVE
 d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS wt FROM s),
 r(round, source, source_size, wt, target, fixed) AS (
   SELECT 0, source, source_size, wt, 1.5 * (sum(source_size) OVER ()) * wt / (sum(wt) OVER ()), false FROM w
   UNION ALL
   SELECT round + 1, source, source_size, wt,
          CASE WHEN fixed OR target > 2.0 * source_size THEN 2.0 * source_size
               ELSE (1.5 * (sum(source_size) OVER ()) - (sum(CASE WHEN fixed OR target > 2.0 * source_size THEN 2.0 * source_size ELSE 0 END) OVER ()))
                    * wt / (sum(CASE WHEN fixed OR target > 2.0 * source_size THEN 0 ELSE wt END) OVER ()) END,
          fixed OR target > 2.0 * source_size
   FROM r WHERE round < 40),
 t AS (SELECT source, source_size, target FROM r WHERE round = 40),
 o AS (SELECT d.*, t.source_size, t.target, t.target / t.source_size AS rate,
        ('0x' || substr(md5('mix-1|' || coalesce(d.source, '')), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u,
        row_number() OVER (PARTITION BY d.source ORDER BY greatest(length(bin(size)) - 4, 0) * 16 + (size >> greatest(length(bin(size)) - 4, 0)::INT), md5('mix-1:' || doc_id)) AS place
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target, ((floor(place * rate + u) - floor((place - 1) * rate + u))::BIGINT * size)::BIGINT AS taken FROM o
"""
