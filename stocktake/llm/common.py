"""Shared pieces: table access, durable intermediate tables, word rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside space and \\t..\\r.
SPACES = r"[ \t-\r]+"
#: Rows that travel to a Python worker at once, unless the session sets another number.
BATCH_ROWS = 500
#: Bits of a filter over 64-bit keys, at most.
FILTER_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    go without; there a temporary folder is used and remembered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="stocktake-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage with files that every executor can read, so that the loss
    of an executor costs no more than the stage that is running.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def row_key(df: DataFrame, *cols: str) -> Column:
    """A hash by which rows that agree in ``cols`` are known again; nulls count by their place."""
    return F.xxhash64(*[df[c] for c in cols], *[df[c].isNull() for c in cols])


def row_mark(df: DataFrame, id_col: str, *cols: str) -> Column:
    """The id and the row_key of a row: rows are mixed up only if they have one id and one hash."""
    return F.struct(df[id_col].alias("id"), row_key(df, id_col, *cols).alias("key"))


def _trim() -> None:
    """Gives back to the system what a task has freed, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def few_rows_a_batch(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` by batches of few rows, so that long texts don't fill a worker."""
    few_rows_a_batch(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(whole, schema)


def bit_filter(keys: DataFrame, column: str, most: int = FILTER_BITS) -> np.ndarray:
    """A filter over a column of distinct 64-bit keys as 32-bit cells, 16 bits a key and ``most`` in all."""
    bits = min(most, max(1 << 16, 1 << (16 * max(1, keys.count())).bit_length()))
    at = F.pmod(column, F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(32)).cast("int"))
    cells = keys.select(F.floor(at / 32).cast("int").alias("cell"), one.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    mask = np.zeros(bits // 32, np.uint32)
    mask[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().astype(np.uint32)
    return mask


def in_filter(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` the filter lets through."""
    slot = np.mod(keys, len(mask) * 32)
    return (mask[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def met_and_rest(docs: DataFrame, mark: str, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may have one of ``marks``, and those that have none.

    ``mark`` is a column of row_marks in both. A bit filter of bounded size over
    the keys parts the rows where they are read, so that the rest is not shuffled;
    what it lets through by chance is among the first and has to be joined.
    """
    mask = docs.sparkSession.sparkContext.broadcast(bit_filter(marks.select(F.col(mark)["key"].alias("key")).distinct(), "key"))
    at = docs.columns.index(mark)

    def rows_where(met: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(at).field("key").to_numpy()
                yield batch.filter(pa.array(in_filter(mask.value, keys) == met))

        return in_arrow(docs, run, docs.schema)

    return rows_where(True), rows_where(False)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_repeats(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row of each ``key``; only rows whose key repeats are shuffled, if there are any."""
    again = materialise(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "repeats")
    if again.isEmpty():
        return df
    return df.join(again, key, "left_anti").unionByName(df.join(again, key, "left_semi").dropDuplicates([key]))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]
