"""Snapshots of the state, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a local master may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="stocktake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_WRITTEN: list[str] = []


#: Shuffle files of a finished write go at once, and not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    was = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_TIDY) if was is None else spark.conf.set(_TIDY, was)
    _WRITTEN.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled = path
    return back


def release(*tables: DataFrame) -> None:
    """Remove tables that ``settle`` wrote and that no result is still to be read from."""
    for path in [t._settled for t in tables]:
        _remove(tables[0].sparkSession, path)
        _WRITTEN.remove(path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> int:
    """Remove the intermediate tables that this driver wrote; results that are still to be read need them. Their number."""
    done = len(_WRITTEN)
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())
    return done


def commit(tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables as one new version under ``root`` and point CURRENT at it.

    Readers see the old version until the pointer is replaced; one writer at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{root}/CURRENT")
    return version


def current(spark: SparkSession, root: str) -> str:
    return spark.read.parquet(f"{root}/CURRENT").first()["version"]


def load(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/{version or current(spark, root)}/{name}")
