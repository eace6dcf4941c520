"""Files on disk, members of archives, and the listings that tools print."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*", with_content: bool = True) -> DataFrame:
    """All files below ``path``; leave out the content where only names and sizes matter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "content") if with_content else files.select("path", "length")


def zip_members(files: DataFrame, suffix: str = "") -> DataFrame:
    """(path, member, size, crc, content) of the members of zip archives; what is no zip has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                for info in archive.infolist():
                    if not info.is_dir() and info.filename.endswith(suffix):
                        yield pa.RecordBatch.from_pydict({"path": [path], "member": [info.filename], "size": pa.array([info.file_size], pa.int64()), "crc": [f"{info.CRC:08x}"], "content": [archive.read(info)]})

    return files.select("path", "content").mapInArrow(run, "path string, member string, size bigint, crc string, content binary")


def listed_members(listing: Column) -> Column:
    """Members (path, size, crc) in a technical listing of an archiver; its first path is the archive itself."""
    pick = lambda key: F.regexp_extract_all(listing, F.lit(rf"(?m)^{key} = ?(.*)$"), 1)
    paths = F.slice(pick("Path"), 2, F.greatest(F.size(pick("Path")) - 1, F.lit(0)))
    return F.transform(F.arrays_zip(paths.alias("p"), pick("Size").alias("s"), pick("CRC").alias("c")), lambda x: F.struct(x["p"].alias("path"), x["s"].try_cast("bigint").alias("size"), F.lower(x["c"]).alias("crc")))


def disc_info(info: Column) -> Column:
    """struct(type, size, data_sha1, sha1, parent_sha1, tracks) from what a disc-image tool prints."""
    field = lambda key: F.nullif(F.regexp_extract(info, rf"(?m)^{key}:\s*(\S.*?)\s*$", 1), F.lit(""))
    kind = F.when(info.rlike("Tag='(CHT2|CHTR|CHGD)'"), "cd").when(info.rlike("Tag='DVD '"), "dvd").when(info.rlike("Tag='GDDD'"), "hd").when(info.rlike("Tag='AVAV'"), "ld")
    return F.struct(
        kind.alias("type"), F.replace(F.regexp_extract(info, r"(?m)^Logical size:\s*([0-9,]+)", 1), F.lit(","), F.lit("")).try_cast("bigint").alias("size"), field("Data SHA1").alias("data_sha1"), field("SHA1").alias("sha1"),
        field("Parent SHA1").alias("parent_sha1"), F.size(F.regexp_extract_all(info, F.lit("TRACK:([0-9]+)"), 1)).alias("tracks"),
    )


def parents_of_images(images: DataFrame) -> DataFrame:
    """(path, parent_path): in the same folder, the first image whose checksum is the parent's. ``images``: path, dir, sha1, parent_sha1."""
    parents = images.groupBy("dir", F.col("sha1").alias("parent_sha1")).agg(F.min("path").alias("parent_path"))
    return images.where("parent_sha1 is not null").join(parents, ["dir", "parent_sha1"], "left").select("path", "parent_path")
