"""Disc listings: a binary record with the header of a disc image and the checksums of its files.

The record is little-endian and may be gzipped as a whole: magic (4 bytes),
version (1), entry id (9), length (1) and name, update version (4), entry version
(5), application version (5); header and footer, each a length (4) and gzipped
bytes; number (1) of regions, a checksum (16) each; number (4) of files, sector
(8) and checksum (16) each.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SECTOR = 2048
_PA_HASH = pa.struct([("location", pa.int64()), ("md5", pa.string())])
_PA_ENTRY = pa.struct([("path", pa.string()), ("ordinal", pa.int32()), ("size", pa.int64()), ("location", pa.int64())])
_PA = pa.schema([
    ("image", pa.string()), ("version", pa.int32()), ("entry_id", pa.string()), ("name", pa.string()), ("update_version", pa.string()), ("entry_version", pa.string()), ("app_version", pa.string()),
    ("files", pa.int64()), ("regions", pa.list_(pa.string())), ("hashes", pa.list_(_PA_HASH)), ("entries", pa.list_(_PA_ENTRY)), ("error", pa.string()),
])
SCHEMA = (
    "image string, version int, entry_id string, name string, update_version string, entry_version string, app_version string, files bigint, regions array<string>, "
    "hashes array<struct<location:bigint,md5:string>>, entries array<struct<path:string,ordinal:int,size:bigint,location:bigint>>, error string"
)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        piece = self.data[self.at : self.at + n]
        if len(piece) != n:
            raise ValueError("the record ends too early")
        self.at += n
        return piece

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def text(self, n: int) -> str:
        return self.take(n).decode("utf-8").rstrip()


def directory(header: bytes) -> list[dict]:
    """The files of an ISO 9660 image, one row per extent, in order of the walk; folders after the files beside them."""
    root = header[16 * SECTOR + 156 :][:34]
    if header[16 * SECTOR + 1 :][:5] != b"CD001" or len(root) < 34:
        raise ValueError("no image header")
    rows: list[dict] = []
    waiting, seen = [("", *struct.unpack_from("<I4xI", root, 2))], set()
    while waiting:
        prefix, sector, size = waiting.pop(0)
        if sector in seen:
            continue
        seen.add(sector)
        block = header[sector * SECTOR : sector * SECTOR + size]
        at = 0
        while at < len(block):
            length = block[at]
            if not length:  # records do not cross sectors
                at = (at // SECTOR + 1) * SECTOR
                continue
            record = block[at : at + length]
            at += length
            if len(record) < 34 or len(record) < 33 + record[32]:
                raise ValueError("a directory record ends too early")
            location, extent = struct.unpack_from("<I4xI", record, 2)
            raw = record[33 : 33 + record[32]]
            if raw in (b"\0", b"\1"):
                continue
            name = raw.decode("utf-8", "replace").partition(";")[0]
            if record[25] & 2:
                waiting.append((f"{prefix}{name}/", location, extent))
            else:
                rows.append({"path": prefix + name, "ordinal": len(rows), "size": extent, "location": location})
    return rows


def parse(data: bytes) -> dict:
    r = _Reader(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    r.take(4)
    out: dict = {"version": r.number(1), "entry_id": r.text(9), "name": r.text(r.number(1)), "update_version": r.text(4), "entry_version": r.text(5), "app_version": r.text(5)}
    header = gzip.decompress(r.take(r.number(4)))
    r.take(r.number(4))
    out["regions"] = [r.take(16).hex() for _ in range(r.number(1))]
    out["files"] = r.number(4)
    out["hashes"] = [{"location": r.number(8), "md5": r.take(16).hex()} for _ in range(out["files"])]
    if any(h["location"] >> 63 for h in out["hashes"]):
        raise ValueError("a sector out of range")
    return out | {"entries": directory(header), "error": None}


def read_listings(files: DataFrame) -> DataFrame:
    """One row per record of ``files`` (path, content); what can't be read has an ``error`` and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = {n: None for n in _PA.names}
                try:
                    row |= parse(content.as_py() or b"")
                except (ValueError, OSError, EOFError, OverflowError, struct.error, zlib.error) as error:
                    row["error"] = str(error) or type(error).__name__
                yield pa.RecordBatch.from_pylist([row | {"image": path}], schema=_PA)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
