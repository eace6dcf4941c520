"""Checksums, header rules and magic bytes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes in hex and the extension they stand for.
MAGIC = {
    "42505331": "bps", "4d436f6d70724844": "chd", "4349534f": "cso", "5041544348": "ips", "33495244": "ird", "5244534b": "rdsk", "52494646": "riff", "52565a01": "rvz", "d6c3c4": "xdelta", "5a49534f": "zso",
    "504b0304": "zip", "377abcaf271c": "7z", "1f8b": "gz", "3c3f786d6c": "xml",
}


def crc32(content: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.crc32(content)), 8, "0"))


def checksums(content: Column) -> Column:
    return F.struct(F.octet_length(content).cast("bigint").alias("size"), crc32(content).alias("crc"), F.md5(content).alias("md5"), F.sha1(content).alias("sha1"))


def rules_hold(content: Column, rules: Column) -> Column:
    """Whether every rule (start_byte, hex_value) fits; no rules fit anything."""
    hexed = lambda r: F.lower(F.hex(F.substring(content, (r["start_byte"] + 1).cast("int"), (F.length(r["hex_value"]) / 2).cast("int"))))
    return F.forall(rules, lambda r: hexed(r) == F.lower(r["hex_value"]))


def behind_header(content: Column, size: Column, rules: Column) -> Column:
    """The content without its header of ``size`` bytes, where the rules hold."""
    return F.when(rules_hold(content, rules), F.substring(content, (size + 1).cast("int"), F.octet_length(content))).otherwise(content)


def sniffed(content: Column, path: Column) -> Column:
    """Extension by leading bytes, else the path's own in lower case."""
    found = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    for magic, extension in reversed(MAGIC.items()):
        found = F.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic.upper(), extension).otherwise(found)
    return found


def known_hash(meta: Column, content: Column, algorithm: str) -> Column:
    """A checksum that metadata gives already, else computed; computing reads the content only then."""
    computed = {"crc": crc32, "md5": F.md5, "sha1": F.sha1}[algorithm](content)
    return F.coalesce(F.lower(meta), computed)
