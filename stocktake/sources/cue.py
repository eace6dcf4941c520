"""Cue sheets as nested columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

INDEX = "struct<number:int,minutes:int,seconds:int,frames:int>"
TRACK = f"struct<number:int,data_type:string,title:string,performer:string,songwriter:string,pregap:string,postgap:string,file:string,file_type:string,indices:array<{INDEX}>,comments:array<string>>"
SHEET = f"path string, catalog string, performer string, songwriter string, title string, comments array<string>, tracks array<{TRACK}>"
_LINE = re.compile(r"^\s*(\S+)\s*(.*?)\s*$")
_PA_INDEX = pa.struct([(n, pa.int32()) for n in ("number", "minutes", "seconds", "frames")])
_PA_TRACK = pa.struct([("number", pa.int32()), ("data_type", pa.string()), *[(n, pa.string()) for n in ("title", "performer", "songwriter", "pregap", "postgap")], ("file", pa.string()), ("file_type", pa.string()), ("indices", pa.list_(_PA_INDEX)), ("comments", pa.list_(pa.string()))])
_PA = pa.schema([("path", pa.string()), ("catalog", pa.string()), ("performer", pa.string()), ("songwriter", pa.string()), ("title", pa.string()), ("comments", pa.list_(pa.string())), ("tracks", pa.list_(_PA_TRACK))])


def parse(text: str) -> dict:
    """One sheet. A track belongs to the file named before it; remarks to the track they follow, else to the next file's."""
    sheet: dict = {"catalog": None, "performer": None, "songwriter": None, "title": None, "comments": [], "tracks": []}
    file, kind, waiting = None, None, []
    for line in text.splitlines():
        m = _LINE.match(line)
        if not m:
            continue
        word, rest = m[1].upper(), m[2]
        track = sheet["tracks"][-1] if sheet["tracks"] else None
        if word == "FILE":
            name = re.match(r'"(.*)"\s*(\S*)$|(\S+)\s*(\S*)$', rest)
            file, kind = (name[1] or name[3], name[2] or name[4]) if name else (rest, None)
        elif word == "TRACK":
            number, _, data_type = rest.partition(" ")
            sheet["tracks"].append({"number": int(number), "data_type": data_type.strip(), **dict.fromkeys(("title", "performer", "songwriter", "pregap", "postgap")), "file": file, "file_type": kind, "indices": [], "comments": waiting})
            waiting = []
        elif word == "INDEX" and track:
            number, _, at = rest.partition(" ")
            minutes, seconds, frames = (int(x) for x in at.split(":"))
            track["indices"].append({"number": int(number), "minutes": minutes, "seconds": seconds, "frames": frames})
        elif word == "REM":
            (waiting if sheet["tracks"] or rest.endswith("AREA") else sheet["comments"]).append(rest)
        elif word in ("PREGAP", "POSTGAP") and track:
            track[word.lower()] = rest
        elif word in ("PERFORMER", "SONGWRITER", "TITLE") or word == "CATALOG" and not track:
            (track or sheet)[word.lower()] = rest.strip('"')
    if waiting and sheet["tracks"]:
        sheet["tracks"][-1]["comments"] += waiting
    return sheet


def read_sheets(files: DataFrame) -> DataFrame:
    """``files``: path, content -> one row per sheet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p} | parse((c or b"").decode("utf-8", "replace")) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_PA)

    return files.select("path", "content").mapInArrow(run, SHEET)
