"""Published collections: their codes, and catalogues that are delivered as archives in a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stocktake.sources.blobs import read_files, zip_members
from stocktake.sources.catalog_xml import read_catalogues, unpacked

#: Names of published collections and their codes.
CODES = {
    "Acorn - Archimedes": "arch",
    "Apple - Macintosh": "mac",
    "Arcade - Konami - e-Amusement": "kea",
    "Arcade - Konami - FireBeat": "kfb",
    "Arcade - Konami - System GV": "ksgv",
    "Arcade - Namco - Sega - Nintendo - Triforce": "trf",
    "Arcade - Sega - Chihiro": "chihiro",
    "Arcade - Sega - Lindbergh": "lindbergh",
    "Arcade - Sega - Naomi": "naomi",
    "Arcade - Sega - Naomi 2": "naomi2",
    "Arcade - Sega - RingEdge": "sre",
    "Arcade - Sega - RingEdge 2": "sre2",
    "Atari - Jaguar CD Interactive Multimedia System": "ajcd",
    "Bandai - Pippin": "pippin",
    "Bandai - Playdia Quick Interactive System": "qis",
    "Commodore - Amiga CD": "acd",
    "Commodore - Amiga CD32": "cd32",
    "Commodore - Amiga CDTV": "cdtv",
    "Fujitsu - FM-Towns": "fmt",
    "funworld - Photo Play": "fpp",
    "IBM - PC compatible": "pc",
    "Incredible Technologies - Eagle": "ite",
    "Mattel - Fisher-Price iXL": "ixl",
    "Mattel - HyperScan": "hs",
    "Memorex - Visual Information System": "vis",
    "Microsoft - Xbox": "xbox",
    "Microsoft - Xbox 360": "xbox360",
    "NEC - PC Engine CD & TurboGrafx CD": "pce",
    "NEC - PC-88 series": "pc-88",
    "NEC - PC-98 series": "pc-98",
    "NEC - PC-FX & PC-FXGA": "pc-fx",
    "Nintendo - GameCube": "gc",
    "Nintendo - Wii": "wii",
    "Palm": "palm",
    "Panasonic - 3DO Interactive Multiplayer": "3do",
    "Philips - CD-i": "cdi",
    "Photo CD": "photo-cd",
    "PlayStation GameShark Updates": "psxgs",
    "Sega - Dreamcast": "dc",
    "Sega - Mega CD & Sega CD": "mcd",
    "Sega - Prologue 21": "sp21",
    "Sega - Saturn": "ss",
    "SNK - Neo Geo CD": "ngcd",
    "Sony - PlayStation": "psx",
    "Sony - PlayStation 2": "ps2",
    "Sony - PlayStation 3": "ps3",
    "Sony - PlayStation Portable": "psp",
    "TAB-Austria - Quizard": "quizard",
    "Tomy - Kiss-Site": "ksite",
    "VM Labs - NUON": "nuon",
    "VTech - V.Flash & V.Smile Pro": "vflash",
    "ZAPiT Games - Game Wave Family Entertainment System": "gamewave",
}


def codes(spark: SparkSession) -> DataFrame:
    """(name, code) of all published collections."""
    return spark.createDataFrame(list(CODES.items()), "name string, code string")


def read_delivery(spark: SparkSession, landing: str, work: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogues, entries and items of the zip archives below ``landing``; they are unpacked below ``work``, a shared folder."""
    return read_catalogues(spark, unpacked(zip_members(read_files(spark, landing, "*.zip")), work))
