"""Licence scans by canonical digests, on built-in functions only.

A text is brought to canonical form: lower case, copyright lines dropped,
punctuation and white space to single blanks, equivalent spellings to one. The
MD5 of the whole canonical text is hash-joined to the digests of known texts,
which go through the same expression. The whole document, each of its
paragraphs and each of its lines are looked up as entire texts, so that a
notice inside prose is found too, and never a part of a sentence.

The table of known digests is part of the code and thus of bounded size; it is
the only side that is broadcast.

Defined results: null and empty texts match nothing; rows that agree in id and
text get equal rows; very long texts are read whole; an empty table gives no rows.
Only the named columns are read, so that further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import let, materialise, table
from stocktake.llm.license_texts import EQUIVALENT, FAMILIES, FORMS, HEADERS, NAMES, SPDX, TEXTS

#: Every known text holds one of these, which spares other units the normalisation.
ANCHOR = r"licen[cs]|permission|redistribut|software|released under|distributed under"
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[^0-9a-z\x{80}-\x{10ffff}]+"


def known_texts() -> list[tuple[str, str]]:
    """(licence id, whole text) of everything that is looked for."""
    found = [(name, text) for known in (TEXTS, HEADERS) for name, texts in known.items() for text in texts]
    found += [(name, form.format(called)) for name, names in NAMES.items() for called in names for form in FORMS]
    return found + [(name, SPDX.format(name)) for name in {**NAMES, **TEXTS}]


def canonical(text: Column) -> Column:
    """The canonical form of a text that is in lower case already."""
    text = F.regexp_replace(text, COPYRIGHT_LINE, "$1")
    text = F.btrim(F.regexp_replace(text, PUNCTUATION, " "))
    for pattern, form in EQUIVALENT:
        text = F.regexp_replace(text, pattern, form)
    return text


def known_digests(spark: SparkSession) -> DataFrame:
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known_texts()])
    rows = spark.range(1).select(F.explode(known).alias("known")).select("known.*")
    return rows.select("license", F.md5(canonical(F.lower("text"))).alias("digest")).dropDuplicates(["digest"])


def unit_digests(text: Column) -> Column:
    """Distinct structs (digest, whole) of the document, its paragraphs and its lines that may match."""

    def units(low: Column) -> Column:
        parts = F.concat(F.split(low, r"\n[ \t\r]*\n"), F.split(low, "\n"))
        inner = F.transform(F.filter(parts, lambda x: x.rlike(ANCHOR)), lambda x: F.struct(F.md5(canonical(x)).alias("digest"), F.lit(False).alias("whole")))
        return F.array_distinct(F.concat(F.array(F.struct(F.md5(canonical(low)).alias("digest"), F.lit(True).alias("whole"))), inner))

    low = F.lower(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<struct<digest:string,whole:boolean>>")
    return let(low, lambda x: F.when(x.rlike(ANCHOR), units(x)).otherwise(none))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, licenses (ids, sorted, comma-joined; "" for none), n_licenses, whole_license, family (the strictest found, else none)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), unit_digests(F.col(text_col)).alias("_units"))
    rows = materialise(rows, "license-units")
    hits = rows.select("_key", F.explode("_units").alias("_unit")).select("_key", "_unit.digest", "_unit.whole").join(F.broadcast(known_digests(spark)), "digest")
    found = hits.groupBy("_key").agg(F.sort_array(F.collect_set("license")).alias("_ids"), F.min(F.when(F.col("whole"), F.col("license"))).alias("whole_license"))
    rank = F.lit("none")
    for family in ("permissive", "copyleft", "restricted"):
        rank = F.when(F.arrays_overlap("_ids", F.array(*map(F.lit, FAMILIES[family]))), family).otherwise(rank)
    joined = rows.select("_id", "_key").join(found, "_key", "left").withColumn("_ids", F.coalesce("_ids", F.array().cast("array<string>")))
    return joined.select(F.col("_id").alias(id_col), F.array_join("_ids", ",").alias("licenses"), F.size("_ids").cast("bigint").alias("n_licenses"), "whole_license", rank.alias("family"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    expr = f"trim(regexp_replace(regexp_replace(t, {quote(COPYRIGHT_LINE)}, '\\1', 'g'), {quote(PUNCTUATION)}, ' ', 'g'), ' ')"
    for pattern, form in EQUIVALENT:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(form.replace('$', chr(92)))}, 'g')"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known_texts())
    family = "'none'"
    for name in ("permissive", "copyleft", "restricted"):
        family = f"CASE WHEN list_has_any(ids, [{', '.join(map(quote, FAMILIES[name]))}]) THEN '{name}' ELSE {family} END"
    return rf"""
WITH
 known AS (SELECT DISTINCT license, md5({expr}) AS digest FROM (SELECT license, lower(txt) AS t FROM (VALUES {values}) v(license, txt))),
 low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
 units AS (SELECT doc_id, t, true AS whole FROM low WHERE regexp_matches(t, {quote(ANCHOR)})
   UNION ALL SELECT doc_id, t, false FROM (SELECT doc_id, unnest(list_concat(regexp_split_to_array(t, '\n[ \t\r]*\n'), string_split(t, chr(10)))) AS t FROM low) WHERE regexp_matches(t, {quote(ANCHOR)})),
 hits AS (SELECT doc_id, license, whole FROM (SELECT doc_id, whole, md5({expr}) AS digest FROM units) JOIN known USING (digest)),
 found AS (SELECT doc_id, list_sort(list(DISTINCT license)) AS ids, min(CASE WHEN whole THEN license END) AS whole_license FROM hits GROUP BY doc_id),
 every AS (SELECT low.doc_id, coalesce(ids, []::VARCHAR[]) AS ids, whole_license FROM low LEFT JOIN found USING (doc_id))
SELECT doc_id, array_to_string(ids, ',') AS licenses, len(ids)::BIGINT AS n_licenses, whole_license, {family} AS family FROM every
"""


ORACLE_SQL = _oracle()
