"""Quality rules with cross-document line frequency, on built-in functions only.

Base rules look at one text: words, symbols, repeated lines, words inside
repeated 3-word windows. The method looks across texts: every line is
normalised and hashed, distinct documents are counted per host and line, lines
above the limit are taken away, and a document with too little left is
rejected. A document is an id, so exact copies under other ids count; rows
without an id are told apart by their texts.

Defined results: null and empty texts have no words and fail the base rules; a
null source is a host of its own; rows that agree in id, source and text share
one verdict and count once; rows with the same id but other texts are judged
apart; very long texts and lines are read whole; an empty table gives no rows.
Only the named columns are read, so that further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import SPACES, let, materialise, table, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: A line in more distinct documents of a host than this is taken away.
LINE_LIMIT = 20
#: A document with fewer than this percentage of its words left is depleted.
MIN_LEFT_PERCENT = 30


def _covered(items: Column, same, at) -> Column:
    """Words covered by the windows that equal a neighbour in the sorted ``items``."""

    def near(x: Column, i: Column) -> Column:
        return F.coalesce(same(F.get(items, i - 1), x), F.lit(False)) | F.coalesce(same(F.get(items, i + 1), x), F.lit(False))

    starts = F.sort_array(F.transform(F.filter(items, near), at))
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, first, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"].cast("bigint"))


def repeat_words(words: Column, n: Column) -> Column:
    return let(F.length(F.bin(n)), lambda bits: let(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1, lambda mask: _repeat_words(words, n, bits, mask)))


def _repeat_words(words: Column, n: Column, bits: Column, mask: Column) -> Column:
    """Words inside WINDOW-word windows found at least twice in ``words``.

    Window hashes share a 64-bit integer with their positions, so that one sort
    of plain integers puts equal windows side by side. Should two different
    windows agree in the hash bits that are left, the words decide.
    """
    hashes = F.transform(F.slice(words, 1, F.greatest(n - WINDOW + 1, F.lit(0))), lambda w, i: F.call_function("shiftleft", F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]), bits).bitwiseOR(i.cast("bigint")))
    place = lambda x: x.bitwiseAND(mask).cast("int")
    group = lambda x: F.call_function("shiftrightunsigned", x, bits)

    def clash(items: Column) -> Column:
        def differs(x: Column, i: Column) -> Column:
            last = F.get(items, i - 1)
            equal = [F.get(words, place(x) + k) == F.get(words, place(last) + k) for k in range(WINDOW)]
            return F.when(group(last) == group(x), ~(equal[0] & equal[1] & equal[2])).otherwise(F.lit(False))

        return F.size(F.filter(items, differs)) > 0

    spelled = F.sort_array(F.transform(F.slice(words, 1, F.greatest(n - WINDOW + 1, F.lit(0))), lambda w, i: F.struct(F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, WINDOW)]).alias("w"), i.alias("i"))))
    return let(
        F.sort_array(hashes),
        lambda items: F.when(clash(items), let(spelled, lambda rows: _covered(rows, lambda a, b: a["w"] == b["w"], lambda r: r["i"]))).otherwise(_covered(items, lambda a, b: group(a) == group(b), place)),
    )


def base_figures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
            repeat_words(w, F.size(w)).alias("n_repeat_words"),
        ),
    )


def line_keys(text: Column) -> Column:
    """For each line with words: two hashes of the normalised line and its number of words."""
    normal = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.btrim(F.regexp_replace(x, SPACES, " ")))
    return F.transform(F.filter(normal, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("words")))


def judge_quality(docs: DataFrame, line_limit: int = LINE_LIMIT, min_left_percent: int = MIN_LEFT_PERCENT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, the base figures, base_failed, n_removed_words, kept."""
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("_host"))
    rows = read.select("_id", "_host", F.xxhash64("_id", "_host", "_text").alias("_key"), F.xxhash64(F.col("_id").isNull(), F.coalesce(F.col("_id").cast("string"), F.col("_text"))).alias("_same"), base_figures(F.col("_text")).alias("_base"), line_keys(F.col("_text")).alias("_lines"))
    rows = materialise(rows, "rule-rows")

    seen = rows.select("_host", "_same", F.explode(F.array_distinct(F.transform("_lines", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))).alias("_line"))
    seen = seen.select("_host", "_same", "_line.a", "_line.b").distinct()
    common = materialise(seen.groupBy("_host", "a", "b").agg(F.count("*").alias("_docs")).where(F.col("_docs") > line_limit).drop("_docs"), "common-lines")

    lines = rows.select("_key", "_host", F.posexplode("_lines").alias("_pos", "_line")).select("_key", "_host", "_pos", "_line.a", "_line.b", "_line.words")
    removed = lines.join(common, ["_host", "a", "b"], "left_semi").groupBy("_key", "_pos").agg(F.max("words").alias("words")).groupBy("_key").agg(F.sum("words").alias("n_removed_words"))

    base = rows.select("_id", "_key", "_base.*").join(removed, "_key", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce(F.col("n_removed_words"), F.lit(0).cast("bigint"))
    left_enough = 100 * (F.col("n_words") - gone) >= min_left_percent * F.col("n_words")
    return base.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), gone.alias("n_removed_words"), (~failed & left_enough).alias("kept")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH
 d AS (SELECT doc_id, coalesce(text, '') AS text, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
 win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
 lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY doc_id),
 norm AS (SELECT doc_id, source, text, trim(regexp_replace(lower(line), '[ \t-\r]+', ' ', 'g'), ' ') AS line FROM lines),
 common AS (SELECT source, line FROM norm WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) > 20),
 gone AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM norm JOIN common USING (source, line) GROUP BY doc_id),
 f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
       FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept
FROM f
"""
