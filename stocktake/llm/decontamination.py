"""Benchmark decontamination by template canonicalisation, on built-in functions only.

Texts and benchmark items become token templates: numbers, names and units of
measure turn into typed placeholders, everything else to lower case without
punctuation. Windows of template tokens are hash-joined, so an item is found
whatever values it was filled with. Along each alignment of an item and a text
the slots are then checked: one value of the item must stand for one value of
the text throughout, and two names of the item for two names of the text.
Windows that fail don't count. A window that is mostly slots, or too short for a
template, says little; its very words are looked for instead, so that verbatim
copies of such items are still found.

An item counts as leaked when enough of its windows are found: half of them, or
by default six in all, which is a passage of thirteen tokens.

Defined results: null and empty texts, and items of a single token, match
nothing; an item shorter than a window is one window of its own length; very
long texts are read whole; further columns may have any name;
repeated rows give one result row; rows with one id and several texts give
their largest figures; empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import free_name, let, materialise, row_key, row_mark, table, words_of

WINDOW = 8
#: Placeholders may fill at most this share of a template window, and of a shorter one; other windows go by their words.
MAX_SLOTS, MAX_SLOTS_SHORT = 0.5, 0.25
MIN_TOKENS, MIN_TEMPLATE = 2, 3
ENOUGH_SHARE, ENOUGH_WINDOWS = 0.5, 6
#: Benchmark windows are broadcast up to this many rows, and shuffled beyond.
BROADCAST_WINDOWS = 200_000

NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
_S = r" \t-\r"
NUMBER_WORDS = "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|dozen"
UNIT_WORDS = (
    "mm|cm|m|km|inch|inches|foot|feet|yard|yards|mile|miles|metre|metres|meter|meters|kilometres|kilometers|g|mg|kg|grams|kilograms|pound|pounds|ounces|tons|ml|l|litres|liters|gallons|"
    "ms|s|seconds|second|minutes|minute|hours|hour|days|day|weeks|week|months|month|years|year|mph|kmh|hz|khz|mhz|ghz|w|kw|v|volts|j|kj|n|pa|celsius|fahrenheit|degrees|percent|dollars|euros|cents|usd|eur|gb|mb|kb|tb"
)
#: A digit anywhere, or a number word, makes a number of a whole word.
NUMBER_PATTERN = rf"(?<![^{_S}])[^{_S}0-9]*+[0-9][^{_S}]*"
NUMBER_WORD_PATTERN = rf"(?<![^{_S}])(?i:{NUMBER_WORDS})(?=[.,;:!?)]*([{_S}]|$))"
#: Words that open sentences and questions and are no names.
OPENERS = (
    "A|An|And|Any|Are|As|At|But|By|Can|Choose|Compute|Consider|Could|Define|Describe|Determine|Did|Do|Does|During|Each|Estimate|Evaluate|Every|Explain|Find|For|From|Given|Had|Has|Have|He|Her|His|How|I|If|In|Is|It|Its|"
    "Let|List|Many|Most|My|Name|No|Not|Of|On|One|Or|Our|Prove|Select|She|Should|Show|Simplify|Since|So|Solve|Some|State|Suppose|That|The|Their|Then|There|These|They|This|To|True|Was|We|Were|What|When|Where|Which|While|"
    "Who|Whose|Why|Will|With|Would|Write|You|Your"
)
#: A capital makes a name, inside a sentence or at its beginning, except in an opener.
NAME_PATTERN = rf"(?=\p{{Lu}})(?<=[\p{{Ll}},;:.!?)] |^|\n)(?!(?:{OPENERS})(?!\p{{L}}))\p{{Lu}}[^{_S}]*"
UNIT_PATTERN = rf"(?<={NUMBER}[{_S}])(?i:{UNIT_WORDS})(?=[.,;:!?)]*([{_S}]|$))"
PUNCTUATION = rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}-{UNIT}{_S}]+"


def plain(text: Column) -> Column:
    """The words of a text without punctuation; they align with its template."""
    return words_of(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NUMBER}-{UNIT}]", " "), PUNCTUATION, ""))


def template(text: Column) -> Column:
    """The template tokens of a text."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NUMBER}-{UNIT}]", " ")
    for pattern, mark in ((NAME_PATTERN, NAME), (NUMBER_PATTERN, NUMBER), (NUMBER_WORD_PATTERN, NUMBER), (UNIT_PATTERN, UNIT)):
        text = F.regexp_replace(text, pattern, mark)
    return words_of(F.regexp_replace(F.lower(text), PUNCTUATION, ""))


def windows(tokens: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` tokens, in order."""
    starts = F.slice(tokens, 1, F.greatest(F.size(tokens) - size + 1, F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(F.lit(size), w, *[F.get(tokens, i + k) for k in range(1, size)]))


def _all_windows(sizes: list[int], tokens: Column) -> Column:
    return F.struct(*[windows(tokens, size).alias(f"w{size}") for size in sizes])


def literal(text: Column) -> Column:
    """The words of a text as tokens that are no template tokens."""
    return F.transform(plain(text), lambda w: F.concat(F.lit("="), F.lower(w)))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, size, literal, n_windows, at, h, slots) of all windows."""
    text = F.col(text_col)
    read = items.select(F.col(id_col).alias("item_id"), template(text).alias("t"), plain(text).alias("p"), literal(text).alias("l")).where(F.size("t") >= MIN_TOKENS)
    made = None
    for size in range(MIN_TOKENS, WINDOW + 1):
        own = read.where(F.size("t") == size) if size < WINDOW else read.where(F.size("t") >= WINDOW)
        part = own.select("item_id", "t", "p", F.posexplode(F.arrays_zip(windows(F.col("t"), size).alias("t"), windows(F.col("l"), size).alias("l"))).alias("at", "w"))
        part = part.select("item_id", "t", "p", "at", F.col("w.t").alias("ht"), F.col("w.l").alias("hl"), F.lit(size).alias("size"))
        made = part if made is None else made.unionByName(part)
    marked = F.filter(F.transform(F.slice("t", F.col("at") + 1, F.col("size")), lambda x, k: F.struct(k.alias("k"), x.alias("kind"))), lambda s: s["kind"].isin(NUMBER, NAME, UNIT))
    made = made.withColumn("slots", F.transform(marked, lambda s: F.struct(s["k"].alias("k"), F.concat(s["kind"], F.lower(F.get(F.col("p"), F.col("at") + s["k"]))).alias("value"))))
    share = F.when(F.col("size") < WINDOW, MAX_SLOTS_SHORT).otherwise(MAX_SLOTS)
    made = made.withColumn("literal", (F.size("slots") > share * F.col("size")) | (F.col("size") < MIN_TEMPLATE))
    none = F.array().cast("array<struct<k:int,value:string>>")
    made = made.select("item_id", "size", "literal", "at", F.when(F.col("literal"), F.col("hl")).otherwise(F.col("ht")).alias("h"), F.when(F.col("literal"), none).otherwise(F.col("slots")).alias("slots"))
    totals = made.groupBy("item_id").agg(F.count_distinct("at").alias("n_windows"))
    return made.join(totals, "item_id")


def leaks_by_text(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, enough_share: float = ENOUGH_SHARE, enough_windows: int = ENOUGH_WINDOWS) -> DataFrame:
    """One row per text and item that it leaks: _id, _key (of id and text), item_id, n_found, n_windows (of the item), n_changed (slots filled otherwise)."""
    known = materialise(benchmark_windows(items, item_col, item_text_col), "benchmark-windows")
    counted = {(r["size"], r["literal"]): r["n"] for r in known.groupBy("size", "literal").agg(F.count("*").alias("n")).collect()}  # a row per size and kind
    small = sum(counted.values()) <= broadcast_windows
    text = F.col(text_col)
    hashed = []
    for kind, tokens in ((False, template), (True, literal)):
        sizes = sorted(size for size, of in counted if of == kind)
        if sizes:
            hashed.append(let(tokens(text), partial(_all_windows, sizes)).alias("_literal" if kind else "_template"))
    read = docs.select(F.col(id_col).alias("_id"), row_key(docs, id_col, text_col).alias("_key"), *hashed, plain(text).alias("_p"))
    found = None
    for size, kind in sorted(counted):
        rows = read.select("_id", "_key", "_p", F.posexplode(f"{'_literal' if kind else '_template'}.w{size}").alias("_pos", "h"))
        side = known.where((F.col("size") == size) & (F.col("literal") == kind))
        fills = lambda words, pos: F.transform("slots", lambda s: F.struct(s["value"].alias("value"), F.lower(words(pos, s["k"])).alias("fill")))
        if small:
            hits = rows.join(F.broadcast(side), "h").withColumn("_fills", fills(lambda pos, k: F.get(F.col("_p"), pos + k), F.col("_pos")))
        else:  # the words of a window travel with it, not those of the text
            rows = rows.withColumn("_here", F.slice("_p", F.col("_pos") + 1, size)).drop("_p")
            hits = rows.join(side, "h").withColumn("_fills", fills(lambda pos, k: F.get(F.col("_here"), k), F.col("_pos")))
        hits = hits.select("_id", "_key", "item_id", "n_windows", "at", (F.col("_pos") - F.col("at")).alias("_shift"), "_fills")
        found = hits if found is None else found.unionByName(hits)
    kinds = f"_id {docs.schema[id_col].dataType.simpleString()}, _key bigint, item_id {items.schema[item_col].dataType.simpleString()}"
    if found is None:
        return docs.sparkSession.createDataFrame([], f"{kinds}, n_found bigint, n_windows bigint, n_changed bigint")
    aligned = found.groupBy("_id", "_key", "item_id", "n_windows", "_shift").agg(F.collect_set("at").alias("_at"), F.array_distinct(F.flatten(F.collect_set("_fills"))).alias("_fills"))
    one_fill = F.size("_fills") == F.size(F.array_distinct(F.transform("_fills", lambda s: s["value"])))
    names = F.filter("_fills", lambda s: s["value"].startswith(NAME))
    one_fill &= F.size(names) == F.size(F.array_distinct(F.transform(names, lambda s: s["fill"])))
    changed = F.size(F.filter("_fills", lambda s: F.substring(s["value"], 2, 1_000_000_000) != s["fill"]))
    aligned = aligned.where(one_fill).withColumn("_changed", changed)
    per_text = aligned.groupBy("_id", "_key", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_at")))).cast("bigint").alias("n_found"), F.sum("_changed").cast("bigint").alias("n_changed"))
    needed = F.greatest(F.lit(1), F.least(F.ceil(F.col("n_windows") * enough_share), F.lit(enough_windows)))
    return per_text.where(F.col("n_found") >= needed)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """One row per document and item that it leaks: id, item_id, n_found, n_windows, n_changed."""
    found = leaks_by_text(docs, items, id_col, **more)
    leaks = found.groupBy("_id", "item_id").agg(F.max("n_found").alias("n_found"), F.max("n_windows").alias("n_windows"), F.max("n_changed").alias("n_changed"))
    return leaks.select(F.col("_id").alias(id_col), "item_id", "n_found", "n_windows", "n_changed")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item."""
    mark = free_name(docs, "_mark")
    gone = leaks_by_text(docs, items, id_col, text_col).select(F.struct(F.col("_id").alias("id"), F.col("_key").alias("key")).alias(mark)).distinct()
    return docs.withColumn(mark, row_mark(docs, id_col, text_col)).join(materialise(gone, "leaking"), mark, "left_anti").select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
