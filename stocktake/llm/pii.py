"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Base spans are emails, IPv4 addresses, payment cards and phone numbers. They are
seeds, together with credentials of well-known forms, which become spans of kind
``secret``. The words around seeds induce lexical patterns, two words to the
left, or one on either side. Spark scores the graph of patterns and of the
identifier-shaped words they stand around: a pattern's confidence is the share
of its distinct fillers that are believed, and a filler is believed as its
patterns are, which is repeated until no score moves by more than SETTLED, at
most ROUNDS times. Fillers of confident patterns become further spans of kind
``context``; base spans always stay.

A pattern must have a fixed number of distinct seeds, whatever the size of the
corpus, so that the patterns grow with it, and more distinct seeds than distinct
plain words: one that stands around as many words that are no identifiers is no
evidence and is left out of the graph. Whether it does is known once as many
words as it has seeds are found, so that a task sends no more of them. Only a
table of bounded size with these limits travels to the texts; what it lets
through is joined exactly, and its errors raise limits only.

Offsets count code points, ends are exclusive. Defined results: null and empty
texts have no spans; very long texts and words are read whole; equal texts get
equal spans; repeated rows each get a row; an empty table gives no rows. Only the
named columns are read, so that further columns may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import free_name, in_arrow, materialise, met_and_rest, row_key, row_mark, table

KINDS = ("email", "ip", "card", "phone")
SECRET, CONTEXT = "secret", "context"
#: Distinct seeds that a pattern needs; what it must be worth; the score a filler needs.
MIN_SEEDS, MIN_CONFIDENCE, MIN_SCORE = 3, 0.5, 0.5
#: Added to a pattern's fillers, so that few of them prove little.
SMOOTHING = 1.0
ROUNDS, SETTLED = 8, 0.02
#: Cells of the table of limits.
LIMIT_CELLS = 1 << 22
MEMO_WORDS, HELD = 200_000, 500_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: No match can begin inside a run of digits, so runs are tried at their first digit only.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Credentials of well-known forms: hex digests and keys, prefixed access keys, signed tokens.
CREDENTIAL = re.compile(
    r"(?<![0-9A-Za-z])(?:(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})"
    r"|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_(?:live|test)_[0-9A-Za-z]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?![0-9A-Za-z])"
)
#: An identifier-shaped word: five characters or more without its edges, of them two digits.
EDGES = re.compile(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$")
SHAPE = re.compile(r"(?=.{5})(?:[^0-9]*[0-9]){2}", re.DOTALL)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the email pattern, found from their @ so that time stays linear."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            last = end.end()
            yield start, last, "email"
        else:
            last = at + 1
        at = text.find("@", last)


def base_spans(text: str | None) -> list[Span]:
    """Base spans by start, then kind as listed."""
    if not text:
        return []
    found = list(emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower())
        return value


@lru_cache(maxsize=1)
def _memo() -> _Memo:
    return _Memo()


def instance_of(text: str) -> int:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(text.lower(), 7)).view(np.int64).item()


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_memo().__getitem__, words), np.uint64, len(words))


def patterns(before2: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two patterns of each place, from the hashes of the words around it; 0 stands for none."""
    return tuple((x ^ (x >> np.uint64(29))).view(np.int64) for x in (before2 * _P + before * _Q + np.uint64(1), before * _P + after * _Q + np.uint64(2)))


def secret_spans(text: str | None, base: list[Span]) -> list[Span]:
    """Credentials that touch no base span; a run of digits alone is none."""
    found = [(m.start(), m.end(), SECRET) for m in CREDENTIAL.finditer(text or "") if not m[0].isdigit()]
    return [s for s in found if not any(b[0] < s[1] and s[0] < b[1] for b in base)]


def seed_patterns(text: str, spans: list[Span]) -> Iterator[tuple[int, int, str]]:
    """(pattern, instance, kind) of each span that has a word on the side it needs."""
    if not spans:
        return
    found = [*WORD.finditer(text)]
    starts = [m.start() for m in found]
    for start, end, kind in spans:
        first, last = bisect_right(starts, start) - 1, bisect_left(starts, end) - 1
        words = [found[k][0] if 0 <= k < len(found) else None for k in (first - 2, first - 1, last + 1)]
        two, around = patterns(*[np.array([0 if w is None else _memo()[w]], np.uint64) for w in words])
        if words[0] is not None:
            yield int(two[0]), instance_of(text[start:end]), kind
        if words[1] is not None and words[2] is not None:
            yield int(around[0]), instance_of(text[start:end]), kind


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[str | None]:
    """The texts of a batch, one at a time."""
    return (x.as_py() for x in batch.column(at))


def seeds(docs: DataFrame) -> DataFrame:
    """(pattern, instance) of all seeds. ``docs``: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[int, int]] = set()
            for text in _texts(batch, 0):
                base = base_spans(text)
                rows.update(x[:2] for x in seed_patterns(text or "", base + secret_spans(text, base)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["pattern", "instance"])

    return in_arrow(docs, run, "pattern bigint, instance bigint").distinct()


def distinct_rows(pairs: np.ndarray) -> np.ndarray:
    """The distinct rows of a table of two columns."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])] if len(pairs) else pairs


def limits_of(patterns: DataFrame) -> np.ndarray:
    """For each cell of patterns, 0 if it has none, else the bits of the largest support. ``patterns``: pattern, support."""
    bits = F.length(F.bin("support"))
    cells = patterns.groupBy(F.pmod("pattern", F.lit(LIMIT_CELLS)).cast("int").alias("cell")).agg(F.max(bits).cast("int").alias("bits")).toArrow()
    table = np.zeros(LIMIT_CELLS, np.uint8)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().astype(np.uint8)
    return table


def cell_of(pattern: np.ndarray) -> np.ndarray:
    return np.mod(pattern, LIMIT_CELLS)


def within_limits(pairs: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The distinct rows (pattern, other), of each pattern no more than its limit, which is above its support."""
    pairs = distinct_rows(pairs)
    if not len(pairs):
        return pairs
    fresh = np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])
    starts = np.nonzero(fresh)[0]
    rank = np.arange(len(pairs)) - starts[np.cumsum(fresh) - 1]
    return pairs[rank < np.int64(1) << limits[cell_of(pairs[:, 0])].astype(np.int64)]


def candidates(text: str, spans: list[Span], limits: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Places of a text whose pattern has a limit.

    Gives (pattern, instance, start, end) for identifier-shaped fillers that
    touch no seed, and (pattern, hash) of all other words but those of seeds.
    """
    words = WORD.findall(text)
    h = _hashes(words)
    zero = np.zeros(1, np.uint64)
    before = np.concatenate([zero, h])[: len(h)]
    before2 = np.concatenate([zero, zero, h])[: len(h)]
    after = np.concatenate([h[1:], zero])[: len(h)]
    found: list[tuple[int, int, int, int]] = []
    others: list[np.ndarray] = []
    starts: list[int] | None = None
    inside: set[int] = set()
    if spans:
        starts = [m.start() for m in WORD.finditer(text)]
        for start, end, _ in spans:
            inside.update(range(bisect_right(starts, start) - 1, bisect_left(starts, end)))
    for pattern in patterns(before2, before, after):
        at = np.nonzero(limits[cell_of(pattern)])[0]
        shaped = np.zeros(len(at), bool)
        for k, i in enumerate(at.tolist()):
            if i in inside:
                shaped[k] = True
                continue
            core = EDGES.sub("", words[i])
            if SHAPE.match(core):
                starts = starts or [m.start() for m in WORD.finditer(text)]
                start = starts[i] + words[i].index(core)
                end = start + len(core)
                shaped[k] = True
                found.append((int(pattern[i]), instance_of(core), start, end))
        plain = at[~shaped]
        others.append(np.stack([pattern[plain], h[plain].view(np.int64)], axis=1))
    return found, within_limits(np.concatenate(others), limits)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_CANDIDATE = pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def span_rows(docs: DataFrame, limits: np.ndarray) -> DataFrame:
    """A row per document (id, key, base, secrets, candidates), and the distinct (pattern, other) of each task within the limits; other is a word's hash."""
    kind = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(limits)
    names = ["id", "key", "base", "secrets", "candidates", "pattern", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        id_type = None

        def pairs(rows: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(rows))
            return pa.RecordBatch.from_arrays([none.cast(id_type), none.cast(pa.int64()), none.cast(pa.list_(_SPAN)), none.cast(pa.list_(_SPAN)), none.cast(pa.list_(_CANDIDATE)), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            base, secrets, found = [], [], []
            for text in _texts(batch, 2):
                spans = base_spans(text)
                more = secret_spans(text, spans)
                for column, some in ((base, spans), (secrets, more)):
                    column.append([{"start": s, "end": e, "kind": k} for s, e, k in some])
                places, others = candidates(text, spans + more, shared.value) if text and shared.value.any() else ([], np.empty((0, 2), np.int64))
                found.append([dict(zip(("pattern", "instance", "start", "end"), x, strict=True)) for x in places])
                held.append(others)
                size += len(others)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.list_(_SPAN)), pa.array(secrets, pa.list_(_SPAN)), pa.array(found, pa.list_(_CANDIDATE)), none, none], names=names)
            if size > HELD:
                held = [within_limits(np.concatenate(held), shared.value)]
                size = len(held[0])
                if size > HELD // 2:
                    yield pairs(held.pop())
                    size = 0
        if held:
            yield pairs(within_limits(np.concatenate(held), shared.value))

    span, place = "array<struct<start:int,end:int,kind:string>>", "array<struct<pattern:bigint,instance:bigint,start:int,end:int>>"
    return in_arrow(docs, run, f"id {kind}, key bigint, base {span}, secrets {span}, candidates {place}, pattern bigint, other bigint")


def scored(edges: DataFrame, others: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of the graph: (pattern, confidence) and (instance, score).

    ``edges``: pattern, instance, seed (1 for seeds). Seeds are believed; every
    other word that a pattern stands around speaks against it.
    """
    fillers = edges.groupBy("pattern").agg(F.count("*").alias("n")).join(others, "pattern", "left")
    weight = fillers.select("pattern", (F.col("n") + F.coalesce("others", F.lit(0)) + SMOOTHING).alias("weight"))
    believed = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"), F.max("seed").alias("seed"))
    for k in range(rounds):
        confident = edges.select("pattern", "instance").join(believed.select("instance", "score"), "instance").groupBy("pattern").agg(F.sum("score").alias("s"))
        confident = materialise(confident.join(weight, "pattern").select("pattern", (F.col("s") / F.col("weight")).alias("confidence")), f"confidence-{k}")
        missed = F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9))))
        heard = edges.join(confident, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), (1 - F.exp(missed)).alias("score"))
        heard = heard.join(believed.select("instance", F.col("score").alias("was")), "instance")
        score = F.when(F.col("seed") == 1, 1.0).otherwise(F.col("score"))
        believed = materialise(heard.select("instance", "seed", score.alias("score"), F.abs(score - F.col("was")).alias("moved")), f"scores-{k}")
        if believed.where(F.col("moved") > SETTLED).isEmpty():
            break
    return confident, believed.select("instance", "score")


def find_pii(docs: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, key, base and added (arrays of start, end, kind; added are secrets, then contexts)."""
    read = docs.select(F.col(id_col).alias("id"), row_key(docs, id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    seeded = materialise(seeds(read.select("text")), "seeds")
    enough = materialise(seeded.groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= min_seeds), "patterns")
    rows = materialise(span_rows(read, limits_of(enough)), "spans")

    # Counted before the join, which would else be pushed below the count and see each pair.
    others = materialise(rows.where("pattern is not null").select("pattern", "other").distinct().groupBy("pattern").agg(F.count("*").alias("others")), "others-of-all")
    alive = enough.join(others, "pattern", "left").where(F.coalesce("others", F.lit(0)) < F.col("support"))
    alive = materialise(alive.select("pattern", "others"), "alive")
    others, enough = alive.where("others is not null"), alive.select("pattern")
    found = rows.where("pattern is null")
    places = found.select("key", F.explode("candidates").alias("c")).select("key", "c.*").join(enough, "pattern", "left_semi")
    places = materialise(places.distinct(), "places")
    edges = places.select("pattern", "instance").withColumn("seed", F.lit(0)).unionByName(seeded.join(enough, "pattern", "left_semi").withColumn("seed", F.lit(1)))
    edges = materialise(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    confident, believed = scored(edges, others, rounds)

    taken = places.join(confident.where(F.col("confidence") >= min_confidence).select("pattern"), "pattern", "left_semi").join(believed.where(F.col("score") >= min_score).select("instance"), "instance", "left_semi")
    added = taken.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end", F.lit(CONTEXT).alias("kind")))).alias("added"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return found.select("id", "key", "base", "secrets").join(added, "key", "left").select(F.col("id").alias(id_col), "key", "base", F.concat("secrets", F.coalesce("added", none)).alias("added"))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, last = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with all personal data replaced in the text, and its length in ``size_col`` if there is one."""
    mark, held = free_name(docs, "_mark"), free_name(docs, "_spans")
    spans = find_pii(docs, id_col=id_col, text_col=text_col).select(F.struct(F.col(id_col).alias("id"), "key").alias(mark), F.concat("base", "added").alias(held))
    spans = materialise(spans.where(F.size(held) > 0).dropDuplicates([mark]), "redactions")
    met, rest = met_and_rest(docs.withColumn(mark, row_mark(docs, id_col, text_col)), mark, spans)
    joined = met.join(spans.hint("merge"), mark, "left").select(*docs.columns, held)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *cols, spans = batch.columns
            pairs = zip(_texts(batch, at), spans.to_pylist(), strict=True)
            cols[at] = pa.array([redacted(t, [(s["start"], s["end"], s["kind"]) for s in x]) if x else t for t, x in pairs], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    done = rest.select(*docs.columns).unionByName(in_arrow(joined, run, docs.schema))
    return done.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType)) if size_col in docs.columns else done


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter(F.concat("base", "added"), lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, SECRET, CONTEXT))), s["kind"])
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    every = F.size(F.concat("base", "added")).cast("bigint").alias("n_spans")
    return found.select("doc_id", *map(count, KINDS), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(ordered).alias("spans"), count(SECRET), count(CONTEXT), every)
