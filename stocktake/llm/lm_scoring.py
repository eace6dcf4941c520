"""Scores by cross-entropy difference of two matched n-gram models.

The target model is counted on the documents that labels mark as good, the
background model on all documents. Both are bigram models, interpolated with
unigrams and a uniform floor in the same way, over one shared vocabulary: every
word of all documents, however rare. A document's score is the mean difference
of its losses per token; low scores are like the target. No text vouches for
itself: a target document is scored by a target model without its own half of
the targets, and each token by a background model without that occurrence.

What is counted grows with the input and never passes through the driver or a
broadcast. Documents are dealt to segments, and n-grams, known by hashes, to
buckets, both of a set size, so that their numbers grow with the input. Each
segment sends the distinct n-grams it holds, with counts, to their buckets, as
packed blocks; a bucket adds up and sends back to each segment the counts of
what it sent, in the same order. Texts are shuffled once and stay in their
segment.

Hashes of n-grams have 40 bits within a bucket, so that of BUCKET_GRAMS n-grams
about one in 2**40 / BUCKET_GRAMS is mistaken for another, at every size.

Defined results: null texts and texts without words have 0 tokens and null
losses; several labels of one id make its document a target once if any of them
is good; null ids never are targets; without any target the target model is
uniform; equal texts get equal losses unless only one is a target; very long
texts are read whole, in one segment; an empty table gives no rows. Only the
named columns are read, so that further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import few_rows_a_batch, in_arrow, materialise, table

#: Bytes of text of a segment, and distinct n-grams of a segment's share of a bucket, about.
SEGMENT_BYTES, BUCKET_GRAMS = 8_000_000, 2_000_000
#: Weights of the bigram and unigram estimates and of the uniform floor, one over the number of all tokens.
BIGRAM, UNIGRAM, FLOOR = 0.7, 0.25, 0.05
#: Target ids are broadcast up to this many, and shuffled beyond.
BROADCAST_TARGETS = 1_000_000
#: Documents that are no targets, and the halves of the targets.
FOLDS = (0, 1, 2)
MEMO_WORDS = 200_000
SHORT = 40
_MASK = np.int64((1 << SHORT) - 1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: What opens a text as the history of its first word.
START = np.uint64(0x51ED270B35AE9D1F)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, 8)
        return value


@lru_cache(maxsize=1)
def _memo() -> _Memo:
    return _Memo()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def grams(texts: Iterator[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, unigrams, histories, bigrams): hashes by token, in order.

    A hash has its bucket in the upper ``bits`` of ``bits`` + SHORT.
    """
    sizes, parts = [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        if words:
            parts.append(np.fromiter(map(_memo().__getitem__, words), np.uint64, len(words)))
    n = np.array(sizes, np.int64)
    word = np.concatenate([np.empty(0, np.uint64), *parts])
    history = np.empty_like(word)
    if len(word):
        history[1:] = word[:-1]
        history[(np.cumsum(n) - n)[n > 0]] = START
    short = lambda x: (_mixed(x) >> np.uint64(64 - SHORT - bits)).view(np.int64)
    return n, short(word * _P), short(history * _P), short((history * _P + word) * _Q + np.uint64(1))


def packed(keys: np.ndarray) -> bytes:
    """The lower SHORT bits of sorted distinct keys of one bucket: bytes a step, then the steps."""
    steps = np.diff(keys & _MASK, prepend=0)
    width = (int(steps.max()).bit_length() + 7) // 8
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(block: bytes) -> np.ndarray:
    width = block[0]
    out = np.zeros(((len(block) - 1) // width if width else 1, 8), np.uint8)
    out[:, :width] = np.frombuffer(block, np.uint8, offset=1).reshape(len(out), width)
    return np.cumsum(out.reshape(-1).view(np.int64))


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, and eight more for each that needs them."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked_counts(block: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(block, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(block[n:], np.int64)
    return out


def _raw(column: pa.ChunkedArray) -> Iterator[bytes | None]:
    return (x.as_py() for x in column.cast(pa.large_binary()))


def token_totals(docs: DataFrame) -> DataFrame:
    """(fold, tokens, bytes) of all texts. ``docs``: text, fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {fold: [0, 0] for fold in FOLDS}
        for batch in batches:
            for text, fold in zip(_raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found[fold][0] += len(words_of(text))
                found[fold][1] += len(text or b"")
        rows = [(fold, *sums) for fold, sums in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["fold", "tokens", "bytes"])

    rows = in_arrow(docs.select("text", "fold"), run, "fold int, tokens bigint, bytes bigint")
    return rows.groupBy("fold").agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))


def sent(segment: pa.Table, bits: int) -> pa.Table:
    """What a segment sends: (bucket, segment, fold, grams, counts), blocks of its distinct n-grams by fold and bucket."""
    number = segment.column("segment")[0].as_py()
    folds = segment.column("fold").to_numpy()
    n, word, history, pair = grams(_raw(segment.column("text")), bits)
    fold = np.repeat(folds, n)
    opened = history[(np.cumsum(n) - n)[n > 0]]  # a text counts as one occurrence of what opens it
    rows: list[tuple] = []
    for f in FOLDS:
        at = fold == f
        keys, counts = np.unique(np.concatenate([word[at], pair[at], opened[folds[n > 0] == f]]), return_counts=True)
        if len(keys):
            buckets = keys >> SHORT
            starts = np.nonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))[0]
            rows += [(int(buckets[a]), number, f, packed(keys[a:b]), packed_counts(counts[a:b])) for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True)]
    kinds = [("bucket", pa.int64()), ("segment", pa.int64()), ("fold", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())]
    cols = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in kinds]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[k for k, _ in kinds])


def answered(bucket: pa.Table) -> pa.Table:
    """What a bucket sends back: (segment, bucket, first, second, all), the counts in either half and in all of the n-grams a segment sent, in order."""
    number = bucket.column("bucket")[0].as_py()
    blocks = [unpacked(x.as_py()) for x in bucket.column("grams")]
    sizes = [*map(len, blocks)]
    keys = np.concatenate(blocks)
    counts = np.concatenate([unpacked_counts(x.as_py(), n) for x, n in zip(bucket.column("counts"), sizes, strict=True)])
    segment, fold = np.repeat(bucket.column("segment").to_numpy(), sizes), np.repeat(bucket.column("fold").to_numpy(), sizes)
    order = np.lexsort((segment, keys))
    keys, counts, segment, fold = keys[order], counts[order], segment[order], fold[order]
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    sums = [np.add.reduceat(np.where(fold == f, counts, 0) if f else counts, starts) for f in (1, 2, 0)]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (segment[1:] != segment[:-1])
    place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))[fresh]
    segment = segment[fresh]
    order = np.argsort(segment, kind="stable")
    segment, place = segment[order], place[order]
    starts = np.nonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))[0]
    rows = [(int(segment[a]), number, *[packed_counts(n[place[a:b]]) for n in sums]) for a, b in zip(starts, np.append(starts[1:], len(segment)), strict=True)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["segment", "bucket", "first", "second", "all"])


def losses(n: np.ndarray, h: np.ndarray, u: np.ndarray, total: np.ndarray, tokens: int) -> np.ndarray:
    """Losses of tokens whose bigram, history and word occur n, h and u times among ``total`` tokens."""
    seen = np.where(h > 0, BIGRAM * n / np.maximum(h, 1) + UNIGRAM * u / np.maximum(total, 1), (BIGRAM + UNIGRAM) * u / np.maximum(total, 1))
    return -np.log(np.where(total > 0, seen + FLOOR / tokens, 1 / tokens))


def scored(segment: pa.Table, answers: pa.Table, bits: int, totals: dict[int, int]) -> pa.Table:
    """id, n_tokens, target_loss, background_loss of a segment's texts, from the answers of the buckets."""
    folds = segment.column("fold").to_numpy()
    n, word, history, pair = grams(_raw(segment.column("text")), bits)
    fold = np.repeat(folds, n)
    keys, place = np.unique(np.concatenate([word, history, pair]), return_inverse=True)  # what the segment sent, in order
    buckets, sizes = np.unique(keys >> SHORT, return_counts=True)
    blocks = {b.as_py(): k for k, b in enumerate(answers.column("bucket"))}
    found = [np.concatenate([np.empty(0, np.int64), *[unpacked_counts(answers.column(name)[blocks[b]].as_py(), size) for b, size in zip(buckets.tolist(), sizes.tolist(), strict=True)]]) for name in ("first", "second", "all")]

    def counts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in the text's own targets, and in all."""
        one, two, every = (x[at] for x in found)
        return np.where(fold == 0, one + two, np.where(fold == 1, two, one)), every

    at = place.reshape(3, -1)
    (ut, ub), (ht, hb), (nt, nb) = map(counts, at)
    tokens = max(1, sum(totals.values()))
    own = np.array([totals[1] + totals[2], totals[2], totals[1]])[fold]
    both = losses(nt, ht, ut, own, tokens), losses(nb - 1, hb - 1, ub - 1, np.full(len(fold), tokens - 1), tokens)
    starts = (np.cumsum(n) - n)[n > 0]
    means = []
    for loss in both:
        mean = np.full(len(n), np.nan)
        if len(starts):
            mean[n > 0] = np.add.reduceat(loss, starts) / n[n > 0]
        means.append(pa.array(mean, mask=n == 0))
    return pa.table([segment.column("id"), pa.array(n), *means], names=["id", "n_tokens", "target_loss", "background_loss"])


def score_documents(docs: DataFrame, good: DataFrame, broadcast_targets: int = BROADCAST_TARGETS, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, target_loss, background_loss, score (per token).

    ``good`` holds the ids of the target documents. Sizes of segments and buckets
    bound what a task holds and change no result.
    """
    spark = docs.sparkSession
    few_rows_a_batch(spark)
    chosen = good.select(F.col(id_col).alias("_good")).where("_good is not null").distinct()
    chosen = materialise(chosen.withColumn("_fold", (F.crc32(F.col("_good").cast("string").cast("binary")) % 2 + 1).cast("int")), "targets")
    few = chosen.count() <= broadcast_targets
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    marked = read.join(F.broadcast(chosen) if few else chosen, F.col("id") == F.col("_good"), "left").select("id", "text", "row", F.coalesce("_fold", F.lit(0)).alias("fold"))

    sums = {r["fold"]: r for r in token_totals(marked).collect()}  # one row per fold
    totals = {fold: sums[fold]["tokens"] if fold in sums else 0 for fold in FOLDS}
    segments = 1 + sum(r["bytes"] for r in sums.values()) // segment_bytes
    bits = min(64 - SHORT, (2 * sum(totals.values()) // bucket_grams).bit_length())
    dealt = marked.select("id", "text", "fold", F.pmod("row", F.lit(segments)).alias("segment"))

    asked = dealt.groupBy("segment").applyInArrow(lambda t: sent(t, bits), "bucket bigint, segment bigint, fold int, grams binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answered, "segment bigint, bucket bigint, first binary, second binary, all binary")
    kind = docs.schema[id_col].dataType.simpleString()
    both = dealt.groupBy("segment").cogroup(answers.groupBy("segment")).applyInArrow(lambda a, b: scored(a, b, bits, totals), f"id {kind}, n_tokens bigint, target_loss double, background_loss double")
    return both.select(F.col("id").alias(id_col), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return score_documents(table(spark, sf_dir, "documents"), labels.where("quality = 1"))
