"""Token counts by the whole-token shortcut.

A pre-token whose string encodes to one token costs one dictionary probe. Which
vocabulary strings do so is proved once, before any text is read, by encoding
every word-final vocabulary entry alone. Only the other pre-tokens go through
the merges, once per distinct string.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts are never
cut; equal rows give equal rows; only ``id_col`` and ``text_col`` are read, so
further columns of any name do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stocktake.llm.common import table

MAX_TOKENS = 2048
#: Merge results kept per worker; the table is emptied when full.
CACHE_ENTRIES = 500_000
WORD_END = "</w>"
#: Texts of these characters only: normalisation is lower-casing, and the classes below are exact.
PLAIN = re.compile("[\\t-\\r\\x20-\\x7e\\u00a1-\\u012f\\u0131-\\u017f\\u2010-\\u2027]*")
_LETTER = "a-z\\u00aa\\u00b5\\u00ba\\u00df-\\u00f6\\u00f8-\\u017f"
_NUMBER = "0-9\\u00b2\\u00b3\\u00b9\\u00bc-\\u00be"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WholeTokenCounter:
    """Counts tokens as the tokenizer file at ``path`` gives them, without added ones."""

    def __init__(self, path: str, shortcut: Iterable[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.shortcut = frozenset(shortcut)
        self.merged: dict[str, int] = {}
        marks = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, marks))) if marks else None

    def spelled(self, word: str) -> str:
        return "".join([self.alphabet[b] for b in word.encode()])

    def merge(self, word: str) -> int:
        n = self.merged.get(word)
        if n is None:
            if len(self.merged) >= CACHE_ENTRIES:
                self.merged.clear()
            n = self.merged[word] = len(self.model.tokenize(self.spelled(word)))
        return n

    def pre_tokens(self, piece: str) -> list[str]:
        if PLAIN.fullmatch(piece):
            return PRE_TOKEN.findall(piece.lower())
        text = self.tokenizer.normalizer.normalize_str(piece)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, pieces = 0, [text]
        if self.marks and "<|" in text:
            pieces = self.marks.split(text)
            total = len(pieces) - 1
        shortcut, merge = self.shortcut, self.merge
        for piece in pieces:
            for word, n in Counter(self.pre_tokens(piece)).items():
                total += n if word in shortcut else n * merge(word)
        return total


def prove_whole_tokens(path: str) -> list[str]:
    """Word-final vocabulary strings that the merges leave as one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    back = {c: b for b, c in byte_alphabet().items()}
    proved = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        stem = entry.removesuffix(WORD_END)
        if stem == entry or not stem or any(c not in back for c in stem):
            continue
        if len(tokenizer.model.tokenize(stem)) == 1:
            try:
                proved.append(bytes(back[c] for c in stem).decode())
            except UnicodeDecodeError:
                continue
    return proved


@lru_cache(maxsize=4)
def _counter(path: str, shortcut: frozenset[str]) -> WholeTokenCounter:
    return WholeTokenCounter(path, shortcut)


def count_tokens(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    The broadcast holds vocabulary strings only, so its size is bounded by the
    vocabulary file and not by the data.
    """
    spark = docs.sparkSession
    proved = spark.sparkContext.broadcast(frozenset(prove_whole_tokens(path)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, proved.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                n_bytes.append(len(text.encode()) if text else 0)
                n_tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > max_tokens for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
