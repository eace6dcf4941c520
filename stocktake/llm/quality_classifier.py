"""Quality scores by a regularised quadratic discriminant.

Each text becomes a short vector of transformed statistics. Two Gaussians are
fitted, one per label, whose covariances are shrunk first towards the pooled
covariance and then towards a scaled identity. A score is the logistic of the
difference of the two Mahalanobis log densities plus the log prior odds; the
Cholesky factors are computed once and shipped with the model.

Fitting sums first and second moments over every labelled row, so what reaches
the driver is one small matrix per class whatever the input's size.

Defined results: null and empty texts have the statistics of an empty text and
are scored like any other; rows of ``labels`` with a null id or label, or whose
id is unknown, teach nothing; several labels of one id each count; with labels
of a single class the score is that class's prior; with none it is 0.5. Equal
texts get equal scores; very long texts are read whole; an empty table gives no
rows. Only the named columns are read, so that further columns may have any name.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import in_arrow, materialise, table

FOLDS = 5
#: Labelled ids are broadcast up to this many, and shuffled beyond.
BROADCAST_IDS = 1_000_000
THRESHOLD = 0.3
#: Shrinkage towards the pooled covariance, then towards the identity.
TO_POOLED, TO_IDENTITY = 0.3, 0.05

STATISTICS = (
    "log_words", "log_lines", "log_word_chars", "symbols", "exclamations", "pipes", "upper", "digits",
    "type_token", "short_words", "stops", "commas", "repeated_lines", "bigram_types", "non_ascii", "long_words",
)
SYMBOLS = b"#*$%&<>{}[]~^=\\"
_TABLES = {name: bytes(b for b in range(256) if b not in chars) for name, chars in {
    "symbols": SYMBOLS, "exclamations": b"!?", "pipes": b"|", "upper": string.ascii_uppercase.encode(), "digits": string.digits.encode(),
    "stops": b".", "commas": b",;:", "ascii": bytes(range(128)),
}.items()}
#: Shares are taken as if this many more words or characters of the usual make stood there, which keeps short texts near the middle.
USUAL_WEIGHT = 40


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of STATISTICS."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    some = max(1, n)
    count = {name: len(raw.translate(None, rest)) for name, rest in _TABLES.items()}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    lowered = raw.lower().split()
    lengths = [*map(len, words)]
    share = lambda k, usual, of=some: math.sqrt((k + USUAL_WEIGHT * usual) / (of + USUAL_WEIGHT))
    return [
        math.log(n + USUAL_WEIGHT),
        math.log((n + USUAL_WEIGHT) / (len(lines) + USUAL_WEIGHT / 20)),
        math.log((chars + USUAL_WEIGHT * 5.5) / (n + USUAL_WEIGHT)),
        share(count["symbols"], 0),
        share(count["exclamations"], 0),
        share(count["pipes"], 0),
        share(count["upper"], 0.02, size),
        share(count["digits"], 0, size),
        math.log(some) * (1 - len({*lowered}) / some),
        share(sum(k <= 3 for k in lengths), 0.4),
        share(count["stops"], 0.1),
        share(count["commas"], 0.05),
        share(len(lines) - len({*lines}), 0, len(lines)),
        share(max(0, n - 1) - len({*zip(lowered, lowered[1:], strict=False)}), 0),
        share(len(raw) - count["ascii"], 0.02, size),
        share(sum(k > 20 for k in lengths), 0.01),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor and log determinant, in scaled statistics."""

    centre: np.ndarray
    scale: np.ndarray
    log_prior: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of raw statistics."""
        z = (x - self.centre) / self.scale
        density = [self.log_prior[c] - 0.5 * (np.square((z - self.means[c]) @ self.factors[c].T).sum(axis=1) + self.log_dets[c]) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """``moments``: label -> (rows, sum of x, sum of x xᵀ)."""
    d = len(STATISTICS)
    zero = (0.0, np.zeros(d), np.zeros((d, d)))
    both = [moments.get(c, zero) for c in (0, 1)]
    n = np.array([m[0] for m in both])
    total = max(1.0, n.sum())
    centre = sum(m[1] for m in both) / total
    var = np.diag(sum(m[2] for m in both)) / total - centre**2
    scale = np.sqrt(np.where(var > 1e-12, var, 1.0))
    means, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for c, (rows, first, second) in enumerate(both):
        if rows:
            mu = first / rows
            means[c] = (mu - centre) / scale
            scatter[c] = (second - rows * np.outer(mu, mu)) / np.outer(scale, scale)
    if not n.all():  # one class: equal densities leave its prior
        means[:] = 0
        scatter[:] = scatter.sum(axis=0)
    pooled = scatter.sum(axis=0) / total
    factors, log_dets = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        own = scatter[c] / n[c] if n.all() else pooled
        mixed = (1 - to_pooled) * own + to_pooled * pooled
        mixed = (1 - to_identity) * mixed + to_identity * max(np.trace(mixed) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(mixed)
        factors[c] = np.linalg.inv(factor)
        log_dets[c] = 2 * np.log(np.diag(factor)).sum()
    prior = (n + 1) / (n.sum() + 2)
    return Discriminant(centre, scale, np.log(prior), means, factors, log_dets)


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``x``: the statistics of each row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=[id_col, "x"])

    return in_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, x array<double>")


def class_moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Moments of ``rows`` (label int, x array<double>), one small record per task added up here."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                x = np.array(batch.column(1).to_pylist(), dtype=float)
                for c in np.unique(y):
                    part = x[y == c]
                    was = sums.setdefault(int(c), [0.0, np.zeros(d), np.zeros((d, d))])
                    was[0] += len(part)
                    was[1] = was[1] + part.sum(axis=0)
                    was[2] = was[2] + part.T @ part
        flat = {c: np.concatenate([[m[0]], m[1], m[2].ravel()]) for c, m in sums.items()}
        ks = [(c, k, v) for c, row in flat.items() for k, v in enumerate(row.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _, _ in ks], pa.int32()), pa.array([k for _, k, _ in ks], pa.int32()), pa.array([v for _, _, v in ks], pa.float64())], names=["label", "k", "v"]
        )

    cells = in_arrow(rows.select("label", "x"), run, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in cells:
        out.setdefault(r["label"], np.zeros(1 + d + d * d))[r["k"]] = r["v"]
    return {c: (float(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for c, v in out.items()}


def held_out(doc_id):
    """True for the fifth of all ids that never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def teaching(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the labelled rows that are not held out."""
    known = labels.select(F.col(id_col), F.col("quality").cast("int").alias("label"))
    return known.where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))


def fitted(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Discriminant:
    """The discriminant learnt from the labelled rows of ``stats`` that are not held out."""
    return fit(class_moments(stats.join(teaching(labels, id_col), id_col).select("label", "x")))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    ``labels`` needs the id and ``quality``. The statistics are computed in one
    pass over the texts and written out; fitting and scoring read them there.
    """
    spark = docs.sparkSession
    stats = materialise(statistics_table(docs, id_col), "quality-statistics")
    model = spark.sparkContext.broadcast(fitted(stats, labels, id_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(x), pa.float64())], names=[id_col, "score"])

    scored = in_arrow(stats.select(id_col, "x"), run, f"{id_col} {kind}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns.

    Rows are scored where they are. Statistics to learn from are taken of the
    labelled texts alone; ids are broadcast while they are few.
    """
    ids = teaching(labels, id_col).select(id_col).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    taught = docs.select(id_col, text_col).join(ids, id_col, "left_semi")
    model = docs.sparkSession.sparkContext.broadcast(fitted(statistics_table(taught, id_col, text_col), labels, id_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)], dtype=float).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.value.scores(x) >= threshold, pa.bool_()))

    return in_arrow(docs, run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
