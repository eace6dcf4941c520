import zlib

import numpy as np

from stocktake.llm import quality_classifier as q
from stocktake.llm.common import table


def test_density_against_the_formula():
    rng = np.random.default_rng(1)
    d = len(q.STATISTICS)
    x = {0: rng.normal(1, 2, (60, d)), 1: rng.normal(0, 1, (90, d))}
    model = q.fit({c: (float(len(v)), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    every = np.concatenate([x[0], x[1]])
    z = (every - every.mean(axis=0)) / every.std(axis=0)
    parts = {0: z[:60], 1: z[60:]}
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in parts.values()) / 150
    logs = []
    for c, v in parts.items():
        s = (1 - q.TO_POOLED) * np.cov(v.T, bias=True) + q.TO_POOLED * pooled
        s = (1 - q.TO_IDENTITY) * s + q.TO_IDENTITY * np.trace(s) / d * np.eye(d)
        gap = z - v.mean(axis=0)
        logs.append(np.log((len(v) + 1) / 152) - 0.5 * (np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap) + np.linalg.slogdet(s)[1]))
    assert np.allclose(model.scores(every), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    rows = q.score_quality(table(spark, sf, "documents"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    flipped = labels.withColumn("quality", (1 - labels.quality).cast("int")).where(q.held_out(labels.doc_id)).unionByName(labels.where(~q.held_out(labels.doc_id)))
    again = {r.doc_id: r.score for r in q.score_quality(table(spark, sf, "documents"), flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 1), (8, 0), (5, 0), (None, 1), (6, None), (999, 0)], "doc_id bigint, quality int")
    got = q.score_quality(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert q.score_quality(no_docs, labels).collect() == []
    none = q.score_quality(odd_docs, labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in none)
    assert q.keep_quality(odd_docs, labels, threshold=0.0).count() == odd_docs.count()
    assert q.keep_quality(no_docs, labels).collect() == []
