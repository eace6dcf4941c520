import math
import zlib
from collections import Counter

import numpy as np
import pytest

from stocktake.llm import lm_scoring as m


def brute(docs, good):
    """Losses of rows (id, text) by plain counting."""
    rows = [(k, (t or "").lower().split()) for k, t in docs]
    total = sum(len(ws) for _, ws in rows)

    def model(taken, out=0):
        n, u = Counter(), Counter()
        for ws in taken:
            u.update(ws)
            u[None] += bool(ws)
            n.update(zip([None, *ws], ws, strict=False))
        size = sum(map(len, taken)) - out

        def loss(a, b):
            if not size:
                return math.log(total)
            x, h, w = n[a, b] - out, u[a] - out, u[b] - out
            seen = m.BIGRAM * x / h + m.UNIGRAM * w / size if h else (m.BIGRAM + m.UNIGRAM) * w / size
            return -math.log(seen + m.FLOOR / total)

        return loss

    half = lambda k: zlib.crc32(str(k).encode()) % 2
    back = model([ws for _, ws in rows], 1)
    target = {x: model([ws for k, ws in rows if k in good and (x is None or half(k) != x)]) for x in (None, 0, 1)}
    out = []
    for k, ws in rows:
        pairs = list(zip([None, *ws], ws, strict=False))
        loss = target[half(k) if k in good else None]
        out.append((k, len(ws), *[sum(f(*p) for p in pairs) / len(ws) if ws else None for f in (loss, back)]))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[3] or 0)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for r, w in zip(got, want, strict=True):
        assert r[:2] == w[:2] and all(x == y if y is None else x == pytest.approx(y, rel=1e-9) for x, y in zip(r[2:4], w[2:4], strict=True)), (r, w)
        assert r[4] is None if w[2] is None else r[4] == pytest.approx(w[2] - w[3], abs=1e-9)


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 700, "bucket_grams": 40, "broadcast_targets": 0}])
def test_losses_against_brute_force(spark, prose, options):
    docs = [(k, prose(k, 100) + f" rare{k} rare{k % 7} word{k} rare{k}") for k in range(40)] + [(70, None), (71, ""), (72, "Unseen words ONLY"), (3, prose(3, 60)), (3, prose(3, 60)), (None, prose(4, 30))]
    docs += [(200 + k, " ".join(f"w{k}x{i}" for i in range(60))) for k in range(20)]  # words that occur once
    good = [0, 1, 2, 3, 5, 9, 11, 70, 205, 206]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    targets = spark.createDataFrame([(g,) for g in [*good, 5, None]], "doc_id bigint")
    same(m.score_documents(df, targets, **options).collect(), brute(docs, good))


def test_documents_that_occur_twice_stand_apart(spark, prose):
    alone = [(k, " ".join(f"v{k}x{i} the of" for i in range(50))) for k in range(30)]
    twice = [(100 + k + 50 * c, " ".join(f"t{k}x{i} the of" for i in range(50))) for k in range(5) for c in range(2)]
    good = spark.createDataFrame([(999,)], "doc_id bigint")
    got = {r.doc_id: r.score for r in m.score_documents(spark.createDataFrame([*alone, *twice, (999, "the of the of and the")], "doc_id bigint, text string"), good).collect()}
    assert min(got[k] for k, _ in twice) > max(got[k] for k, _ in alone)


def test_blocks_go_round():
    rng = np.random.default_rng(1)
    for n in (1, 2, 999):
        keys = np.unique(rng.integers(0, 1 << m.SHORT, n)) + (5 << m.SHORT)
        assert (m.unpacked(m.packed(keys)) == keys % (1 << m.SHORT)).all()
        counts = rng.choice([1, 2, 254, 255, 256, 10**12], n)
        assert (m.unpacked_counts(m.packed_counts(counts), n) == counts).all()
    assert m.unpacked(m.packed(np.zeros(1, np.int64))).tolist() == [0]


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    good = spark.createDataFrame([(1,), (None,)], "doc_id bigint")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    same(m.score_documents(odd_docs, good).collect(), brute(rows, [1]))
    same(m.score_documents(odd_docs, good.limit(0)).collect(), brute(rows, []))
    assert m.score_documents(no_docs, good).collect() == []
