import random
import re

import numpy as np
import pytest

from stocktake.llm import jaccard_join as j


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), (least.get(find(k)) if s else i)) for k, (i, s) in enumerate(sets)]


def edited(text, k, seed):
    words = text.split()
    rnd = random.Random(seed)
    for at in rnd.sample(range(len(words)), k):
        words[at] = f"w{rnd.random()}"
    return " ".join(words)


def test_components_against_brute_force(spark, prose):
    rows = [(k, prose(k, 40 + k)) for k in range(30)]
    base = prose(1000, 200)
    rows += [(100 + k, edited(base, 1 + k % 6, k)) for k in range(60)]  # a group of near copies, some beyond reach
    rows += [(200 + k, base) for k in range(5)]
    passage = prose(2000, 60)
    rows += [(300 + k, passage + " " + prose(3000 + k, 5 + k % 12)) for k in range(70)]  # a passage many share, around the threshold
    rows += [(400, "A b C"), (401, "a B c"), (402, "a b c d"), (403, None), (404, " \n"), (None, base), (None, "a b c d"), (405, None), (7, prose(7, 47))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, j.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted(brute(rows), key=str)


@pytest.mark.parametrize("block", [8, 32])
def test_large_cells_are_tiled(spark, prose, monkeypatch, block):
    monkeypatch.setattr(j, "BLOCK", block)
    monkeypatch.setattr(j, "LEAF", 4)
    monkeypatch.setattr(j, "PARTNERS", 8)
    monkeypatch.setattr(j, "HOT_LEVEL", 2)
    monkeypatch.setattr(j, "COMMON_IN_TASK", 2 if block == 32 else 10**9)
    passage = prose(2000, 60)
    rows = [(k, passage + " " + prose(3000 + k, 5 + k % 12)) for k in range(80)]
    base = prose(1000, 300)
    rows += [(100 + k, edited(base, 1 + k % 7, k)) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, j.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(brute(rows))


def sets_of_a_group(seed, n, size):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size).astype(np.uint64)
    return [np.unique(np.concatenate([rng.permutation(base)[: int(size * rng.uniform(0.6, 1))], rng.integers(0, 2**63, int(rng.integers(0, 1 + size // 4))).astype(np.uint64)])) for _ in range(n)]


def test_tree_finds_every_pair_within_the_bound(monkeypatch):
    monkeypatch.setattr(j, "LEAF", 8)
    sets = sets_of_a_group(5, 90, 120) + sets_of_a_group(6, 60, 130)
    n = np.array([len(x) for x in sets])
    points = j.Points([j.point_of(x) for x in sets], n)
    low = int(points.level.min())
    x = points.at_level(np.arange(len(n)), low)
    u, v = j.tree_pairs(x, n, lambda a, b: np.ones(len(a), bool))
    want = {(a, b) for a in range(len(n)) for b in range(a) if np.minimum(x[a], x[b]).sum() >= j.needed(n[a], n[b])}
    assert {(max(p), min(p)) for p in zip(u.tolist(), v.tolist(), strict=True)} == want and len(want) >= 100 and len(want) < len(n) * (len(n) - 1) // 2


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(300):
        n = int(rng.integers(1, 4000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sets += [a, np.unique(np.concatenate([a[: max(1, int(len(a) * rng.uniform(0.7, 1)))], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))]
    sets += [np.arange(200_000, dtype=np.uint64) * np.uint64(4096), np.arange(190_000, dtype=np.uint64) * np.uint64(4096)]  # counts beyond two bytes
    n = np.array([len(x) for x in sets])
    points = j.Points([j.point_of(x) for x in sets], n)
    u, v = np.arange(0, len(n), 2), np.arange(1, len(n), 2)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(u, v, strict=True)])
    bound = points.overlap(u, v)
    assert (bound >= both).all()
    linked = 100 * both >= 80 * (n[u] + n[v] - both)
    assert (both >= j.needed(n[u], n[v]))[linked].all() and linked.sum() > 100


def test_odd_and_empty_tables(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, j.jaccard_components(odd_docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert j.jaccard_components(no_docs).collect() == []
    kept = j.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "None", "11"])
    assert j.keep_one_of_each(no_docs).collect() == []
