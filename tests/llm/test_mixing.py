from collections import defaultdict

from stocktake.llm import mixing as m


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        budget = left - sum(2 * sizes[s] for s in capped)
        level = budget / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def test_targets_and_sums(spark, odd_docs, prose):
    rows = [(k, prose(k, 5 + k * 7 % 90), f"s{k % 7}" if k % 11 else None) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = m.mix(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-9
        assert abs(taken[s] - want[s]) < 0.02 * want[s] + 100
    again = m.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_copies_are_the_boundaries_crossed(spark, prose):
    docs = spark.createDataFrame([(k, "w " * 8, "one") for k in range(500)] + [(1000, "w " * 2000, "two")], "doc_id bigint, text string, source string")
    got = [r for r in m.mix(docs).collect() if r.source == "one"]
    rate = got[0].target / got[0].source_size
    assert abs(sum(r.copies for r in got) - 500 * rate) < 1
    assert {r.copies for r in got} <= {int(rate), int(rate) + 1}


def test_odd_and_empty_tables(odd_docs, no_docs):
    got = m.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.taken == 0 for r in got if not r.size)
    assert m.mix(no_docs).collect() == []
    mixed = m.mixed_documents(odd_docs)
    assert mixed.columns == [*odd_docs.columns, "copy"]
    assert mixed.count() == sum(r.copies for r in got)
    assert m.mixed_documents(no_docs).collect() == []


def test_nulls_by_place_are_told_apart(spark):
    rows = [(1, None, "a"), (1, "a", None), (2, "b", "one two"), (2, "b", "one two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    from stocktake.llm.common import row_mark

    assert docs.select(row_mark(docs, "doc_id", "source", "text").alias("m")).distinct().count() == 3
