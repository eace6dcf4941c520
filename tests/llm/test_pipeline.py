import corpus_pipeline as c
from stocktake.llm.common import table


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "jaccard_join", "decontamination", "pii", "mixing"]
    for name, stage in c.STAGES[:-1]:
        docs = c.materialise(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= seen
        seen = now
    mixed = c.STAGES[-1][1](spark, docs, sf)
    assert mixed.columns == [*columns, "copy"]
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, c.run(spark, sf).collect()))


def test_no_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []


def test_one_row_of_each_group_stays(spark, odd_docs, prose):
    """Near copies, repeated rows, nulls and clashing columns, against groups made by hand."""
    from stocktake.llm.jaccard_join import keep_one_of_each

    more = [(20 + k, prose(50, 200) + f" tail {k % 3}", "q") for k in range(40)] + [(None, prose(50, 200), "r"), (70, prose(70, 90), "r"), (70, prose(70, 90), "r")]
    docs = odd_docs.select("doc_id", "text", "source", "id", "key", "node", "n", "_key").withColumn("_mark", odd_docs["n"]).withColumn("_stays", odd_docs["n"])
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string, source string"), allowMissingColumns=True)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == [(False, k) for k in (1, 2, 3, 4, 5, 6, 7, 8, 11, 20, 70)] + [(True, 0)]


def test_redaction_leaves_other_rows_alone(spark, prose):
    from stocktake.llm.pii import redact

    rows = [(k, prose(k, 30) + (f" mail u{k}@x.com end" if k % 4 == 0 else "")) for k in range(60)] + [(4, prose(4, 30) + " mail u4@x.com end"), (None, "a@b.c"), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    import re

    want = sorted((str(k), None if t is None else re.sub(r"\S+@\S+", "[EMAIL]", t)) for k, t in rows)
    assert sorted((str(r.doc_id), r.text) for r in redact(docs).collect()) == want
