import re
from collections import Counter

from stocktake.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_figures(spark, odd_docs, no_docs, prose):
    extra = spark.createDataFrame([(100, "a b c a b c a b\n" * 9 + "# * $x\n\n", "a"), (101, "a a a a a", "a"), (102, prose(5, 60) + "\n" + prose(5, 60), "s")], "doc_id bigint, text string, source string")
    docs = odd_docs.select("doc_id", "text", "source").unionByName(extra)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = q.judge_quality(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert q.judge_quality(no_docs).collect() == []


def test_lines_above_the_limit_deplete_a_document(spark, prose):
    shared = "\n".join(prose(900 + k, 12) for k in range(5))
    rows = [(k, shared + "\n" + prose(k, 10), "host") for k in range(25)]  # mostly shared lines
    rows += [(100 + k, shared + "\n" + prose(500 + k, 200), "host") for k in range(3)]  # much of its own
    rows += [(200 + k, shared + "\n" + prose(k, 10), "elsewhere") for k in range(3)]
    rows += [(300 + k, prose(77, 80), "copies") for k in range(40)]  # copies under other ids are documents of their own
    rows += [(None, prose(78, 80), "nameless") for k in range(40)]  # without ids, equal texts are one
    got = {r.doc_id: r for r in q.judge_quality(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(got[k].kept for k in range(25)) and got[3].n_removed_words == 60
    assert all(got[k].kept for k in [100, 101, 102, 200, 201, 202, None]) and not any(got[k].kept for k in range(300, 340))


def test_no_python_in_the_plan(odd_docs):
    plan = q.judge_quality(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
