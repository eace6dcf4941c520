from stocktake.llm import decontamination as d

ITEM = "When Alice walks 5 km in 2 hours before lunch and then rests at home, how far did she go until Alice slept?"


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def _items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def test_reparameterised_questions_are_found(spark, prose):
    other = ITEM.replace("Alice", "Carol").replace("5", "70").replace("2 ", "31 ")
    docs = _docs(spark, prose(1, 40) + " " + ITEM, prose(2, 40) + " " + other + " " + prose(3, 30), prose(4, 200), None, "")
    got = {(r.doc_id, r.item_id): r.n_changed for r in d.find_leaks(docs, _items(spark, ITEM, None, "", "a b")).collect()}
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0] == 0 and got[1, 0] > 0


def test_slots_must_be_consistent(spark):
    item = "the cost of 5 apples and pears is 5 coins in the old market by the river"
    docs = _docs(spark, item.replace("5", "8"), item.replace("5", "8", 1).replace("is 5", "is 9"))
    rows = {r.doc_id: r.n_found for r in d.find_leaks(docs, _items(spark, item)).collect()}
    assert 0 in rows and 1 not in rows


def test_broadcast_and_shuffle_agree(spark, odd_docs, prose):
    items = _items(spark, prose(1, 30), prose(7, 50), "x y z", "two words")
    one = sorted(map(tuple, d.find_leaks(odd_docs, items).collect()), key=str)
    two = sorted(map(tuple, d.find_leaks(odd_docs, items, broadcast_windows=0).collect()), key=str)
    assert one == two
    assert {(r[0], r[1]) for r in one} >= {(1, 0), (10, 0), (7, 1), (12, 1)}


def test_empty_tables(spark, no_docs, odd_docs):
    assert d.find_leaks(no_docs, _items(spark, ITEM)).collect() == []
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.find_leaks(odd_docs, none).collect() == []
    assert d.drop_leaks(odd_docs, none).count() == odd_docs.count()


def test_no_python_in_the_plan(spark, odd_docs):
    plan = d.find_leaks(odd_docs, _items(spark, ITEM))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_short_and_slot_heavy_items_go_by_their_words(spark, prose):
    items = _items(spark, "Define osmosis", "What is 3 + 5 ?", "Compute 12 + 30 - 7 * 4", "word")
    docs = _docs(spark, prose(1, 9) + " Define osmosis. " + prose(2, 9), "What is 4 + 9 ?", "Now what is 3 + 5 ? Nobody knows", "Compute 12 + 30 - 7 * 4", "Compute 13 + 30 - 7 * 4", "a word")
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, items).collect()} == {(0, 0), (2, 1), (3, 2)}


def test_names_open_sentences_and_stay_apart(spark):
    item = "Ben lent 4 books to Ada. Ada read 3 of them before the long winter holiday ended"
    other = item.replace("Ben", "Tom").replace("Ada", "Eva").replace("4", "9")
    docs = _docs(spark, "so it goes. " + other, other.replace("Eva", "Tom"))
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, _items(spark, item)).collect()} == {(0, 0)}


def test_leaking_rows_go_and_others_keep_their_columns(spark, odd_docs, prose):
    kept = d.drop_leaks(odd_docs, _items(spark, prose(1, 80)))
    assert kept.columns == odd_docs.columns
    want = [r for r in odd_docs.collect() if r.text != prose(1, 80)]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want)) and len(want) == odd_docs.count() - 3
