import public_tokenizers
from tokenizers import Tokenizer

from stocktake.llm import token_counts as t

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_agree_with_the_library():
    library = Tokenizer.from_file(PATH)
    mine = t.WholeTokenCounter(PATH, t.prove_whole_tokens(PATH))
    texts = ["", "Hello wörld's", "İ x", "Σας ΣΑΣ", "don't WE'LL 's 12³ ½", "<|endoftext|>a<|startoftext|><|endoftext|", "日本語 テスト", "a b c\x85d\x1cz", "—“quote”…", "😀😀", "x" * 5000, "ſ ŉ ß ẞ", "\x00\x01a"]
    assert [mine.count(x) for x in texts] == [len(library.encode(x, add_special_tokens=False)) for x in texts]


def test_every_shortcut_is_one_token():
    library = Tokenizer.from_file(PATH)
    proved = t.prove_whole_tokens(PATH)
    assert len(proved) > 30_000
    assert all(len(library.encode(x, add_special_tokens=False)) == 1 for x in proved[:2000] if x.isascii() and x.isalpha())


def test_odd_and_empty_tables(odd_docs, no_docs):
    library = Tokenizer.from_file(PATH)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in t.count_tokens(odd_docs, PATH).collect())
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False))
        want.append((r.doc_id or 0, len((r.text or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert t.count_tokens(no_docs, PATH).collect() == []
