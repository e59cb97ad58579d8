import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkloom.llm.queries import tokenizer
from sparkloom.llm.token_counts import TokenCounter, count_tokens

PATH = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def lengths(library, texts):
    return [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", " ", "a", "aaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>", "don't WE'LL 's", "ΑΣ ΣΑΣ", "İstanbul ǅ", "é é  x y", "日本語テキスト",
    "\x1c\x1fa\x85b", "👩‍👩‍👧 flags 🇩🇪", "123 4.5e6", "a" * 3000 + "b" * 3000, "̀ start", "___--__!!??", "ﬁ ½ ①", "퟿", "tab\tnew\nline\rret\x0b\x0c",
]


def test_odd_texts(library):
    assert TokenCounter(PATH)(ODD) == lengths(library, ODD)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=30), min_size=1, max_size=6))
def test_any_text(library, texts):
    assert TokenCounter.of(PATH)(texts) == lengths(library, texts)


def test_tables(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = dict(zip(texts, lengths(library, list(texts.values())), strict=True))
    for r in count_tokens(docs, PATH).collect():
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len(texts[r.doc_id].encode()), want[r.doc_id] > 2048)


def test_nulls_repeats_and_empty(documents, rows):
    docs = documents((1, None), (1, None), (None, "hello hello"), extra=True)
    assert rows(count_tokens(docs, PATH), "doc_id", "n_bytes", "n_tokens", "over_limit") == [(1, 0, 0, False), (1, 0, 0, False), (None, 11, 2, False)]
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_forgetting_changes_nothing(library):
    small = TokenCounter(PATH, remember=3)
    texts = ["one two three four five", "six seven one", "eight nine ten eleven one"]
    assert [small([t])[0] for t in texts] == lengths(library, texts)


def test_code_points(library):
    """Doubled before a sign, and between letters: a third of what Unicode 15 leaves unassigned, and every 11th other."""
    counter = TokenCounter(PATH)
    points = [chr(i) for i in range(128, 0x33480) if not 0xD800 <= i < 0xE000 and (i < 0x20000 and unicodedata.category(chr(i)) == "Cn" and i % 3 == 0 or i % 11 == 0)]
    for k in range(0, len(points), 10_000):
        some = points[k : k + 10_000]
        texts = [f"{c}{c}!" for c in some] + [f"a{c}b 1{c}" for c in some]
        assert counter(texts) == lengths(library, texts)
    assert "\ua7cb" in counter.odd_ones or counter(["\ua7cb\ua7cb!"]) == lengths(library, ["\ua7cb\ua7cb!"])
