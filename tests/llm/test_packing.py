import zlib

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkloom.llm.packing import ByteIds, difference, pack_documents, pack_sizes, sequences
from sparkloom.llm.queries import byte_level, tokenizer

ODD = ["", " ", "a  b", "a \n b\n \n c ", "\n\n", "x<|endoftext|>y", "<|endoftext|><|endoftext|> ", "don't  stop", "é́   x", "日本 語", "1234 5 67", " lead", "trail ", "a  b", "\x1c \x1fa", "tab\t \tx"]


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


def ids(text):
    return np.frombuffer(ByteIds.of(byte_level())(text), "<u4").tolist()


def test_ids_are_the_tokenizers():
    assert [ids(t) for t in ODD] == library(ODD)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\ta'1.")), max_size=30), min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    assert [ids(t) for t in texts] == library(texts)


def check(docs, texts, window=2048):
    """texts: id to text; every id in exactly one piece, windows gapless and within their capacity."""
    got = pack_documents(docs, byte_level(), window, with_ids=True)
    pieces = got.toPandas()
    want = {d: i + [1] for d, i in zip(texts, library(list(texts.values())), strict=True)}
    for d, its in pieces.groupby("doc_id"):
        its = its.sort_values("start")
        whole = np.concatenate([np.frombuffer(x, "<u4") for x in its["ids"]]).tolist()
        assert whole == want[d] and (its["doc_tokens"] == len(want[d])).all()
        assert its["start"].tolist() == [0, *its["length"].cumsum().tolist()[:-1]]
        assert [zlib.crc32(x) for x in its["ids"]] == its["ids_crc32"].tolist()
    assert set(pieces["doc_id"]) == set(want)
    size = pieces.groupby("sequence_id")["length"].sum()
    assert size.max() <= window
    for _, its in pieces.sort_values("offset").groupby("sequence_id"):
        assert its["offset"].tolist() == [0, *its["length"].cumsum().tolist()[:-1]]
    made = {r.sequence_id: r for r in sequences(got).collect()}
    assert {k: len(r.ids) // 4 for k, r in made.items()} == size.to_dict()
    return size


def test_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    size = check(docs, {r.doc_id: r.text or "" for r in docs.collect()})
    assert (2048 - size).sum() / size.sum() < 0.02


def test_small_windows_nulls_long_texts(documents):
    texts = {0: "", 1: "a b c " * 5000, 2: "word", 3: "x" * 3000, **{i: "tok " * (i % 9) for i in range(4, 60)}}
    check(documents(*[(d, t or None) for d, t in texts.items()], extra=True), texts, window=64)


def test_repeated_rows_and_empty_table(documents):
    docs = documents((1, "same"), (1, "same"))
    assert pack_documents(docs, byte_level()).count() == 2
    assert pack_documents(docs.limit(0), byte_level()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_windows_hold_everything(sizes):
    sizes = np.array(sizes)
    at = pack_sizes(sizes, 64)
    assert np.bincount(at, sizes).max() <= 64 and len(at) == len(sizes)


def test_differencing_balances_better_than_first_fit():
    sizes = np.random.default_rng(0).integers(1, 256, 1000)
    sums = np.bincount(difference(sizes, 60), sizes, 60)
    assert sums.max() - sums.min() <= 2
