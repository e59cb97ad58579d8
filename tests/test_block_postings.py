"""Postings made a block at a time: equal to plain counting, and blocks of bounded bytes."""

import random
from collections import defaultdict

import pyarrow as pa

from sparkloom.operators.postings import Index, block_postings


def test_a_block_equals_plain_counting():
    rng = random.Random(3)
    docs = [(rng.choice([*range(12), None]), [rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 5, 5, 9]))]) for _ in range(40)]
    found = block_postings(pa.table({"block": [7] * 40, "id": pa.array([k for k, _ in docs], pa.int64()), "words": pa.array([w for _, w in docs], pa.list_(pa.string()))}))
    want = defaultdict(lambda: defaultdict(list))
    for key, words in docs:
        for i, w in enumerate(words):
            want[w][key, len(words)].append(i)
    got = {}
    for r in found.to_pylist():
        assert r["block"] == 7 and r["n"] == len(r["ids"]) and r["most"] == max(r["tfs"]) and r["least"] == min(r["lens"]) and r["tfs"] == [len(p) for p in r["places"]]
        got[r["term"]] = dict(zip(zip(r["ids"], r["lens"]), r["places"], strict=True))
    assert got == {w: {k: sorted(p) for k, p in of.items()} for w, of in want.items()}
    assert len(block_postings(pa.table({"block": [1], "id": [1], "words": pa.array([[]], pa.list_(pa.string()))}))) == 0


def test_long_texts_share_no_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Index, "BYTES", 2000)
    docs = spark.createDataFrame([(i, f"w{i % 5} " + "of and of " * 95) for i in range(40)], "entry_id long, content string")
    index = Index(spark, f"{tmp_path}/i")
    index.build(docs, "content")
    blocks = index.of(index.layers(), "postings").filter("term = 'of'")
    assert blocks.count() > 10 and blocks.selectExpr("sum(n)").first()[0] == 40
    index.change(docs.filter("entry_id < 10").replace(0, 0), "content", docs.filter("entry_id >= 35").select("entry_id"))
    assert index.phrase(["of", "and", "of"]).count() == 35
    assert index.of(index.layers()[1:], "left").filter("term = 'and'").first()["n"] == 15
