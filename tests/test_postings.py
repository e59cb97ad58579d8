import os
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ranking
from sparkloom.operators.ingest import Store
from sparkloom.operators.postings import Index, index_of
from sparkloom.sources.versions import Versions

WORDS = [f"w{i}" for i in range(60)]


def texts(seed, n, first=0):
    rng = random.Random(seed)
    return [(first + i, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 60))), "ab"[i % 2]) for i in range(n)]


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame(rows, "id long, text string, kind string")


def same(index, now, few=True):
    """Searches of the index against those of the rows that it should hold."""
    for asked, limit, how in ((["w0", "W7", "w50"], 25, {"where": F.col("kind") == "a"}), (["w3"], 1000, {}), (["w0", "w5"], 9, {"must": ["w1"], "never": ["W2"]})):
        found = [tuple(r) for r in index.search(asked, limit, **how).collect()]
        assert found == [tuple(r) for r in ranking.bm25(now, "id", "text", asked, limit, **how).collect()]
    for words in (["w1", "w0", "w1"], ["none", "w0"]):
        assert sorted(r.id for r in index.phrase(words).collect()) == sorted(r.id for r in ranking.phrase(now, "id", "text", words).collect())


def test_index_equals_scans_through_changes(spark, docs, tmp_path):
    rows = [*texts(1, 300), (900, None, "a"), (901, "", "b"), (902, "W0 w0, w1. " + "x" * 50, "a")]
    index = Index(spark, str(tmp_path / "index"), "id", buckets=8, block=16)
    index.build(docs(rows), "text")
    same(index, docs(rows))
    index.FEW = 0  # the way for indexes whose blocks are too many for the driver
    same(index, docs(rows))
    index.FEW, index.MERGE = 20_000, 1
    held = {r[0]: r for r in rows}
    for step in range(2):  # base, change, change and merge
        new, gone = texts(10 + step, 40, 250 + 20 * step), [(i,) for i in range(7 * step, 7 * step + 30)]
        index.change(docs(new), "text", spark.createDataFrame(gone, "id long"))
        for (i,) in gone:
            held.pop(i, None)
        held |= {r[0]: r for r in new}
        same(index, docs(list(held.values())))
    assert index.layers() == [index.version()]
    index.delete(docs(list(held.values())).select("id"))
    assert index.search(["w0"], 5).collect() == [] and index.phrase(["w0"]).collect() == []


def test_a_search_opens_the_folders_of_its_terms_and_skips_blocks(spark, docs, tmp_path):
    rows = [(i, "common " * (1 + i % 3) + f"rare{i // 50} filler{i}", "a") for i in range(3000)]
    index = Index(spark, str(tmp_path / "index"), "id", buckets=16, block=32)
    index.build(docs(rows), "text")
    layers = index.layers()
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    assert size(index.terms(layers, ["common", "rare7"])) < size(index.of(layers, "postings")) / 4
    found = index.search(["common", "rare7"], 10)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in ranking.bm25(docs(rows), "id", "text", ["common", "rare7"], 10).collect()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    blocks = {int(x) for part in plan.split("block#")[1:] if " IN (" in part[:30] or "INSET" in part[:30] for x in part.split(")")[0].replace("INSET", "IN").split("IN")[-1].strip(" (").split(",") if x.strip().isdigit()}
    every = index.terms(layers, ["common"]).select("block").distinct().count()
    assert len(blocks) < every / 2


def test_index_of_a_table_is_built_once(spark, docs, tmp_path):
    docs(texts(3, 50)).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    one = index_of(spark, str(tmp_path), "documents", table, "text")
    assert index_of(spark, str(tmp_path), "documents", table, "text").folder == one.folder and one.version() == 1
    docs(texts(4, 5, 100)).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    newer = index_of(spark, str(tmp_path), "documents", table, "text")
    same(newer, table)
    for marker in ("base-1", "claim-1"):  # as a session that died leaves it
        path, fs = newer._path(marker)
        fs.delete(path, True) if marker == "base-1" else fs.createNewFile(path)
    assert index_of(spark, str(tmp_path), "documents", table, "text").folder != newer.folder


def test_empty_folders_old_folders_and_two_writers(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    ids = spark.createDataFrame([(1,)], "entry_id long")
    assert (store.delete(ids), store.clear(), store.reindex(), store.version(), store.counts()) == (0, 0, 0, 0, {"entries": 0, "chunks": 0, "terms": 0})
    index = Index(spark, str(tmp_path / "empty"), "id")
    assert index.delete(spark.createDataFrame([(1,)], "id long")) == 0
    index.build(docs([]), "text")
    assert index.search(["w0"], 3).collect() == [] and index.phrase(["w0", "w1"]).collect() == []
    rows = texts(5, 20)
    index.change(docs(rows), "text", docs([]).select("id"))
    same(index, docs(rows))
    old = tmp_path / "old"
    (old / "done-1").mkdir(parents=True)
    with pytest.raises(ValueError, match="no version with all rows"):
        Versions(spark, str(old), "id").version()
    two = Versions(spark, str(tmp_path / "two"), "id")
    two.write({"t": docs(rows)})
    (tmp_path / "two" / "claim-2").touch()
    with pytest.raises(RuntimeError, match="another writer"):
        two.write({"t": docs(rows)})
