import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparkloom.engine import Engine
from sparkloom.operators.ingest import Store, build
from sparkloom.sources import tables


def test_entry_runs_and_queries_have_sql(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_modes_and_pages(spark, data):
    engine = Engine(spark, data)
    vector = engine.vector_of("the river")
    for how in ({"terms": ["the", "of"], "mode": "text"}, {"vector": vector, "mode": "vector"}, {"terms": ["the"], "vector": vector}):
        first, second = (engine.search(**how, limit=5, offset=o).collect() for o in (0, 5))
        assert len(first) == len(second) == 5 and not {tuple(r) for r in first} & {tuple(r) for r in second}
    only = engine.search(vector=vector, mode="vector", limit=5, where=F.col("entry_type") == "de")
    kinds = {r.entry_type for r in only.join(engine.entries, "entry_id").collect()}
    assert kinds <= {"de"}
    with pytest.raises(ValueError):
        engine.search()
    with pytest.raises(ValueError):
        engine.search(["x"], mode="other")


def test_other_methods(spark, data):
    engine = Engine(spark, data)
    assert 0 not in {r.entry_id for r in engine.related(0, 5).collect()}
    assert engine.document(0).first().chunks == [0, 1, 2, 3, 4]
    assert engine.list_entries("en", limit=3).count() == 3
    assert engine.categories().count() > 3 and engine.stats().count() > 3
    assert engine.board(("O", "F", "P")).columns == ["lane", "O", "F", "P", "total"]
    assert engine.sql("SELECT count(*) AS n FROM entries WHERE entry_type = :t", {"t": "en"}).first().n > 0
    assert engine.children("0/0").count() <= 1


def test_store_replaces_deletes_and_reindexes(spark, data, tmp_path):
    pages = tables.pages(spark, data).limit(12).select("page_id", "url", "html")
    store = Store(spark, str(tmp_path / "store"))
    assert store.version() == 0
    store.replace(build(pages, 16))
    before = store.counts()
    assert before["entries"] == 12 and before["chunks"] > 0
    store.replace(build(pages, 16))
    assert store.counts() == before
    store.delete(store.read("entries").select("entry_id").orderBy("entry_id").limit(2))
    assert store.counts()["entries"] == 10
    assert store.reindex() == store.version() and store.counts()["terms"] > 0
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    store.ingest_stream(stream, str(tmp_path / "checkpoint"), dim=16)
    assert store.counts() == before
    store.clear()
    assert set(store.counts().values()) == {0}


def test_store_reads_changes_over_a_base_and_merges_them(spark, data, tmp_path):
    pages = tables.pages(spark, data).orderBy("page_id").limit(6).select("page_id", "url", "html")
    store, built = Store(spark, str(tmp_path / "store")), build(pages, 8)
    store.MERGE = 2
    store.replace(built)
    first = {r.entry_id for r in store.read("entries").collect()}
    one = built.entries.orderBy("entry_id").limit(1).select("entry_id")
    gone = one.first().entry_id
    columns = store.read("chunks").columns
    for _ in range(2):  # layers: base, change, change, merged base, ...
        store.delete(one)
        assert {r.entry_id for n in store.TABLES for r in store.read(n).select("entry_id").collect()} == first - {gone}
        assert len(store._layers()) <= store.MERGE + 1
        store.replace(build(pages.filter(F.col("page_id") == gone), 8))
        assert {r.entry_id for r in store.read("entries").collect()} == first
        assert store.read("chunks").columns == columns and store.read("chunks").count() == built.chunks.count()
        assert store.read("terms").count() == built.terms.count()
    # A change holds the touched entry alone.
    store._write({n: store.read(n) for n in store.TABLES})
    n = store.replace(build(pages.filter(F.col("page_id") == gone), 8))
    assert [r.entry_id for r in spark.read.parquet(f"{store.folder}/v{n}/entries").collect()] == [gone]


def test_related_to_text_and_tables(spark, data):
    engine = Engine(spark, data)
    assert engine.related_to_text("a title", None, "a text", limit=3).count() == 3
    assert engine.related_to_text(" ", "").count() == 0
    assert {r["table"] for r in engine.tables().collect()} >= {"documents", "pages", "events"}
