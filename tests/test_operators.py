import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import maintain, ranking, sqlgate, stats, trees, vectors
from sparkloom.streaming import jobs


def test_knn_and_dimension(spark):
    c = spark.createDataFrame([(i, i, 0, 0, [v] * 4) for i, v in ((1, 0.1), (2, 0.2), (3, 0.9))], "chunk_id long, entry_id long, chunk_index int, chunk_type int, vector array<float>")
    assert [r.chunk_id for r in vectors.top_k(c, [0.1] * 4, 2).collect()] == [1, 2]
    assert [r.chunk_id for r in vectors.top_k(c, [0.1] * 4, 9).collect()] == [1, 2, 3]
    q = c.select(F.col("chunk_id").alias("query_id"), "vector")
    assert sorted((r.query_id, r.chunk_id) for r in vectors.batch_top_k(c, q, 1, block=2, query_block=2, drop_self=True).collect()) == [(1, 2), (2, 1), (3, 2)]
    with pytest.raises(Exception, match="expected 5 numbers"):
        c.select(vectors.check_dimension(F.col("vector"), 5)).collect()
    with pytest.raises(ValueError):
        vectors.vector_of(c, 99)


def test_knn_ties_go_to_the_smaller_ids(spark):
    """100 equal vectors, and distances that differ only beyond six digits: the smaller ids, however many tie."""
    made = [(i, [0.5, 0.5]) for i in range(199, 99, -1)] + [(i, [3.0, i * 1e-9]) for i in range(60, 20, -1)] + [(1, [9.0, 9.0])]
    c = spark.createDataFrame(made, "chunk_id long, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(105, [0.5, 0.5]), (7, [3.0, 0.0])], "query_id long, vector array<double>")
    for own, first in ((False, [100, 101, 102, 103, 104, 105]), (True, [100, 101, 102, 103, 104, 106])):
        found = vectors.batch_top_k(c, q, 6, drop_self=own).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.chunk_id, r.distance) for r in found] == [(7, i, 0.0) for i in range(21, 27)] + [(105, i, 0.0) for i in first]


@pytest.mark.parametrize(("score", "want"), [(0.9, "strong"), (0.75, "strong"), (0.7, "moderate"), (0.55, "weak")])
def test_strength(spark, score, want):
    assert spark.range(1).select(vectors.strength(F.lit(score))).first()[0] == want


ENTRIES = [(1, "Message Router", "routes a message to channels"), (2, "Message Filter", "drops a message"), (3, "Aggregator", "collects things")]


def test_bm25_operators(spark):
    e = spark.createDataFrame(ENTRIES, "id long, title string, body string").withColumn("text", F.concat_ws(" ", "title", "body"))
    found = lambda *t, **k: [r.id for r in ranking.bm25(e, "id", "text", t, 10, **k).collect()]
    assert found("router")[0] == 1 and found("nothing") == []
    assert set(found("message")) == {1, 2}
    assert found("message", must=["router"]) == [1] and found("message", never=["router"]) == [2]
    assert found("message", where=F.col("id") == 2) == [2]
    assert [r.id for r in ranking.phrase(e, "id", "text", ["a", "message", "to"]).collect()] == [1]


def test_fusion_modes(spark):
    v = spark.createDataFrame([(10, 1, 0.1), (11, 1, 0.2), (20, 2, 0.3)], "chunk_id long, entry_id long, distance double")
    t = spark.createDataFrame([(2, 9.0), (3, 5.0)], "entry_id long, score double")
    first = spark.createDataFrame([(3, 30), (2, 20)], "entry_id long, chunk_id long")
    assert [(r.chunk_id, r.score) for r in ranking.fuse(v, t, 10).collect()] == [(20, round(1 / 62 + 1 / 60, 9)), (10, round(1 / 60, 9)), (11, round(1 / 61, 9))]
    assert [r.chunk_id for r in ranking.fuse(v, t, 10, first).collect()] == [20, 10, 11, 30]


def test_text_score_and_excerpt(spark):
    df = spark.createDataFrame([("Router", None), ("The Router Book", "all about it"), ("Other", "a router here")], "t string, b string")
    a, b, c = (r[0] for r in df.select(ranking.text_score("router", F.col("t"), F.col("b"))).collect())
    assert a == 1.0 and 0 < b < 1 and c == pytest.approx(0.3)
    text = "x" * 80 + "needle" + "y" * 80
    assert spark.range(1).select(ranking.excerpt(F.lit(text), "needle", 5)).first()[0] == "...xxxxxneedleyyyyy..."
    assert spark.range(1).select(ranking.excerpt(F.lit("short"), "needle", 5)).first()[0] == "short"


def test_pages_of_results(spark):
    rows = spark.range(300)
    size = lambda *a: ranking.page(rows, [F.col("id")], *a).count()
    assert (size(), size(500, None), size(5, 298), size(0, 0)) == (10, 100, 2, 0)


def test_trees_with_orphans_and_circles(spark):
    items = [("e", None, 0), ("s", "e", 0), ("t", "s", 1), ("u", "t", 2), ("o", "gone", 0), ("x", "y", 0), ("y", "x", 0)]
    df = spark.createDataFrame(items, "item_id string, parent_id string, position int")
    found = {r.item_id: (r.root_id, r.depth) for r in trees.roots(df).collect()}
    assert {k: found[k] for k in "estuo"} == {"e": ("e", 0), "s": ("e", 1), "t": ("e", 2), "u": ("e", 3), "o": ("o", 0)}
    assert found["x"][1] is None and found["y"][1] is None
    assert [(r.parent_id, r.child_id) for r in trees.children(df).orderBy("child_id").collect()] == [("e", "s"), ("s", "t"), ("t", "u"), ("y", "x"), ("x", "y")]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in trees.reach(links, seeds, 9).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert trees.reach(links, seeds, 9, most=3).count() == 3


def test_board_drops_unknown_columns(spark):
    df = spark.createDataFrame([(1, "l", "todo"), (2, "l", "done"), (3, "l", "odd"), (4, "m", "done")], "number int, lane string, column string")
    assert sorted(tuple(r) for r in trees.board(df, ("todo", "done"), F.count("number"), ("todo", "done")).collect()) == [("l", 1, 1, 2), ("m", 0, 1, 1)]


def test_maintenance(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in maintain.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in maintain.difference(new, old, "k", "v").collect()) == [(1, "delete"), (2, "update"), (3, "add")]
    changes = spark.createDataFrame([(1, None), (2, "z")], "k int, v string")
    assert sorted(tuple(r) for r in maintain.update(old, changes, "k").collect()) == [(1, "a"), (2, "z")]
    at = lambda a, b: [spark.range(6).select(maintain.moved(F.col("id"), a, b)).collect()[i][0] for i in range(6)]
    assert at(1, 4) == [0, 4, 1, 2, 3, 5] and at(4, 1) == [0, 2, 3, 4, 1, 5]


def test_sql_gate(spark):
    kinds = ["SELECT 1", " with x as (select 1) select * from x", "-- c\n/* d */ Insert into t", "update t", "DELETE from t", "drop table t", "create table t", "alter table t", "pragma x", ""]
    assert [sqlgate.statement_kind(k) for k in kinds] == ["select", "select", "insert", "update", "delete", "drop", "create", "alter", "other", "other"]
    assert [r[0] for r in sqlgate.run_safely(spark, "SELECT id FROM range(10) WHERE id > :x ORDER BY id", {"x": 3}, limit=2, offset=1).collect()] == [5, 6]
    for bad in ("DROP TABLE t", "INSERT INTO t VALUES (1)"):
        with pytest.raises(PermissionError):
            sqlgate.run_safely(spark, bad)
    spark.range(5).createOrReplaceTempView("five")
    assert [r[0] for r in sqlgate.browse(spark, "five", 2, 1, "id", True).collect()] == [3, 2]
    assert sqlgate.describe(spark, "five")[0][:2] == ("id", "bigint")
    with pytest.raises(ValueError):
        sqlgate.browse(spark, "five; drop")


def test_health_and_breakdown(spark):
    pick = lambda a, b: spark.range(1).select(stats.health(F.lit(a), F.lit(b))).first()[0]
    assert (pick(0, 0), pick(1, 0), pick(1, 1)) == ("empty", "degraded", "healthy")
    df = spark.createDataFrame([("a", None), ("a", "x")], "t string, d string")
    assert sorted(tuple(r) for r in stats.breakdown(df, type="t", domain="d").collect()) == [("domain", "x", 1), ("type", "a", 2)]


def test_rates_and_progress(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 7, "view", t0 + dt.timedelta(seconds=s), 1.0) for i, s in enumerate((0, 30, 61, 61, 500))]
    e = spark.createDataFrame(rows, "event_id long, job_id long, state string, ts timestamp, value double")
    assert [(r.samples, r.rate) for r in jobs.rate(e).orderBy("event_id").collect()] == [(1, 0.0), (2, round(2 / 30, 6)), (3, round(3 / 31, 6)), (3, round(3 / 31, 6)), (1, 0.0)]
    assert [r.percent for r in jobs.progress(e).orderBy("event_id").collect()] == [20.0, 40.0, 60.0, 80.0, 100.0]
    assert jobs.gaps(e, 31).count() == 2
    assert [r[0] for r in spark.range(4).select(jobs.backoff(F.col("id"), 100)).collect()] == [100, 200, 400, 800]


def test_streams_with_late_rows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    make = lambda rows: spark.createDataFrame([(i, t0 + dt.timedelta(minutes=m), 1, s, 1.0, "{}") for i, m, s in rows], jobs.EVENT_SCHEMA)
    for n, part in enumerate(([(1, 0, "view"), (2, 61, "view")], [(3, 200, "error")], [(4, 5, "view"), (5, 300, "view")])):
        make(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = jobs.event_stream(spark, str(tmp_path / "events"), files=1)
    sink = jobs.run_to_end(jobs.job_states(stream), "states")
    last = spark.read.parquet(sink).orderBy(F.desc("events")).first()
    assert (last.job_id, last.events, last.state, last.ended) == (1, 5, "view", False)
    windows = jobs.run_to_end(jobs.tumbling(jobs.event_stream(spark, str(tmp_path / "events"), files=1), "1 hour", "10 minutes"), "windows")
    assert spark.read.parquet(windows).agg(F.sum("events")).first()[0] >= 2


def test_small_parts(spark, tmp_path):
    import numpy as np

    from sparkloom.functions import code, text
    from sparkloom.operators import crawl

    ids = ["123e4567-e89b-12d3-a456-426614174000", "no"]
    assert [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x string").select(text.is_uuid(F.col("x"))).collect()] == [True, False]
    assert code.pattern_catalog(spark).count() == 31 and code.language_catalog(spark).count() == 22
    blob = spark.createDataFrame([(bytearray(np.array([1, 2.5], "<f4").tobytes()),)], "b binary")
    assert blob.select(vectors.from_bytes(F.col("b"), 2)).first()[0] == [1.0, 2.5]
    pages = spark.createDataFrame([("a", 200, "<title> T </title>"), ("b", 404, "x"), ("c", 301, "")], "url string, status int, html string")
    assert sorted((r.url, r.title) for r in crawl.fetched(pages).collect()) == [("a", "T"), ("c", None)]
    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, t0), (1, t0 + dt.timedelta(seconds=400)), (2, t0)], "c int, ts timestamp")
    assert [r.c for r in jobs.silent(e, "c", F.lit(t0 + dt.timedelta(seconds=500)), 300).collect()] == [2]
    done = spark.createDataFrame([(1, True), (2, False)], "job_id long, ended boolean")
    for _ in range(2):
        jobs.append_history(done, str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 1
