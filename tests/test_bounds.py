"""What tasks and workers hold: small batches, no shuffle by document, no sketch for each pair."""

import io
from contextlib import redirect_stdout

import pytest

from sparkloom.operators import ranking
from sparkloom.plans.registry import QUERIES


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["page_parse", "page_markdown", "code_blocks", "paragraph_chunks", "ingested_chunks", "text_embeddings"])
def test_workers_get_small_batches(spark, data, name):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    QUERIES[name](spark, data)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_words_are_counted_where_they_lie(spark):
    rows = [(1, "a b a"), (2, None), (3, ""), (4, "b"), (None, "z z")]
    schema = "entry_id long, content string"
    counted, lens = ranking.postings(spark.createDataFrame(rows, schema), "entry_id", "content")
    assert {tuple(r) for r in counted.collect()} == {(1, "a", 2), (1, "b", 1), (4, "b", 1), (None, "z", 2)}
    assert {tuple(r) for r in lens.collect()} == {(1, 3), (2, 0), (3, 0), (4, 1), (None, 2)}
    assert "Exchange" not in plan(counted)
    counted, _ = ranking.postings(spark.createDataFrame([*rows, (1, "a c"), (None, "z")], schema), "entry_id", "content")
    assert {tuple(r) for r in counted.collect()} == {(1, "a", 3), (1, "b", 1), (1, "c", 1), (4, "b", 1), (None, "z", 3)}


def test_sketches_are_kept_by_state_only(spark, data):
    counts = [x for x in plan(QUERIES["approximate_counts"](spark, data)).splitlines() if "approx_count_distinct" in x]
    assert counts and not any("job_id" in x.split("functions=")[0] or "user_id" in x.split("functions=")[0] for x in counts)


def test_tags_need_no_shuffle_and_equal_counting(spark):
    from sparkloom.operators import tags

    schema = "entry_id long, content string"
    rows = [(1, "red fox and red fox. the blue blue sky! red"), (2, None), (3, ""), (4, "one. two. one two three")]
    docs = spark.createDataFrame(rows, schema)
    assert "Exchange" not in plan(tags.rake(docs, "entry_id", "content")) + plan(tags.tfidf(docs, "entry_id", "content"))
    rake = {(r.entry_id, r.tag): (r.score, r["rank"]) for r in tags.rake(docs, "entry_id", "content").collect()}
    # red: in "red fox" twice and once alone; blue: twice in one phrase of three words.
    assert rake[1, "red fox"] == (round(5 / 3 + 2, 6), 2) and rake[1, "red"] == (round(5 / 3, 6), 3) and rake[1, "blue blue sky"] == (9.0, 1)
    tfidf = [tuple(r) for r in tags.tfidf(docs, "entry_id", "content").filter("entry_id = 4").orderBy("rank").collect()]
    assert tfidf == [(4, "three", 1.0, 1), (4, "one", 0.8, 2), (4, "two", 0.6, 3)]
    both = spark.createDataFrame([*rows, (1, "red fox")], schema)
    again = {(r.entry_id, r.tag): r.score for r in tags.rake(both, "entry_id", "content").collect()}
    assert again[1, "red fox"] == round(7 / 4 + 2, 6) and again[4, "one two three"] == rake[4, "one two three"][0]
