import hashlib
import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkloom.llm import exact_dedup
from sparkloom.llm.exact_dedup import exact_groups
from sparkloom.llm.exact_dedup import exact_dedup as keep

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def expected(table):
    groups = defaultdict(list)
    for doc_id, text in table:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for content, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0]))
        sha = hashlib.sha256(content.encode()).hexdigest()
        out += [(d, best[0], len(members), d == best[0], sha) for d, _ in members]
    return sorted(out, key=repr)


def test_matches_brute_force_on_tables(spark, data, rows):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    table = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(exact_groups(docs), *COLUMNS) == expected(table)
    kept = {r.doc_id for r in keep(docs).collect()}
    assert kept == {r[0] for r in expected(table) if r[3]}


def test_nulls_ties_white_space_and_clashing_names(documents, rows):
    table = [(5, "a b"), (2, "a\tb"), (9, " a  b "), (3, None), (4, ""), (1, " \n"), (7, "a b"), (8, "é" * 50_000), (6, "é" * 50_000)]
    docs = documents(*table, extra=True)
    assert rows(exact_groups(docs), *COLUMNS) == expected(table)
    out = keep(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 6, 7, 9]


def test_repeated_rows_and_null_ids(documents, rows):
    docs = documents((1, "x"), (1, "x"), (None, "x"), (None, "y"))
    assert rows(exact_groups(docs), "doc_id", "keep_id", "group_size", "kept").count((1, 1, 3, True)) == 1
    assert sorted(repr(r.doc_id) for r in keep(docs).collect()) == ["1", "None"]


def test_empty_table(spark, documents):
    docs = documents((1, "x")).limit(0)
    assert exact_groups(docs).count() == 0
    assert keep(docs).count() == 0


def test_buckets_that_outgrow_their_memory_recurse(documents, rows, monkeypatch):
    levels = []
    inner = exact_dedup._grace
    monkeypatch.setattr(exact_dedup, "_grace", lambda level, *a: levels.append(level) or inner(level, *a))
    table = [(i, f"text {i % 60} " * 20) for i in range(300)]
    docs = documents(*table)
    assert rows(exact_groups(docs, memory=2000), *COLUMNS) == expected(table)
    assert max(levels) > 0
    assert len(keep(docs, memory=2000).collect()) == 60


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \né", max_size=4), min_size=1, max_size=12))
def test_any_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((tuple(r) for r in exact_groups(docs).select(*COLUMNS).collect()), key=repr)
    assert found == expected(list(enumerate(texts)))


def test_a_bucket_hands_on_all_that_it_cannot_hold():
    """Distinct contents that all lie in sub-bucket 0: the table stays small, and no content is in two places."""
    import pyarrow as pa
    from pyspark.sql import types as T

    fields = [*T.StructType.fromDDL(exact_dedup._LEADER).fields, T.StructField("_c0", T.StringType())]
    inside = exact_dedup._arrow(T.StructType(fields))
    outside = exact_dedup._arrow(T.StructType([*fields, T.StructField("_class", T.LongType()), T.StructField("_kind", T.IntegerType())]))
    rows = [(i, i, "", 16 * (i % 500), 1, 9, i, 700, f"text {i % 500}") for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(inside)], schema=inside)
    out = pa.Table.from_batches(list(exact_dedup._grace(0, 4000, ["_c0"], "_c0", outside, True)([batch]))).to_pylist()
    held = [r for r in out if r["_kind"] == exact_dedup.CLASS]
    passed = [r for r in out if r["_kind"] == exact_dedup.OVER]
    assert 1 <= len(held) and 700 * len(held) <= 4000
    assert sum(r["_count"] for r in held + passed) == 2000
    assert not {r["_c0"] for r in held} & {r["_c0"] for r in passed}


def test_more_buckets_than_a_job_may_have(documents, rows):
    table = [(i, f"text {i % 40} " * 20) for i in range(200)]
    docs = documents(*table)
    assert rows(exact_groups(docs, memory=20_000, buckets=2), *COLUMNS) == expected(table)
    assert len(keep(docs, memory=20_000, buckets=2).collect()) == 40
