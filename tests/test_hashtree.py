"""Trees of digests against the comparison of all rows."""

import random
import uuid

import pytest

from sparkloom.operators.hashtree import HashTree
from sparkloom.operators.maintain import difference
from sparkloom.sources.storage import shared_dir


@pytest.fixture
def build(spark):
    def run(rows, depth=2):
        df = spark.createDataFrame(rows, "id long, mark string, more int")
        return df, HashTree.build(df, f"{shared_dir(spark)}/{uuid.uuid4().hex}", "id", "mark", depth)

    return run


def test_equals_the_comparison_of_all_rows(build):
    rng = random.Random(3)
    old = [(i, str(rng.randrange(5)), 0) for i in range(600)]
    new = [(i, "x" if i % 97 == 0 else m, 1) for i, m, _ in old if i % 89] + [(1000, None, 0)]
    (a, ours), (b, theirs) = build(new), build(old)
    want = sorted(difference(a, b, "id", "mark").collect())
    assert sorted(ours.difference(theirs).collect()) == want == sorted(ours.difference(theirs, few=2).collect())
    leaves = ours.differing(theirs)
    assert 0 < leaves.count() <= len(want) and ours.rows_of(leaves).count() < 100
    assert ours.level(0).first().rows == len(new)
    assert "PartitionFilters: [part" in ours.rows_of(leaves)._jdf.queryExecution().toString()


def test_equal_repeated_null_and_empty_tables(build):
    _, a = build([(1, "a", 0), (2, None, 0), (None, "n", 0)])
    _, b = build([(2, None, 5), (1, "a", 5)])
    assert a.differing(b).count() == 0 and a.difference(b).count() == 0
    _, twice = build([(1, "a", 0), (1, "a", 0), (2, None, 0)])
    assert [r.leaf[:1] for r in twice.differing(a).collect()] == ["c"]  # the MD5 of 1 begins with c4
    _, none = build([])
    assert sorted(tuple(r) for r in a.difference(none).collect()) == [(1, "add"), (2, "add")]
    assert sorted(tuple(r) for r in none.difference(a).collect()) == [(1, "delete"), (2, "delete")]
    with pytest.raises(ValueError):
        a.differing(HashTree(a.spark, a.folder, "id", "mark", 1))
