"""Frontiers in bitmaps, sketches by day, tables of path rules: against exact and brute forms."""

import datetime
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import crawl
from sparkloom.operators.frontier import Frontier
from sparkloom.operators.rules import judged
from sparkloom.operators.sketches import DistinctByDay
from sparkloom.sources.storage import shared_dir


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def tasks(spark, rows):
    return spark.createDataFrame(rows, "url string, depth int")


@pytest.mark.parametrize("bits", [16, 3])
def test_frontier_equals_the_exact_form(spark, folder, bits):
    rng = random.Random(5)
    known, seen = Frontier(spark, folder, bits), spark.createDataFrame([], "url string")
    spared = []
    for _ in range(3):
        batch = tasks(spark, [(f"https://e{rng.randrange(4)}.org/p{rng.randrange(80)}{rng.choice(['', '/', '?utm_x=1', '?a=1'])}", rng.randrange(3)) for _ in range(60)])
        want = sorted((r.normal, r.depth) for r in crawl.admitted(batch, seen).collect())
        got = known.admit(batch).collect()
        assert sorted((r.normal, r.depth) for r in got) == want
        spared.append(sum(r.sure for r in got) / max(len(got), 1))
        seen = seen.unionByName(batch.select("url"))
    # With many places the bitmaps alone tell of nearly all new addresses; with eight the exact join does the work.
    assert spared[0] == 1 and (spared[2] > 0.9) == (bits == 16)
    assert known.bitmaps().agg(F.sum(F.bitmap_count("bitmap"))).first()[0] <= known._read("seen", "place long, normal string").count()


def test_frontier_after_a_batch_that_died(spark, folder):
    """Bits without addresses, as a batch leaves them that dies between its two writes: its addresses are still admitted."""
    known = Frontier(spark, folder)
    batch = tasks(spark, [("https://e.org/a", 1), (None, 0), ("https://e.org/b", None)])
    other = Frontier(spark, folder + "-other")
    other.admit(batch)
    spark.read.parquet(folder + "-other/bits").write.mode("append").parquet(folder + "/bits")
    got = known.admit(batch).collect()
    assert sorted((r.normal, r.depth, r.sure) for r in got) == [("https://e.org/a", 1, False), ("https://e.org/b", None, False)]
    assert known.admit(batch).isEmpty() and known.admit(tasks(spark, [])).isEmpty()


def test_sketches_merge_over_days(spark, folder):
    rng = random.Random(2)
    day = lambda n: datetime.datetime(2024, 1, 1 + n, 12)
    rows = [(rng.choice(["a", "b", None]), day(rng.randrange(9)), rng.randrange(3000)) for _ in range(6000)] + [("a", None, 1), ("a", day(1), None)]
    make = lambda r: spark.createDataFrame(r, "g string, ts timestamp, v long")
    kept = DistinctByDay(spark, folder, ["g"])
    kept.add(make(rows[:4000]), "ts", "v")
    kept.add(make(rows[3000:]), "ts", "v")  # a thousand rows a second time
    exact = lambda g, lo, hi: len({v for x, t, v in rows if x == g and t and v is not None and day(lo) <= t <= day(hi)})
    merged = kept.compact(folder + "-merged")
    for store in (kept, merged):
        for r in store.between("2024-01-02", "2024-01-05").collect():
            assert abs(r.estimate - exact(r.g, 1, 4)) <= 0.05 * exact(r.g, 1, 4)
        trailing = store.trailing(3).collect()
        assert len(trailing) == 27
        for r in trailing:
            n = (r.day - datetime.date(2024, 1, 1)).days
            assert abs(r.estimate - exact(r.g, max(n - 2, 0), n)) <= 0.05 * exact(r.g, max(n - 2, 0), n)
    assert merged.days().count() == 27
    plan = kept.between("2024-01-02", "2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def brute(path, rules, longest):
    best = None
    for kind, rule in rules:
        body = rule[:-1] if rule.endswith("$") else rule
        pattern = "^" + ".*".join(map(re.escape, body.split("*"))) + ("$" if rule.endswith("$") else "")
        if re.search(pattern, path, re.S):
            allow = kind == "allow"
            key = (len(rule), allow, rule) if longest else (allow, len(rule), rule)
            best = max(best, key) if best else key
    if not best:
        return True, None
    return best[1] if longest else best[0], best[2]


@pytest.mark.parametrize("longest", [True, False])
def test_rules_equal_every_rule_tried(spark, longest):
    rng = random.Random(7)
    piece = lambda n: "".join(rng.choice(["/", "a", "b", "/a", ".x", "?"]) for _ in range(n))
    rule = lambda: "/" + piece(rng.randrange(4)) + rng.choice(["", "", "*", "*b", "$", "*a$", "*/*"])
    table = [(f"h{rng.randrange(3)}", rng.choice(["allow", "disallow"]), rule()) for _ in range(60)]
    table += [("h1", "disallow", "*a"), ("h1", "disallow", ""), ("h1", "disallow", None), (None, "disallow", "/"), ("h2", "other", "/")]
    paths = [(i, rng.choice(["h0", "h1", "h2", "h9", None]), rng.choice([None, "", "/"]) if i < 9 else "/" + piece(rng.randrange(7))) for i in range(400)]
    got = judged(spark.createDataFrame(paths, "id long, host string, path string"), spark.createDataFrame(table, "host string, kind string, rule string"), longest).collect()
    of = lambda h: [(k, r) for x, k, r in table if h and x == h and r and k != "other"]
    assert sorted((r.id, r.allowed, r.rule) for r in got) == [(i, *brute(p or "", of(h), longest)) for i, h, p in paths]
