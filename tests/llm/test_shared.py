import random

from pyspark.sql import functions as F

from sparkloom.llm.shared import prefix_sums, running_sums, spread_join


def test_spread_join_joins_all_and_spreads_hot_keys(spark, capsys):
    """Hot and cold keys, keys without a row on the other side; the shuffle has the salt among its keys."""
    keys = ["hot"] * 3000 + [f"k{i % 50}" for i in range(500)] + ["alone"] * 3
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string").repartition(3)
    side = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("most")).filter("key <> 'alone'")
    want = sorted((r.id, r.key, r.n, r.most) for r in rows.join(side, "key").collect())
    found = spread_join(rows, side, ["key"], "n", len(keys), ["id"])
    assert sorted(tuple(r) for r in found.collect()) == want
    left = spread_join(rows, side, ["key"], "n", len(keys), ["id"], "left").collect()
    assert len(left) == len(keys) and sum(r.n is None for r in left) == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        spread_join(rows, side, ["key"], "n", len(keys), ["id"]).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert any("hashpartitioning(key" in line and "_salt" in line for line in plan.splitlines())


def test_sums_over_buckets_and_ranges(spark):
    rng = random.Random(1)
    data = [(f"{rng.getrandbits(64):016x}", "ab"[i % 5 == 0], rng.randrange(9)) for i in range(400)]
    rows = spark.createDataFrame(data, "key string, part string, v int")
    for digits in (1, 3, 5):
        found = {r.key: r.s for r in prefix_sums(rows, ["part"], "key", digits, [], F.col("v"), "s").collect()}
        assert all(found[k] == sum(v for j, q, v in data if q == p and j < k) for k, p, _ in data)
    found = {r.key: (r.s, r.s_all) for r in running_sums(rows, [F.col("key").desc()], {"s": "v"}).collect()}
    assert all(found[k] == (sum(v for j, _, v in data if j > k), sum(v for _, _, v in data)) for k, _, _ in data)
