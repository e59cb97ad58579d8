import numpy as np
import pandas as pd

from sparkloom.llm.neighbours import Graph, brute_force, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, ids, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def test_recall_over_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24)) * 3
    v = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 24))).astype(np.float32)
    got = nearest(table(spark, range(3000), v), every=50, shard_rows=700).toPandas()
    want = pd.DataFrame(list(brute_force(list(range(3000)), v, 50)), columns=["query_id", "rank", "vec_id", "score"])
    both = want.merge(got, on=["query_id", "vec_id"])
    assert len(both) / len(want) >= 0.97
    assert (both["score_x"] - both["score_y"]).abs().max() < 1e-9
    assert len(got) == len(want) and (got.groupby("query_id")["rank"].max() == 10).all()


def test_tables(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = df.toPandas()
    want = list(brute_force(rows["vec_id"].tolist(), np.stack(rows["embedding"].to_numpy())))
    assert sorted(tuple(r)[:3] for r in nearest(df).collect()) == sorted(w[:3] for w in want)


def test_hot_vector_and_ties(spark):
    v = [[1, 0, 0]] * 150 + [[1, 0, i / 100] for i in range(1, 60)]
    ids = list(range(150)) + list(range(200, 259))
    got = nearest(table(spark, ids, v), every=50, shard_rows=16).toPandas()
    want = list(brute_force(ids, np.array(v, np.float32), 50))
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)


def test_unusable_vectors_few_candidates_and_empty(spark):
    v = [[1, 2], None, [0, 0], [1, float("nan")], [1, None], [float("inf"), 1], [1, 2, 3], [4, 6], []]
    ids = [100, 200, 300, 400, 500, 600, 700, 800, 900]
    got = sorted(tuple(r) for r in nearest(table(spark, ids, v)).collect())
    assert got == [(100, 1, 800, 5.0), (800, 1, 100, 5.0)]
    assert nearest(table(spark, [100], [[1, 2]])).count() == 0
    assert nearest(table(spark, [1], [[1, 2]]).limit(0)).count() == 0


def test_graph_finds_every_node_of_a_line():
    v = np.arange(300, dtype=np.float32)[:, None]
    g = Graph(v, width=6, beam=20)
    assert all(g.search(v[i], 1, 20)[0] == i for i in range(300))
    assert len(g.layers) > 1 and g.layers[0].shape == (300, 12)


def recall(spark, v, **how):
    v = np.asarray(v, float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = nearest(df, every=50, least_rows=500, **how).toPandas()
    want = pd.DataFrame(list(brute_force(list(range(len(v))), v, 50)), columns=["query_id", "rank", "vec_id", "score"])
    both = want.merge(got, on=["query_id", "vec_id"])
    assert (both["score_x"] - both["score_y"]).abs().max() <= 1e-9 * max(1.0, want["score"].max())
    return len(both) / len(want)


def test_recall_away_from_the_origin_and_over_mixed_scales(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(1500, 24))
    for shift in (0, 1e3, 1e4, 1e8):
        assert recall(spark, v + shift) >= 0.95
    mixed = np.concatenate([v[:500], v[500:1000] * 1e-4 + 1e5, v[1000:] * 1e4 - 1e6])
    assert recall(spark, mixed) >= 0.95


def test_repeated_ids_are_rows_of_their_own(spark):
    ids = [100, 100, 7, 8, 8, 9]
    got = [tuple(r) for r in nearest(table(spark, ids, [[1, 0], [1, 0], [2, 0], [3, 0], [3, 0], [1, 1]])).collect()]
    assert sorted(got) == sorted([(100, 1, 100, 0.0), (100, 2, 7, 1.0), (100, 3, 9, 1.0), (100, 4, 8, 2.0), (100, 5, 8, 2.0)] * 2)
    got = [tuple(r) for r in nearest(table(spark, [100, 100, 7], [[1, 0], [5, 0], [2, 0]])).collect()]
    assert sorted(got) == [(100, 1, 7, 1.0), (100, 1, 7, 3.0), (100, 2, 100, 4.0), (100, 2, 100, 4.0)]
