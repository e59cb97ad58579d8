from collections import defaultdict

from sparkloom.llm.mixing import mix, plan_mix, source_targets


def expected_targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, cut at the cap, share the rest again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        over = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else left * w[s] / sum(w[x] for x in open_) for s in names}
        full |= over


def test_targets_and_takes(documents):
    table = [(i, " ".join(["w"] * (1 + i % 7)), "en", ("big" if i % 2 else f"small{i % 10}" if i % 3 else None), 0) for i in range(200)]
    table += [(900, None, "en", "empty", 0), (901, "", "en", "empty", 0)]
    docs = documents(*table, extra=True)
    plan = plan_mix(docs).collect()
    assert len(plan) == len(table)
    sizes = defaultdict(int)
    for r in plan:
        sizes[r.source] += r.size
    want = expected_targets(sizes)
    taken = defaultdict(int)
    for r in plan:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9)
    assert sorted((r.doc_id, r.taken) for r in plan) == sorted((r.doc_id, r.taken) for r in plan_mix(docs.repartition(7)).collect())


def test_mix_repeats_and_cuts(documents):
    table = [(i, " ".join(f"w{j}" for j in range(1 + i % 5)), "en", "ab"[i % 10 == 0], 0) for i in range(100)]
    docs = documents(*table)
    plan = {r.doc_id: r for r in plan_mix(docs).collect()}
    words = defaultdict(int)
    for r in mix(docs).collect():
        assert r.text == plan[r.doc_id] or dict((t[0], t[1]) for t in table)[r.doc_id].startswith(r.text)
        words[r.doc_id] += len(r.text.split())
    assert {d: n for d, n in words.items() if n} == {d: r.taken for d, r in plan.items() if r.taken}
    assert mix(docs).columns == docs.columns


def test_identical_rows_null_ids_and_empty_table(documents):
    docs = documents(*[(1, "a b c")] * 6, (None, "x"), (None, "x y"))
    assert sum(r.taken for r in plan_mix(docs).collect()) <= 21
    assert mix(docs).count() > 0
    assert plan_mix(docs.limit(0)).count() == 0
    assert mix(docs.limit(0)).count() == 0


def test_targets_when_everything_is_capped(spark):
    totals = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1), (None, 0)], "source string, source_size long")
    found = {r.source: r.target for r in source_targets(totals).collect()}
    assert found == expected_targets({"a": 100, "b": 1, "c": 1, None: 0})


def test_cut_texts_keep_their_white_space_and_long_texts_count_whole(documents):
    body = "  a\n\nb  c\td \x0b e\n"
    docs = documents(*[(i, body, "en", "a", 0) for i in range(10)], (99, "w " * 200_000, "en", "b", 0), (98, None, "en", None, 0))
    plan = {r.doc_id: r for r in plan_mix(docs).collect()}
    assert plan[99].size == 200_000 and plan[98].taken == 0
    seen = [r.text for r in mix(docs).collect() if r.doc_id < 10]
    assert all(body.startswith(t) for t in seen) and sum(len(t.split()) for t in seen) == sum(plan[i].taken for i in range(10))


def test_many_sources_in_ranges(spark):
    sizes = {f"s{i:04}": (i * 37) % 101 for i in range(600)} | {None: 5}
    found = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = expected_targets(sizes)
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) < 1e-6 for s in want)


def test_mix_takes_what_the_plan_gives_to_repeated_rows(documents):
    """Seven equal rows of a source whose target isn't a multiple of anything, beside another."""
    docs = documents(*[(7, "a b c d e", "en", "a", 9)] * 7, *[(i, "x y z", "en", "b", 9) for i in range(11)], (None, None, "en", "a", 0), extra=True)
    plan, found = plan_mix(docs).collect(), mix(docs).collect()
    for doc_id in {r.doc_id for r in plan}:
        assert sum(len((r.text or "").split()) for r in found if r.doc_id == doc_id) == sum(r.taken for r in plan if r.doc_id == doc_id)
    assert 0 < sum(r.taken for r in plan if r.doc_id == 7) < 105
