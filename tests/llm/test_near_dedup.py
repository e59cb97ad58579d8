import random

import numpy as np

from sparkloom.llm.links import components
from sparkloom.llm.near_dedup import Signer, banding, near_dedup, near_groups, shingles


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def expected(table, percent=85):
    s = {d: sets(t) for d, t in table}
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s[d]), find(d), find(d) == d) for d in s)


def chain(rng, n, words, changes):
    """Texts that each differ a little from the one before."""
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(text)
        for _ in range(changes):
            text[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_matches_brute_force_on_tables(spark, data, rows):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    table = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(near_groups(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(expected(table), key=repr)


def test_chains_stars_and_small_blocks(documents, rows):
    """Links that no centre of a bucket has are found by the search within buckets, also over several blocks."""
    rng = random.Random(5)
    base = chain(rng, 1, 120, 0)[0]
    texts = chain(rng, 60, 100, 1)
    for _ in range(25):  # each near the base, not near each other
        w = base.split()
        for i in rng.sample(range(0, 120, 6), 2):
            w[i] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [base.upper(), base + " \n", "one two", "ONE  two", "", None, "a"]
    docs = documents(*[(1000 - i, t) for i, t in enumerate(texts)], extra=True)
    table = [(1000 - i, t) for i, t in enumerate(texts)]
    want = sorted(expected(table), key=repr)
    assert rows(near_groups(docs, block=4), "doc_id", "n_shingles", "component_id", "kept") == want
    for percent in (85, 80):
        out = near_dedup(docs, percent)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, _, _, k in expected(table, percent) if k)


def test_lower_thresholds_find_all_links(documents, rows):
    """Pairs just above the threshold; 30 bands of 6 miss a quarter of those at 0.6."""
    rng = random.Random(8)
    for percent, changed in ((60, 5), (80, 2)):
        table = []
        for i in range(80):
            text = [f"w{rng.randrange(10**6)}" for _ in range(104)]
            table.append((2 * i, " ".join(text)))
            for j in range(changed):
                text[10 + 20 * j] = f"v{rng.randrange(10**6)}"
            table.append((2 * i + 1, " ".join(text)))
        want = sorted(expected(table, percent), key=repr)
        assert sum(k for _, _, _, k in want) == 80
        assert rows(near_groups(documents(*table), percent), "doc_id", "n_shingles", "component_id", "kept") == want


def test_banding_misses_less_than_one_in_a_million():
    assert banding(85) == (30, 6) and banding(80) == (35, 5)
    for percent in range(20, 101):
        bands, values = banding(percent)
        assert (1 - (percent / 100) ** values) ** bands < 1e-6


def test_threshold_is_met_exactly():
    a = [f"w{i}" for i in range(104)]
    assert len(shingles(" ".join(a))) == 100
    assert len(np.intersect1d(shingles(" ".join(a)), shingles(" ".join(a[:96])))) == 92


def test_null_ids_repeated_rows_and_empty_table(documents, rows):
    t = "a b c d e f g h"
    docs = documents((None, t), (3, t), (3, t), (4, "x"), (3, "other words than the ones above"))
    found = rows(near_groups(docs), "doc_id", "component_id", "kept")
    assert found == sorted([(None, 3, False), (3, 3, True), (3, 3, True), (4, 4, True), (3, 3, True)], key=repr)
    assert sorted(repr(r.doc_id) for r in near_dedup(docs).collect()) == ["3", "3", "3", "4"]
    assert near_groups(docs.limit(0)).count() == 0
    assert near_dedup(docs.limit(0)).count() == 0


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(1)
    signer = Signer(400, 1)
    for n in (3, 20, 400):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 2**63, n, dtype=np.uint64)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((signer(a) == signer(b)).mean() - j) < 0.25


def test_shingles_lower_only_ascii_and_split_on_six_characters():
    assert len(shingles("A b\tC\x0bd\x0ce f")) == 2
    assert (shingles("ABC") == shingles("abc")).all()
    assert len(np.intersect1d(shingles("É"), shingles("é"))) == 0
    assert len(shingles("a b")) == 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200)]
    found = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {(i, 0) for i in range(1, 41)} | {(100 + i, 100) for i in range(1, 30)} | {(201, 200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_many_null_ids_and_repeated_rows(documents, rows):
    """Null ids are no key of a join, and a text that repeats is one node."""
    rng = random.Random(4)
    a, b = chain(rng, 2, 110, 1)
    table = [(None, a), (None, b)] * 300 + [(7, a), (7, b), (5, "other words than these are here")] * 100
    found = near_groups(documents(*table)).collect()
    assert len(found) == len(table)
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(None, 7, False), (7, 7, True), (5, 5, True)}
    assert {(r.doc_id, r.text) for r in near_dedup(documents(*table)).collect()} in ({(7, a), (5, table[602][1])}, {(7, b), (5, table[602][1])})


def test_an_id_links_its_texts(documents, rows):
    docs = documents((5, "a b c d e"), (3, "a b c d e"), (5, "v w x y z"), (9, "v w x y z"))
    assert rows(near_groups(docs), "doc_id", "component_id", "kept") == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False)]
    assert {r.doc_id for r in near_dedup(docs).collect()} == {3, 5}


def test_shared_hashes_are_counted():
    from sparkloom.llm.near_dedup import _common

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60 if i % 3 else 4000, 40).astype(np.uint64)) for i in range(40)]
    want = [[len(np.intersect1d(a, b)) if i < j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert (_common(sets, width=7) == np.array(want)).all()


def test_search_equals_brute_force_where_texts_share_passages(spark):
    """Sets of many sizes that share a passage, most of them below the threshold; pieces of four sets and of all sets."""
    from sparkloom.llm.near_dedup import _leading, _search, digest, similar

    rng = np.random.default_rng(3)
    passage, table = rng.integers(0, 2**63, 60, dtype=np.uint64), {}
    for own in [3, 5, 8, 12, 13, 14, 15, 16, 18, 22, 30, 60] * 4:
        found = np.unique(np.r_[passage[: rng.integers(40, 61)], rng.integers(0, 2**63, own, dtype=np.uint64)])
        table[digest(found)] = found
    for n in (1, 2, 3, 7, 400):
        found = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        table |= {digest(x): x for x in (found, np.unique(np.r_[found, rng.integers(0, 2**63, max(1, n // 9), dtype=np.uint64)]))}
    sets = spark.createDataFrame([(k, v.tobytes()) for k, v in table.items()], "node binary, set binary")
    nodes = sets.select("node", sets.node.alias("comp"))

    def groups(links):
        root = {k: k for k in table}
        for u, v in links:
            old, new = root[u], root[v]
            root = {k: new if r == old else r for k, r in root.items()}
        return {frozenset(k for k, r in root.items() if r == x) for x in root.values()}

    for percent, block in ((80, 4), (85, 512)):
        names = list(table)
        good = lambda a, b: similar(len(a), len(b), len(np.intersect1d(a, b)), percent)
        want = [(u, v) for i, u in enumerate(names) for v in names[:i] if good(table[u], table[v])]
        found = [(bytes(r.u), bytes(r.v)) for r in _search(nodes, sets, percent, block).collect()]
        assert {frozenset(p) for p in found} <= {frozenset(p) for p in want}
        assert groups(found) == groups(want)
        for n in range(1, 90):  # a first common hash allows exactly the sizes that can still be similar
            most, least = _leading(n, percent)
            for m in range(1, 140):
                early = [p for p in range(n) if similar(n, m, min(n - p, m), percent)]
                assert early == [p for p, x in enumerate(most) if least <= m <= x]
