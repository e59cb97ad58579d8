import hashlib
import random
import zlib

import pytest

from sparkloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, block=100, most=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = (turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest())
            own.setdefault(c, []).append((order, role, text))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % block) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {k: [] for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), parent, len(members), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **how):
    return sorted(map(tuple, tries.prefix_trie(df, **how).collect()), key=repr)


def generated(seed):
    rng = random.Random(seed)
    ids = [*range(-250, 250, 3), *range(0, 400, 100), 10**15]
    rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["x", "yy", "é\U0001f600", None, ""])) for c in ids for t in range(rng.randrange(1, 9))]
    rows += [(7, t, "u", "z") for t in range(1200)]  # one conversation with most of the rows
    rows += [(None, 1, "u", "q"), (5, None, "u", "n"), (5, 1, "u", "n"), (5, 1, "u", "n"), (5, 1, None, "m")]
    return rows


def test_against_brute_force(spark):
    rows = generated(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df) == brute(rows)


def test_deep_nests_of_prefixes_and_long_texts(spark):
    """Conversation k begins as k - 1 does, so every node's smallest member changes from depth to depth."""
    rows = [(100 * k, t, "user", f"{t} " * (1 + 2000 * (t == 3))) for k in range(1, 30) for t in range(k)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS depth", "1 AS conv", "2 AS i", "'y' AS digest")
    assert found(df) == brute(rows)


def test_no_turns_no_rows_and_nulls(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(c, 0, None, None) for c in range(101, 130)]  # no base; those with h > 0 have no turn left
    result = found(spark.createDataFrame(rows, SCHEMA))
    assert result == brute(rows) and result[0][1] == 0
    assert found(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)) == []


def test_collisions_are_seen_and_bases_changed(spark, monkeypatch):
    """With bases of 1 a product doesn't tell orders apart; the check of references finds that and takes others."""
    rows = [(100 * k, t, "u", "abc"[(t * k) % 3] if t < 3 else "d") for k in range(1, 6) for t in range(4)]
    real, asked = tries.bases, []
    monkeypatch.setattr(tries, "bases", lambda seed: asked.append(seed) or ([1, 1, 1] if seed == 0 else real(seed)))
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert max(asked) > 0


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_digests_of_ends_in_chunks(spark, chunk):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(2), 0, 0, rng.randrange(-(10**6), 10**6)) for _ in range(500)]
    rows = list(set(rows))
    df = spark.createDataFrame(rows, "depth long, f0 long, f1 long, f2 long, conv long").repartition(7)
    got = {tuple(r)[:4]: r.ends_sha256 for r in tries.digests_of_ends(df, chunk).collect()}
    for key in {r[:4] for r in rows}:
        ids = ",".join(map(str, sorted(r[4] for r in rows if r[:4] == key)))
        assert got[key] == hashlib.sha256(ids.encode()).hexdigest()
