import zlib
from collections import Counter, defaultdict

from sparkloom.llm.sharding import assign_shards


def test_counts_slots_and_groups(documents):
    texts = [f"text {i}" for i in range(300)] + [f"twin {i // 3}" for i in range(90)] + ["hot"] * 200 + [None, ""]
    docs = documents(*texts, extra=True)
    found = assign_shards(docs, shards=8).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))
    counts = Counter(r.shard for r in found)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    groups = defaultdict(list)
    slots = defaultdict(list)
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
        groups[raw].append(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    apart = sum(len(set(s)) > 1 for g, s in groups.items() if g != b"hot" and len(s) > 1)
    assert apart <= 2  # of 31 groups; a hash would part nearly all
    assert len(set(groups[b"hot"])) <= 6  # it fills shards one after another
    again = assign_shards(docs.repartition(5), shards=8).collect()
    assert Counter(r.shard for r in again) == counts


def test_nulls_repeated_rows_and_empty_table(documents):
    docs = documents((None, "x"), (1, "x"), (1, "x"), (2, None))
    found = assign_shards(docs, shards=3).collect()
    assert len(found) == 4 and max(Counter(r.shard for r in found).values()) == 2
    assert assign_shards(docs.limit(0)).count() == 0


def test_rounds_until_nothing_moves(documents):
    """A group that fills 15 of 24 shards, one more each round."""
    docs = documents(*["hot"] * 150, *[f"text {i}" for i in range(90)])
    found = assign_shards(docs).collect()
    assert set(Counter(r.shard for r in found).values()) == {10}
    assert len({r.shard for r in found if r.doc_id < 150}) == 15


def cut(found, texts):
    """Pairs of equal texts in different shards."""
    groups = defaultdict(Counter)
    for r in found:
        groups[texts[r.doc_id] or ""][r.shard] += 1
    pairs = lambda n: n * (n - 1) // 2
    return sum(pairs(sum(g.values())) - sum(map(pairs, g.values())) for g in groups.values())


def least_cut(sizes, shards, capacity):
    """The least number of parted pairs over all ways to deal groups of equal texts to shards of one capacity."""
    from functools import cache

    pairs = lambda n: n * (n - 1) // 2

    @cache
    def best(i, room):
        if i == len(sizes):
            return 0
        found = []

        def deal(left, at, now, kept):
            if at == len(room):
                if not left:
                    found.append(pairs(sizes[i]) - kept + best(i + 1, tuple(sorted(now))))
                return
            for take in range(min(left, room[at]) + 1):
                deal(left - take, at + 1, (*now, room[at] - take), kept + pairs(take))

        deal(sizes[i], 0, (), 0)
        return min(found, default=10**9)

    return best(0, (capacity,) * shards)


def test_edge_cut_against_brute_force(documents):
    """The least cut where groups leave unlinked documents to swap with; never more than half of what a hash cuts."""
    for sizes, exact in (((4, 3, 2), True), ((3, 3, 3), True), ((7, 1), True), ((5, 4), True), ((6, 2, 2), False)):
        texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
        texts += [f"alone {i}" for i in range(18 - len(texts))]
        got, least = cut(assign_shards(documents(*texts), shards=3).collect(), texts), least_cut(sizes, 3, 6)
        assert got == least if exact else least <= got <= sum(n * (n - 1) // 2 for n in sizes) / 2, sizes


def test_a_group_of_most_rows_fills_whole_shards(documents):
    """2,000 of 2,400 rows have one text: 20 of 24 shards, the least possible, hold it."""
    texts = ["hot"] * 2000 + [f"text {i}" for i in range(400)]
    found = assign_shards(documents(*texts)).collect()
    assert set(Counter(r.shard for r in found).values()) == {100}
    assert len({r.shard for r in found if r.doc_id < 2000}) == 20


def test_long_texts(documents):
    texts = ["é" * 300_000, "é" * 300_000, "x"]
    found = {r.doc_id: r for r in assign_shards(documents(*texts), shards=2).collect()}
    assert found[0].size == 600_008 and found[0].shard == found[1].shard
