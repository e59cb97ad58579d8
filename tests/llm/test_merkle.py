import hashlib
import zlib

import pytest

from sparkloom.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        out.append(nodes)
    return out


def path(levels, at, fan):
    out = []
    for nodes in levels[:-1]:
        first = at - at % fan
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fan])))
        at //= fan
    return out


def brute(rows, fan=8):
    trees = {}
    for r in rows:
        values, other = [r[c] for c in merkle.FIELDS], [r[c] for c in merkle.FIELDS]
        if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            other[-1] = r["text"].translate(str.maketrans(merkle.UPPER, merkle.LOWER))
        order = (r["doc_id"] is not None, r["doc_id"] or 0, leaf(values))
        trees.setdefault(r["lang"], []).append((order, r["doc_id"], leaf(values), leaf(other)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: climb([leaves[2] for leaves in sorted(trees[x], key=lambda y: y[0])], fan) for x in langs}
    top = climb([levels[x][-1][0] for x in langs], fan)
    out = []
    for k, lang in enumerate(langs):
        for i, (_, doc_id, own, folded) in enumerate(sorted(trees[lang], key=lambda y: y[0])):
            steps = path(levels[lang], i, fan) + path(top, k, fan)
            for a, b in steps:
                folded = h(a + folded + b)
            out.append((doc_id, own, levels[lang][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def found(df, **how):
    return sorted(map(tuple, merkle.manifest(df, **how).collect()), key=repr)


@pytest.mark.parametrize(("fan", "levels"), [(8, 3), (2, 2), (3, 1)])
def test_against_brute_force(spark, data, fan, levels):
    """The last two take several rounds up and down, within the trees and above them."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.selectExpr("doc_id", "concat('A', text) AS text", "concat(lang, doc_id % 3) AS lang", "source", "n_chars")
    assert found(docs, fan=fan, levels=levels) == brute(docs.collect(), fan)


def test_nulls_ties_repeated_rows_and_clashing_names(documents):
    big = (1 << 62) + 1
    rows = [(None, None, None, None, None), (None, "A", None, "s", 1), (None, "A", None, "s", 1), (3, "A", "en", None, 1), (3, "B", "en", None, 1), (6, None, "en", None, None)]
    rows += [(big, "Z" * 100_000, "é", "s", 2), (big + 1, "\U0001f600 A", "é", "", -2), (9, "", "", "s", 0), (10, "q", "z", "s", 1)]
    docs = documents(*rows, extra=True).selectExpr("*", "'x' AS h", "1 AS idx", "2 AS _tree", "3 AS n")
    assert found(docs) == brute(docs.collect())
    assert found(documents((1, "One"))) == brute(documents((1, "One")).collect())  # a lone leaf is the root
    assert found(docs.limit(0)) == []


def test_many_languages(documents):
    docs = documents(*[(i, "T", f"l{i % 70}", "s", 1) for i in range(150)])
    assert found(docs) == brute(docs.collect())
