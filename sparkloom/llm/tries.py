"""Prefix trie of rebuilt conversations by composable fingerprints.

A turn is a pair (length 1, x) and a sequence a pair (n, sum of x_i * B**i mod p); two of them compose to
(n + m, f + B**n * g), an associative product with a unit. So:

1. Turns are range-sorted once; each range multiplies up its own turns, and products of whole ranges give what lies
   before a range, so that a conversation of any length is spread over tasks. Of a turn nothing but its place, its
   length and a 256-bit digest of role and text goes on: texts are read once and never shuffled or put together.
2. A rebuilt conversation is the product of its base's head and its own suffix. Both are parts of products known from 1;
   the prefix of each depth is composed of them symbolically.
3. Rows with one depth and product are a node. The digests of the turns they refer to and the products one turn before
   must agree within each node; by induction their sequences are equal. Where a node fails, all is done again with other
   bases, so the result is exact.
4. Node by node, everything else is a sum over members: a conversation that is the smallest member of its last node
   stands for that node's leaf, and the part of its path on which it is the smallest member holds nodes of its own,
   whose savings are added from the end. No step walks up or down the levels.

Defined results: rows without conv_id belong to no conversation; turns that tie are ordered by role, then by digest;
null and empty role or text are the same; repeated rows are turns of their own; conv_id modulo 100 has the sign of
conv_id, as in SQL; an empty table has no node at all; texts of any length count whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, running_sums, small_batches, spread_join, stored

#: Primes below 2**31: products of two residues fit a signed 64-bit integer. Their product has 93 bits.
PRIMES = (2147483647, 2147483629, 2147483587)
_DIGEST = ("d0", "d1", "d2", "d3")
_FOUND = ("f0", "f1", "f2")
_BEFORE = ("p0", "p1", "p2")
_TERM = ("t0", "t1", "t2")
NODE = ["depth", *_FOUND]


def bases(seed: int) -> list[int]:
    raw = hashlib.sha256(f"bases {seed}".encode()).digest()
    return [int.from_bytes(raw[8 * k : 8 * k + 8], "little") % (p - 1000) + 500 for k, p in enumerate(PRIMES)]


def powers(base: int, prime: int, count: int) -> np.ndarray:
    """base ** 0, base ** 1, ..., modulo prime."""
    out = np.ones(count, np.int64)
    done = 1
    while done < count:  # doubling: what is there, times base ** done
        more = min(done, count - done)
        out[done : done + more] = out[:more] * pow(base, done, prime) % prime
        done += more
    return out


def stored_turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, digest, chars, spread: every turn, by the reference (conv, place) that products are made of."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    spread = F.xxhash64(F.monotonically_increasing_id())
    return rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"), spread.alias("spread")
    )


def range_products(turns: DataFrame, seed: int) -> DataFrame:
    """conv, part, i (place in the part, from 1), chars, the digest as four numbers, the product f of the part up to the turn, the turn's term t."""
    base = bases(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, sums = None, 0, [0, 0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, 4)
            at = np.arange(len(conv))
            new = np.r_[True, conv[1:] != conv[:-1]]
            start = np.maximum.accumulate(np.where(new, at, 0))
            kept = count if last is not None and conv[0] == last else 0
            within = at - start + 1
            place = within + np.where(start == 0, kept, 0)
            out, terms = [], []
            for k, (b, p) in enumerate(zip(base, PRIMES, strict=True)):
                x = np.mod(words[:, 0] ^ (words[:, 1] >> (7 + k)) ^ (words[:, 2] << (3 + 5 * k)) ^ words[:, 3], p)
                term = x * powers(b, p, len(conv) + 1)[within] % p
                if kept:
                    term = np.where(start == 0, term * pow(b, kept, p) % p, term)
                total = np.cumsum(term)  # fewer than 2**32 terms of 31 bits in a batch
                f = total - np.where(start > 0, total[start - 1], 0) + np.where(start == 0, sums[k] if kept else 0, 0)
                out.append(f % p)
                terms.append(term)
            last, count, sums = int(conv[-1]), int(place[-1]), [int(f[-1]) for f in out]
            arrays = [batch.column(0), batch.column(2), pa.array(place), batch.column(3), *(pa.array(words[:, k].copy()) for k in range(4)), *map(pa.array, out + terms)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "part", "i", "chars", *_DIGEST, *_FOUND, *_TERM])

    ranged = turns.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", "digest", "spread")
    ranged = ranged.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest", "spread")
    ranged = ranged.select("conv", "digest", F.spark_partition_id().cast("long").alias("part"), "chars")
    numbers = ", ".join(f"{x} long" for x in (*_DIGEST, *_FOUND, *_TERM))
    return stored(ranged.mapInArrow(run, f"conv long, part long, i long, chars long, {numbers}"), "products")


def range_offsets(parts: DataFrame, seed: int) -> DataFrame:
    """conv, part, n, b0.., w0..: number and product of a conversation's turns before the part, and base ** n.

    Only conversations that lie in several ranges have rows, one for each; a range has two of them at most.
    """
    base = bases(seed)
    columns = ["conv", "part", "n", "b0", "b1", "b2", "w0", "w1", "w2"]

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return pd.DataFrame(columns=columns, dtype="int64")
        rows = rows.sort_values("part")
        n, found, out = 0, [0, 0, 0], []
        for r in rows.itertuples(index=False):
            power = [pow(b, n, p) for b, p in zip(base, PRIMES, strict=True)]
            out.append((r.conv, r.part, n, *found, *power))
            found = [(f + w * int(g)) % p for f, w, g, p in zip(found, power, (r.f0, r.f1, r.f2), PRIMES, strict=True)]
            n += int(r.held)
        return pd.DataFrame(out, columns=columns)

    return parts.groupBy("conv").applyInPandas(scan, ", ".join(f"{c} long" for c in columns))


def placed_turns(turns: DataFrame, seed: int) -> DataFrame:
    """Every turn with its place i and its product within the whole conversation: conv, i, chars, d0.., f0.., and t0.., its own term."""
    local = range_products(turns, seed)
    parts = local.groupBy("conv", "part").agg(F.max("i").alias("held"), F.max_by(F.struct(*_FOUND), "i").alias("f")).select("conv", "part", "held", "f.*")
    several = parts.groupBy("conv").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv")
    offsets = range_offsets(parts.join(several, "conv", "left_semi"), seed)
    # Two rows of offsets a range at most, whatever the number of turns.
    rows = local.join(F.broadcast(offsets), ["conv", "part"], "left")
    whole = [F.when(F.col("n").isNull(), F.col(f)).otherwise((F.col(b) + F.col(w) * F.col(f) % p) % p).alias(f) for f, b, w, p in zip(_FOUND, ("b0", "b1", "b2"), ("w0", "w1", "w2"), PRIMES, strict=True)]
    own = [F.when(F.col("n").isNull(), F.col(t)).otherwise(F.col(w) * F.col(t) % p).alias(t) for t, w, p in zip(_TERM, ("w0", "w1", "w2"), PRIMES, strict=True)]
    out = stored(rows.select("conv", (F.col("i") + F.coalesce("n", F.lit(0))).alias("i"), "chars", *_DIGEST, *whole, *own), "turns")
    discard(local)
    return out


def head_length(conv: Column, most: int) -> Column:
    """How many turns a conversation takes from its base at most."""
    return (F.crc32(conv.cast("string").cast("binary")) % most).cast("long")


def prefixes(placed: DataFrame, total: int, seed: int, block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """All prefixes of all rebuilt conversations, and the conversations.

    Prefixes: conv, depth, chars and digest of the last turn, product f, product p one turn before. Conversations: conv, length.
    """
    first = F.struct("i", "chars", *_DIGEST, *_FOUND)
    convs = placed.groupBy("conv").agg(F.max("i").alias("own"), F.sort_array(F.collect_list(F.when(F.col("i") < most, first))).alias("heads"))
    convs = convs.withColumn("h", head_length(F.col("conv"), most)).withColumn("base", F.col("conv") - F.col("conv") % block)
    heads = convs.select(F.col("conv").alias("base"), F.col("heads").alias("taken"))
    convs = convs.join(heads, "base", "left").withColumn("taken", F.slice(F.coalesce("taken", F.array().cast(convs.schema["heads"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("k", F.size("taken").cast("long")).withColumn("length", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    zero = F.lit(0).cast("long")
    at_end = lambda array, n: [F.when(n > 0, F.try_element_at(F.col(array), n.cast("int"))[f]).otherwise(zero) for f in _FOUND]
    convs = convs.select("conv", "own", "h", "k", "length", "taken", *(c.alias(f"e{j}") for j, c in enumerate(at_end("taken", F.col("k")))), *(c.alias(f"s{j}") for j, c in enumerate(at_end("heads", F.col("h")))))
    convs = stored(convs, "conversations")
    # Head: the base's own prefixes.
    before = lambda array, j: F.when(j > 0, F.get(F.col(array), (j - 1).cast("int")))
    head = convs.filter("k > 0").select("conv", "length", "taken", F.posexplode("taken").alias("at", "turn"))
    head = head.select("conv", F.col("turn.i").alias("depth"), (F.col("turn.i") == F.col("length")).alias("is_end"), "turn.chars", *(f"turn.{d}" for d in _DIGEST), *(f"turn.{f}" for f in _FOUND), *(F.coalesce(before("taken", F.col("at"))[f], zero).alias(p) for f, p in zip(_FOUND, _BEFORE, strict=True)))
    # Suffix: (product up to i, less product up to h) moved from place h to place k, after the head.
    rows = placed.filter(F.col("i") > head_length(F.col("conv"), most))
    rows = spread_join(rows, convs.select("conv", "own", "h", "k", *(f"{x}{j}" for x in "es" for j in range(3))), ["conv"], "own", total, ["i"])
    rows = rows.select("*", (F.col("k") + F.col("i") - F.col("h")).alias("depth"), (F.col("i") == F.col("own")).alias("is_end"))
    for j, (b, p) in enumerate(zip(bases(seed), PRIMES, strict=True)):
        back = [pow(pow(b, -1, p), n, p) for n in range(most)]
        moved = F.element_at(F.array(*(F.lit(x).cast("long") for x in back)), (F.col("h") - F.col("k") + 1).cast("int"))
        rows = rows.withColumn(f"f{j}", (F.col(f"e{j}") + F.pmod(F.col(f"f{j}") - F.col(f"s{j}"), F.lit(p)) * moved % p) % p)
        rows = rows.withColumn(f"p{j}", F.pmod(F.col(f"f{j}") - F.col(f"t{j}") * moved % p, F.lit(p)))
    columns = ["conv", "depth", "is_end", "chars", *_DIGEST, *_FOUND, *_BEFORE]
    return stored(head.select(*columns).unionByName(rows.select(*columns)), "prefixes"), convs


def digests_of_ends(ends: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """NODE, ends_sha256 from ends (NODE, conv). Ids are put together in chunks where they were sorted; a node's chunks stream by."""
    names = [*NODE, "part", "place", "ids"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, held, place, part = None, [], 0, 0, 0

        def row() -> list[tuple]:
            return [(*last, part, place, ",".join(ids).encode())] if ids else []

        for batch in batches:
            out = []
            *keys, conv, parts = (c.to_pylist() for c in batch.columns)
            for key, c, q in zip(zip(*keys, strict=True), conv, parts, strict=True):
                if key != last or held >= chunk:
                    out += row()
                    place = place + 1 if key == last else 0
                    last, ids, held, part = key, [], 0, q
                text = str(c)
                ids.append(text)
                held += len(text) + 1
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in row()], schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def row() -> list[dict]:
            return [dict(zip([*NODE, "ends_sha256"], (*last, state.hexdigest()), strict=True))] if state else []

        for batch in batches:
            out = []
            *keys, ids = (c.to_pylist() for c in batch.columns)
            for key, text in zip(zip(*keys, strict=True), ids, strict=True):
                if key == last:
                    state.update(b",")
                else:
                    out += row()
                    last, state = key, hashlib.sha256()
                state.update(text)
            yield pa.RecordBatch.from_pylist(out, sums)
        yield pa.RecordBatch.from_pylist(row(), sums)

    schema = pa.schema([(n, pa.int64()) for n in names[:-1]] + [("ids", pa.binary())])
    sums = pa.schema([(n, pa.int64()) for n in NODE] + [("ends_sha256", pa.string())])
    numbers = ", ".join(f"{n} long" for n in NODE)
    rows = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").select(*NODE, "conv", F.spark_partition_id().cast("long").alias("part"))
    rows = rows.mapInArrow(chunks, f"{numbers}, part long, place long, ids binary")
    rows = rows.repartition(*NODE).sortWithinPartitions(*NODE, "part", "place").select(*NODE, "ids")
    return rows.mapInArrow(hashed, f"{numbers}, ends_sha256 string")


def verified_nodes(entries: DataFrame) -> DataFrame | None:
    """Nodes of the prefixes: NODE, conv_id, n_convs, chars, p0..; None if the members of one don't refer to equal turns."""
    checked = (*_DIGEST, *_BEFORE)
    ends = [f(c).alias(f"{c}_{n}") for c in checked for n, f in (("lo", F.min), ("hi", F.max))]
    nodes = entries.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *ends)
    nodes = stored(nodes, "nodes")
    differ = " OR ".join(f"{c}_lo <> {c}_hi" for c in checked)
    if not nodes.filter(differ).isEmpty():
        discard(nodes)
        return None
    return nodes.select(*NODE, "conv_id", "n_convs", "chars", *(F.col(f"{p}_lo").alias(p) for p in _BEFORE))


def prefix_trie(conversations: DataFrame, block: int = 100, most: int = 6, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c begins with the first h turns of c - c % block, h = crc32(c) % most, and goes on with its own after its
    first h.
    """
    small_batches(conversations.sparkSession, 10_000)
    turns = stored(stored_turns(conversations, conv_col, turn_col, role_col, text_col), "stored-turns")
    total, seed, nodes = turns.count(), 0, None
    while nodes is None:
        placed = placed_turns(turns, seed)
        entries, convs = prefixes(placed, total, seed, block, most)
        discard(placed)
        nodes = verified_nodes(entries)
        seed += 1
    discard(turns)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), *(zero.alias(f) for f in _FOUND), "conv_id", "n_convs", zero.alias("chars"), *(F.lit(-1).cast("long").alias(p) for p in _BEFORE))
    nodes = nodes.unionByName(root)
    parent = [(F.col("depth") - 1).alias("depth"), *(F.col(p).alias(f) for p, f in zip(_BEFORE, _FOUND, strict=True))]
    children = nodes.filter("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn("value", (F.col("n_convs") - 1) * F.col("chars"))
    # The nodes of which a conversation is the smallest member are the end of its path.
    nodes = stored(running_sums(nodes, [F.col("conv_id"), F.col("depth")], {"ahead": "value"}).drop("ahead_all"), "chains")
    chains = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.max(F.col("ahead") + F.col("value")).alias("upto"), F.min("ahead").alias("from"), F.count("*").alias("own_nodes"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    chains = stored(chains.select("conv", "upto", (F.col("upto") - F.col("from")).alias("held"), "own_nodes", "leaf").join(convs.select("conv", "length"), "conv"), "sums")
    members = spread_join(entries.select("conv", *NODE), chains.select("conv", "held", "leaf", "length"), ["conv"], "length", 2 * total, ["depth"])
    sums = [F.sum("held").alias("held_all"), F.sum("leaf").alias("n_leaves")]
    below = members.groupBy(*NODE).agg(*sums).unionByName(chains.agg(*sums).select(zero.alias("depth"), *(zero.alias(f) for f in _FOUND), "held_all", "n_leaves"))
    turnless = convs.filter("length = 0").select(zero.alias("depth"), *(zero.alias(f) for f in _FOUND), "conv")
    ends = digests_of_ends(entries.filter("is_end").select(*NODE, "conv").unionByName(turnless))
    out = stored(nodes.join(below, NODE).join(ends, NODE, "left"), "totals")
    out = spread_join(out, chains.select(F.col("conv").alias("conv_id"), "upto", "held", "own_nodes"), ["conv_id"], "own_nodes", total, ["depth"])
    saved = F.col("upto") - F.col("ahead") + F.col("held_all") - F.col("held")
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("_depth"), *(F.col(f).alias(p) for f, p in zip(_FOUND, _BEFORE, strict=True)), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = parents.withColumnsRenamed({"_depth": "depth", "n_children": "children"})
    out = out.withColumn("saved_tokens", saved).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    out = spread_join(out, parents, ["depth", *_BEFORE], "children", total, ["conv_id"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
