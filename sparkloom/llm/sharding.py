"""Sharding by balanced label propagation, in DataFrame operations only.

Documents start in shards by hashed rank, so counts are at most one apart. Documents with equal texts are linked. In
each round a group ranks the shards by how much of it they hold, and asks its members over from the last of them to the
places that unlinked documents take up in the first of them, as long as they come before the mover's own; so a group
larger than a shard fills all its shards in the same round. A move into a shard is granted while that shard has an
unlinked document left to send back to where the mover came from. Such swaps keep all counts as they are, lower the
number of links that cross shards, and need no lock. Rounds end when nothing moves, and they do end: members move only
to a shard that holds at least as many of their group, so each swap raises the sum over groups and shards of held
squared, which is bounded.

Law `rows`: counts are at most one apart. Defined results: a null text has no bytes and is equal to other null texts
(and to empty ones); null ids are kept; repeated rows are rows of their own; texts of any length count by their hash; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, hex_digits, prefix_sums, spread_join, stored

_KEPT = ("rid", "doc_id", "size", "text_crc32", "key", "shard")


def _place(df: DataFrame, digits: int, parts: list[str], name: str) -> DataFrame:
    """Gapless ranks from 0 within parts, in key order."""
    return prefix_sums(df, parts, "key", digits, ["rid"], F.lit(1).cast("long"), name)


def _sub(pieces: int) -> Column:
    return F.pmod(F.xxhash64("rid"), F.lit(pieces))


def _round(linked: DataFrame, fillers: DataFrame, digits: int, pieces: int, turn: int) -> tuple[DataFrame, DataFrame] | None:
    """One round of proposals, quotas and swaps; None if nothing moves."""
    quota = fillers.groupBy("shard").agg(F.count("*").alias("free"))  # a row for each shard at most
    linked = linked.withColumn("sub", _sub(pieces))
    units = linked.groupBy("gkey", "shard", "sub").agg(F.count("*").alias("want"), F.first("group_size").alias("group_size"))
    held = units.groupBy("gkey", "shard").agg(F.sum("want").alias("held")).join(F.broadcast(quota), "shard", "left")
    # A group's shards in order of liking (as many rows as there are shards at most), and the open ones among them.
    liking = [F.desc("held"), F.col("free").isNull(), F.xxhash64("gkey", "shard"), F.col("shard")]
    before = Window.partitionBy("gkey").orderBy(*liking).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("gkey").orderBy(*liking)))
    held = held.withColumn("start", F.coalesce(F.sum("free").over(before), F.lit(0)))
    goals = held.filter("free is not null").groupBy("gkey").agg(F.sort_array(F.collect_list(F.struct("start", "place", "shard"))).alias("goals"))
    movers = held.select("gkey", "shard", "place").join(goals, "gkey").filter(F.col("place") > F.element_at("goals", 1)["place"])
    asked = units.join(movers, ["gkey", "shard"])
    # Members are numbered from the last shard on, and go where the places of that number are.
    ahead = Window.partitionBy("gkey").orderBy(F.desc("place"), "sub").rowsBetween(Window.unboundedPreceding, -1)  # shards x pieces rows at most
    asked = asked.withColumn("at", F.coalesce(F.sum("want").over(ahead), F.lit(0)))
    goal = F.element_at(F.filter("goals", lambda t: t["start"] <= F.col("at")), -1)
    asked = asked.withColumn("goal", goal).filter(F.col("goal.place") < F.col("place")).withColumn("to", F.col("goal.shard")).drop("goals", "goal", "at", "place")
    # Small groups come first: they need few places, and a large one has others. Within a power of two by chance.
    rank = F.hex(F.least(F.lit(15), F.floor(F.log2("group_size"))).cast("long"))
    asked = asked.withColumn("order", F.concat(rank, F.sha2(F.concat_ws(":", F.hex("gkey"), "shard", "sub", F.lit(turn)), 256)))
    asked = prefix_sums(asked, ["to"], "order", digits + 1, [], F.col("want"), "before")
    asked = asked.join(F.broadcast(quota.withColumnRenamed("shard", "to")), "to")
    granted = asked.withColumn("take", F.least(F.col("want"), F.greatest(F.col("free") - F.col("before"), F.lit(0)))).filter("take > 0")
    granted = granted.select("gkey", "shard", "sub", "to", "take", "before")
    # The members that go, numbered from 0 within the shard they go to; the filler of that number comes in return.
    nth = F.row_number().over(Window.partitionBy("gkey", "shard", "sub").orderBy("key", "rid")) - 1
    going = linked.join(granted.withColumnRenamed("take", "_take"), ["gkey", "shard", "sub"]).withColumn("nth", nth)
    going = stored(going.filter("nth < _take").select("rid", "to", F.col("shard").alias("from"), (F.col("before") + F.col("nth")).alias("number")), "going")
    if going.isEmpty():
        return None
    numbered = _place(fillers, digits, ["shard"], "number")
    back = going.select(F.col("to").alias("shard"), "number", "from")
    fillers = numbered.join(back, ["shard", "number"], "left").withColumn("shard", F.coalesce("from", "shard")).select(*fillers.columns)
    arrived = going.select("rid", F.col("to"))
    linked = stored(linked.join(arrived, "rid", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to", "sub"), "linked")
    fillers = stored(fillers.select(*_KEPT), "fillers")
    discard(going)
    return linked, fillers


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    nodes = stored(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("gkey"),
            F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)).alias("key"),
        ),
        "nodes",
    )
    n = nodes.count()
    digits, pieces = hex_digits(n), max(16, n // 100_000)
    start = _place(nodes.withColumn("all", F.lit(0)), digits, ["all"], "rank").withColumn("shard", (F.col("rank") % shards).cast("int")).drop("all", "rank")
    # A group's size is wanted by each of its rows: the rows of a hot text are joined where they are.
    sizes = nodes.groupBy("gkey").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    marked = stored(spread_join(start, sizes, ["gkey"], "group_size", n, ["rid"], "left"), "marked")
    linked = marked.filter("group_size is not null").select(*_KEPT, "gkey", "group_size")
    fillers = marked.filter("group_size is null").select(*_KEPT)
    for turn in count():
        moved = _round(linked, fillers, digits, pieces, turn)
        if moved is None:
            break
        discard(linked, fillers)
        linked, fillers = moved
    both = linked.select(*_KEPT, "group_size").unionByName(fillers.withColumn("group_size", F.lit(1).cast("long")))
    placed = _place(both, digits, ["shard"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_size")
