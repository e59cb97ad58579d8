"""Parents and children, reach over links, and boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored


def roots(items: DataFrame, most_steps: int = 64) -> DataFrame:
    """item_id, root_id, depth by pointer doubling: each round joins every item to its ancestor's ancestor.

    Items whose chain runs in a circle get the least item of the circle as root and a null depth. most_steps bounds the
    number of doublings; 64 reach any chain.
    """
    now = items.select("item_id", F.coalesce("parent_id", "item_id").alias("up"), F.when(F.col("parent_id").isNotNull(), 1).otherwise(0).cast("long").alias("depth"))
    known = items.select(F.col("item_id").alias("known"))
    now = now.join(known, F.col("up") == F.col("known"), "left").withColumn("lost", F.col("known").isNull())
    # An item whose parent is missing is a root itself.
    now = now.select("item_id", F.when(F.col("lost"), F.col("item_id")).otherwise(F.col("up")).alias("up"), F.when(F.col("lost"), F.lit(0)).otherwise(F.col("depth")).alias("depth"))
    now = stored(now, "roots")
    for _ in range(most_steps):
        above = now.select(F.col("item_id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        step = now.join(above, "up").select("item_id", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        step = stored(step, "roots")
        going = step.filter("moved").agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
        now = step.drop("moved")
        if not going["n"] or going["d"] > 1 << 40:
            break
    stop = now.filter("depth <= " + str(1 << 40)).select("item_id", F.col("up").alias("root_id"), "depth")
    circle = now.filter("depth > " + str(1 << 40)).select("item_id", F.least("item_id", "up").alias("root_id"), F.lit(None).cast("long").alias("depth"))
    return stop.unionByName(circle)


def children(items: DataFrame) -> DataFrame:
    """parent_id, child_id, position, in the order of positions."""
    parents = items.select(F.col("item_id").alias("parent_id"))
    kids = items.filter("parent_id is not null").select("parent_id", F.col("item_id").alias("child_id"), "position")
    return kids.join(parents, "parent_id", "left_semi")


def reach(links: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """Nodes reached from seeds (node) over links (src, dst) in at most `depth` steps, with the fewest steps.

    With `most`, each step's new nodes are cut, in order, to what is left of the number of nodes.
    """
    seen = stored(seeds.select("node", F.lit(0).alias("depth")).distinct(), "reach")
    edge = seen
    for step in range(1, depth + 1):
        new = edge.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = new.join(seen, "node", "left_anti").withColumn("depth", F.lit(step))
        if most is not None:
            new = new.orderBy("node").limit(max(0, most - seen.count()))
        edge = stored(new, "reach")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def board(cards: DataFrame, columns: Sequence[str], value: Column, names: Sequence[str]) -> DataFrame:
    """lane by column: one column of `names` for each of `columns`, and their total. Other columns are left out."""
    known = cards.filter(F.col("column").isin(*columns))
    grid = known.groupBy("lane").pivot("column", list(columns)).agg(value)
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(n) for c, n in zip(columns, names, strict=True)]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))
    return grid.select("lane", *filled, total.alias("total"))


#: Which kinds of items a kind may hold: fixed values.
HOLDS = {"epic": ("story", "task", "bug"), "story": ("task", "subtask"), "task": ("subtask",), "bug": ("subtask",), "subtask": ()}


def can_contain(kind: Column, child: Column) -> Column:
    out = F.lit(False)
    for k, may in HOLDS.items():
        out = F.when(kind == k, child.isin(*may)).otherwise(out) if may else out
    return out
