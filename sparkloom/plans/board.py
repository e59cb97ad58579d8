"""Queries of boards, projects and item trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import maintain, ranking, trees
from ..sources import tables
from ..sources.storage import stored
from .catalog import query

COLUMNS = ("O", "F", "P")
NAMES = ("open", "finished", "pending")
_PIVOT = "count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus IN ('O', 'F', 'P')) AS total"


@query(f"SELECT o_orderpriority AS lane, {_PIVOT} FROM orders GROUP BY 1")
def board_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return trees.board(tables.cards(spark, folder), COLUMNS, F.count("number"), NAMES)


@query("SELECT o_orderstatus AS \"column\", count(*) AS cards, round(sum(o_totalprice), 2) AS points FROM orders GROUP BY 1")
def column_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.cards(spark, folder).groupBy("column").agg(F.count("*").alias("cards"), F.round(F.sum("points"), 2).alias("points"))


@query(f"WITH n AS (SELECT n_nationkey AS k, n_name FROM nation), c AS (SELECT c_custkey, c_nationkey FROM customer) SELECT coalesce(n_name, 'none') AS lane, {_PIVOT} FROM orders LEFT JOIN c ON c_custkey = o_custkey LEFT JOIN n ON k = c_nationkey GROUP BY 1")
def epic_board(spark: SparkSession, folder: str) -> DataFrame:
    """Cards under the nation of their project; a lane of its own for those without."""
    projects = tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("project_id"), "c_nationkey")
    epics = tables.table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = tables.cards(spark, folder).drop("lane").join(projects, "project_id", "left").join(epics, "c_nationkey", "left")
    return trees.board(rows.withColumn("lane", F.coalesce("n_name", F.lit("none"))), COLUMNS, F.count("number"), NAMES)


@query("SELECT o_custkey AS project_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) - count(*) FILTER (o_orderstatus = 'O') AS closed FROM orders GROUP BY 1")
def project_stats(spark: SparkSession, folder: str) -> DataFrame:
    n = F.count_if(F.col("column") == "O")
    return tables.cards(spark, folder).groupBy("project_id").agg(F.count("*").alias("total"), n.alias("open"), (F.count("*") - n).alias("closed"))


@query("SELECT c_custkey AS project_id, coalesce(max(o_orderkey), 0) + 1 AS next_number FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def next_numbers(spark: SparkSession, folder: str) -> DataFrame:
    top = tables.cards(spark, folder).groupBy("project_id").agg(F.max("number").alias("top"))
    projects = tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("project_id"))
    return projects.join(top, "project_id", "left").select("project_id", (F.coalesce("top", F.lit(0)) + 1).alias("next_number"))


@query("SELECT conv_id AS project_id, role, coalesce(max(turn), -1) + 1 AS next_position FROM conversations GROUP BY 1, 2")
def next_positions(spark: SparkSession, folder: str) -> DataFrame:
    return tables.work_items(spark, folder).groupBy("project_id", "role").agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("next_position"))


@query("SELECT o_orderkey AS number, o_orderpriority AS lane, o_orderstatus AS \"column\", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderdate, o_orderkey) AS place FROM orders")
def board_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Cards of each project by column, then by date."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("column", "created", "number"))
    return tables.cards(spark, folder).select("number", "lane", "column", place.alias("place"))


@query("SELECT o_orderkey AS number, o_totalprice AS points FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 30 OFFSET 5")
def list_cards(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.cards(spark, folder).filter("column = 'P'")
    return ranking.page(rows, [F.desc("number")], 30, 5).select("number", "points")


@query("SELECT o_orderkey AS number FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND contains(lower(o_orderpriority), 'urg')")
def filtered_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Column, any of some lanes, and a case-insensitive part of the lane's name."""
    lane = F.col("lane")
    return tables.cards(spark, folder).filter((F.col("column") == "O") & lane.isin("1-URGENT", "2-HIGH") & F.contains(F.lower(lane), F.lit("urg"))).select("number")


@query("""
    WITH RECURSIVE r AS (
        SELECT conv_id, turn, turn AS top, 0 AS depth FROM conversations
        UNION ALL SELECT r.conv_id, r.turn, c.turn, r.depth + 1 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.top - 1)
    SELECT conv_id || '/' || turn AS item_id, conv_id || '/' || min(top) AS root_id, max(depth)::BIGINT AS depth FROM r GROUP BY conv_id, turn""")
def root_closure(spark: SparkSession, folder: str) -> DataFrame:
    """The root above every item, and how far up it is."""
    return trees.roots(tables.work_items(spark, folder))


@query("SELECT p.conv_id || '/' || p.turn AS parent_id, c.conv_id || '/' || c.turn AS child_id, c.turn AS position FROM conversations p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn + 1")
def child_items(spark: SparkSession, folder: str) -> DataFrame:
    return trees.children(tables.work_items(spark, folder))


@query("""
    WITH RECURSIVE l AS (SELECT DISTINCT 'part/' || l_partkey AS a, 'supplier/' || l_suppkey AS b FROM lineitem),
    g AS (SELECT a AS src, b AS dst FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT 'supplier/' || s_suppkey AS node, 0 AS depth FROM supplier WHERE s_acctbal < 0 UNION SELECT dst, depth + 1 FROM r JOIN g ON src = node WHERE depth < 3)
    SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def crawl_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and suppliers reached in three steps from suppliers in debt, over all that were ever ordered together."""
    part, supplier = (F.concat(F.lit(f"{k}/"), f"l_{c}key") for k, c in (("part", "part"), ("supplier", "supp")))
    ordered = tables.table(spark, folder, "lineitem").select(part.alias("src"), supplier.alias("dst")).distinct()
    links = stored(ordered.unionByName(ordered.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "links")
    seeds = tables.table(spark, folder, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("node"))
    return trees.reach(links, seeds, 3)


@query("SELECT a.o_orderkey AS number, a.o_orderpriority AS lane, CASE WHEN a.o_orderstatus = 'O' THEN b.p + (CASE WHEN b.p >= 3 THEN 1 ELSE 0 END) ELSE b.p END AS position FROM orders a JOIN (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS p FROM orders) b USING (o_orderkey)")
def shift_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Make room at position 3 of the open column of every project."""
    w = Window.partitionBy("project_id", "column").orderBy("number")
    rows = tables.cards(spark, folder).withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    return maintain.shift(rows, F.col("column") == "O", 3, 1).select("number", "lane", "position")


@query("SELECT number, CASE WHEN p = 1 THEN 4 WHEN p > 1 AND p <= 4 THEN p - 1 ELSE p END AS position FROM (SELECT o_orderkey AS number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders)")
def epic_reorder(spark: SparkSession, folder: str) -> DataFrame:
    """Move the card at position 1 of every project to position 4."""
    w = Window.partitionBy("project_id").orderBy("number")
    rows = tables.cards(spark, folder).withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    return rows.select("number", maintain.moved(F.col("position"), 1, 4).alias("position"))


@query("SELECT o_orderkey AS number, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority FROM orders")
def priority_labels(spark: SparkSession, folder: str) -> DataFrame:
    n = F.substring("lane", 1, 1).cast("int")
    label = F.when(n == 1, "critical").when(n == 2, "high").when(n == 3, "medium").otherwise("low")
    return tables.cards(spark, folder).select("number", label.alias("priority"))


@query("SELECT p_partkey AS entry_id, p_container, ok FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'epic' WHEN 1 THEN 'story' ELSE 'task' END AS p_container, CASE p_size % 3 WHEN 0 THEN p_partkey % 2 = 0 WHEN 1 THEN p_partkey % 2 = 0 ELSE false END AS ok FROM part)")
def containment(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an item of each kind may hold a task (even keys) or a story (odd keys)."""
    size = F.col("p_size") % 3
    kind = F.when(size == 0, "epic").when(size == 1, "story").otherwise("task")
    child = F.when(F.col("p_partkey") % 2 == 0, "task").otherwise(F.when(size == 0, "epic").otherwise("story"))
    rows = tables.table(spark, folder, "part").select(F.col("p_partkey").alias("entry_id"), kind.alias("p_container"), child.alias("child"))
    return rows.select("entry_id", "p_container", trees.can_contain(F.col("p_container"), F.col("child")).alias("ok"))
