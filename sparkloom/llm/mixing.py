"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source rows are ranged by key into buckets, bucket totals give distributed
prefix sums of sizes (in two levels, so that neither a hot source nor the number of buckets weighs on one task), and
each source is cut at its exact budget: whole epochs first, then the rows in key order until the rest of the budget is
used up, the last row in part: its first words, with the white space between them. Targets stop at a multiple of the
source's size; what is cut off is shared out again by weight. Sources themselves are ranked and summed over ranges.

Defined results: a null text has size 0; a null source is a source of its own and comes last; identical rows (same id,
same text) are rows of their own, which may swap their takes, whose sum is defined. Weights repeat along the sources in
code-point order. Texts of any length are counted whole. Other columns are kept by mix() whatever their names and ignored
by plan_mix(). Empty input gives empty output. Identical rows share one key, so they are numbered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, bucket_offsets, hex_digits, running_sums, stored


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def source_targets(totals: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """totals: source, source_size; adds weight and target (double).

    Sources in order of size over weight: a source is full while its cap is at most its share of what the sources
    before it leave over. This is where sharing the excess again and again ends.
    """
    named = running_sums(totals.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], {"_place": "_one"})
    out = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("long"))
    ratio = F.col("source_size") / F.col("weight")
    out = out.withColumn("_cap", F.col("source_size") * most)
    out = running_sums(out, [ratio, F.col("source").asc_nulls_last()], {"_caps": "_cap", "_weights": "weight", "_sizes": "source_size"})
    out = (
        out.withColumn("_left", F.col("_sizes_all") - F.col("_caps"))
        .withColumn("_weight_left", F.col("_weights_all") - F.col("_weights"))
        .withColumn("_full", F.col("_cap").cast("double") * F.col("_weight_left") <= F.col("weight").cast("double") * F.col("_left"))
    )
    first = out.agg(F.min(F.when(~F.col("_full"), F.struct(ratio.alias("r"), (-F.col("_left")).alias("l"), (-F.col("_weight_left")).alias("w")))).alias("_first"))
    out = out.crossJoin(F.broadcast(first))  # one row: what the first source that isn't full is left with
    share = (F.col("weight") * F.col("_first.l")).cast("double") / F.col("_first.w")
    return out.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share)).select("source", "source_size", "weight", "target")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3, row_col: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, source, _key, size, source_size, target, epochs, part, taken.

    epochs: how often the whole document is taken; part: words of it that are taken once more. With row_col, a column of
    docs that tells its rows apart, its values come as _row.
    """
    row = [F.col(row_col).alias("_row")] if row_col else []
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words(F.col(text_col)).alias("size"),
            _key(F.col(id_col), F.col(text_col)).alias("_key"),
            *row,
        ).withColumn("_source", F.when(F.col("source").isNull(), "z").otherwise(F.concat(F.lit("a"), F.col("source")))),
        "sized",
    )
    digits = hex_digits(sized.count())
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = targets.withColumn("_source", F.when(F.col("source").isNull(), "z").otherwise(F.concat(F.lit("a"), F.col("source")))).drop("source")
    # The targets ride along with the buckets, so that a hot source is never one key of a join with documents.
    bucket = F.substring("_key", 1, digits)
    rows = sized.withColumn("_bucket", bucket)
    totals = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_total"))
    offsets = bucket_offsets(totals, ["_source"], digits).join(targets, "_source")
    local = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", *["_row"] * bool(row)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_local", F.coalesce(F.sum("size").over(local), F.lit(0))).join(offsets, ["_source", "_bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("_offset") - F.col("_local"), F.lit(0)), F.col("size"))
    out = rows.withColumn("epochs", whole).withColumn("part", part)
    return out.select("doc_id", "source", "_key", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), *["_row"] * bool(row))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: rows of docs with its columns, each repeated as often as it is taken; the last in part, cut after a word.

    A row of size 0 is kept once if its source is taken at all. Every row takes what the plan gives to it, identical ones too:
    rows are numbered and stored, and meet the plan by their number, which no two share.
    """
    columns = docs.columns
    shown = [f"_c{i}" for i in range(len(columns))]
    at = {c: shown[columns.index(c)] for c in (id_col, text_col, source_col)}
    body = stored(docs.toDF(*shown).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    plan = plan_mix(body, at[id_col], at[text_col], at[source_col], weights, most, "_row")
    plan = plan.select("_row", F.col("epochs").alias("_epochs"), F.col("part").alias("_rest"), F.col("size").alias("_size"), F.col("target").alias("_target"))
    whole = F.col("_epochs") + F.when(F.col("_rest") == F.col("_size"), 1).otherwise(0)
    times = F.when(F.col("_size") > 0, whole).otherwise((F.col("_target") > 0).cast("int")).cast("int")
    rest = F.when(F.col("_rest") < F.col("_size"), F.col("_rest")).otherwise(F.lit(0)).cast("int")
    rows = body.join(plan, "_row").withColumn("_times", times).withColumn("_rest", rest)
    takes = F.concat(F.array_repeat(F.lit(-1), F.col("_times")), F.when(F.col("_rest") > 0, F.array(F.col("_rest"))).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_take", F.explode(takes))
    head = _head(at[text_col])
    rows = rows.withColumn(at[text_col], F.when(F.col("_take") < 0, F.col(at[text_col])).otherwise(head))
    return rows.select(*(F.col(s).alias(c) for s, c in zip(shown, columns, strict=True)))


def _head(text: str) -> Column:
    """The first _take words of a text with all white space before them."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.col("_take"), F.lit(1))), "")
