"""Path rules of many hosts as a table, met with addresses by hash joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def judged(addresses: DataFrame, rules: DataFrame, longest: bool = True, salts: int = 8) -> DataFrame:
    """addresses (id, host, path), rules (host, kind 'allow' or 'disallow', rule) to id, allowed, rule (that decided, or null).

    Of the rules that match an address the longest decides, and allow wins among equally long ones; with longest=False
    any allow rule wins over all others. Addresses that no rule matches are allowed; empty and null rules match nothing.
    Ids are unique; a null host has no rules, a null path is an empty one.

    A rule is looked up by its literal beginning (up to the first * or a final $): each path is cut to the lengths that
    its host's rules have, and these beginnings meet the rules by equality, so no address is tried with rules that
    begin otherwise. Patterns are tested afterwards. Rules are copied `salts` times, so that a hot host's addresses go
    to as many tasks for each beginning.
    """
    kept = rules.filter("host is not null and rule <> '' and kind in ('allow', 'disallow')").select("host", "kind", "rule").distinct()
    plain = ~(F.contains("rule", F.lit("*")) | F.endswith("rule", F.lit("$")))
    start = F.regexp_replace(F.substring_index("rule", "*", 1), r"\$$", "")
    kept = kept.withColumn("plain", plain).withColumn("start", F.when(plain, F.col("rule")).otherwise(start))
    lengths = kept.groupBy("host").agg(F.collect_set(F.length("start")).alias("lengths"))  # no more than the longest rule has characters
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    rows = addresses.select("id", "host", F.coalesce("path", F.lit("")).alias("path"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    rows = rows.join(lengths.select("host", "lengths", salt), ["host", "salt"], "left")
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    # The first of an address stands for it where nothing matches.
    rows = rows.select("id", "host", "path", "salt", F.posexplode_outer(fits).alias("nth", "length"))
    rows = rows.withColumn("start", F.substring(F.col("path"), F.lit(1), F.col("length")))
    rows = rows.join(kept.select("*", salt), ["host", "start", "salt"], "left")
    hit = F.col("rule").isNotNull() & (F.col("plain") | F.regexp_like("path", urls.rule_pattern(F.col("rule"))))
    rows = rows.withColumn("hit", F.coalesce(hit, F.lit(False))).filter("hit or coalesce(nth, 0) = 0")
    allows = F.col("kind") == "allow"
    order = [F.length("rule").alias("size"), allows.alias("allows")]
    best = F.struct(*(order if longest else order[::-1]), F.col("rule").alias("rule"))
    out = rows.groupBy("id").agg(F.max(F.when(F.col("hit"), best)).alias("best"))
    return out.select("id", F.coalesce("best.allows", F.lit(True)).alias("allowed"), F.col("best.rule").alias("rule"))
