"""Job events: rates, progress, states, limits; as tables and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.storage import shared_dir

TERMINAL = ("error", "purchase")
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def rate(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Of each event: how many of its job fell in the window up to it, and per second between first and last of them."""
    w = Window.partitionBy("job_id").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    rows = events.withColumn("_us", _micros(F.col("ts"))).withColumn("samples", F.count("*").over(w))
    span = (F.max("_us").over(w) - F.min("_us").over(w)) / 1e6
    return rows.withColumn("rate", F.when(span > 0, F.round(F.col("samples") / span, 6)).otherwise(0.0)).drop("_us")


def progress(events: DataFrame) -> DataFrame:
    """Running number of events of each job, percent of all of them, and seconds left at the pace so far."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    whole = Window.partitionBy("job_id")
    done, total = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.count("*").over(whole)
    since = (_micros(F.col("ts")) - _micros(F.min("ts").over(whole))) / 1e6
    rows = events.withColumn("done", done).withColumn("total", total).withColumn("_since", since)
    left = F.col("_since") / F.col("done") * (F.col("total") - F.col("done"))
    return rows.withColumn("percent", F.round(100.0 * F.col("done") / F.col("total"), 4)).withColumn("seconds_left", F.round(left, 3)).drop("_since")


def last_state(events: DataFrame) -> DataFrame:
    """The state of each job's last event, when it was, and whether it ends the job."""
    last = events.groupBy("job_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))
    return last.withColumn("ended", F.col("state").isin(*TERMINAL))


def gaps(events: DataFrame, least: float) -> DataFrame:
    """Events that came sooner than `least` seconds after the one before of the same job."""
    before = F.lag("ts").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    rows = events.withColumn("gap", F.round((_micros(F.col("ts")) - _micros(before)) / 1e6, 3))
    return rows.filter(F.col("gap") < least)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of events of a job without a longer pause."""
    grouped = events.groupBy("job_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"))
    return grouped.select("job_id", F.col("s.start").alias("start"), "events")


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and values by window and state; with `late`, a stream drops what comes later than that."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy(F.window("ts", size).alias("w"), "state").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "state", "events", "value")


def admitted(jobs: DataFrame, cap: int) -> DataFrame:
    """The jobs a queue of `cap` places takes: higher priority first, then older."""
    return jobs.orderBy(F.desc("priority"), "created", "job_id").limit(cap)


def backoff(attempt: Column, base_ms: int, most_ms: int = 60_000) -> Column:
    return F.least(F.lit(base_ms) * F.pow(F.lit(2), attempt), F.lit(most_ms)).cast("long")


def as_message(events: DataFrame) -> DataFrame:
    """Each event as the text of a server-sent event."""
    body = F.to_json(F.struct("job_id", "state", "value"))
    return events.select("event_id", F.concat(F.lit("event: "), F.col("state"), F.lit("\ndata: "), body, F.lit("\n\n")).alias("message"))


def event_stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """The events table as a stream of its files, with the names of the job view."""
    rows = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return rows.select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), "ts", "value")


def run_to_end(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a stream over all that is there, and give the folder of its sink (unless `each` takes the batches)."""
    import uuid

    at = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if each is None:
        writer = writer.format("parquet").option("path", f"{at}/sink")
    else:
        writer = writer.foreachBatch(each)
    writer.start().awaitTermination()
    return f"{at}/sink"


def job_states(stream: DataFrame) -> DataFrame:
    """A job's progress as a stream: its number of events so far and the state of the latest, after each batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events, ts, last = state.get if state.exists else (0, 0, "")
        for batch in batches:
            events += len(batch)
            newest = batch.sort_values(["ts", "event_id"]).iloc[-1]
            us = int(newest["ts"].value // 1000)
            if us >= ts:
                ts, last = us, newest["state"]
        state.update((events, ts, last))
        yield pd.DataFrame({"job_id": [key[0]], "events": [events], "state": [last], "ended": [last in TERMINAL]})

    keyed = stream.groupBy("job_id")
    return keyed.applyInPandasWithState(step, "job_id long, events long, state string, ended boolean", "events long, ts long, state string", "append", GroupStateTimeout.NoTimeout)


def silent(events: DataFrame, key: str, now: Column, seconds: int) -> DataFrame:
    """Keys whose last event is older than that: connections to close, items to give up."""
    last = events.groupBy(key).agg(F.max("ts").alias("last"))
    return last.filter(_micros(F.col("last")) < _micros(now) - seconds * 1_000_000)


def append_history(jobs: DataFrame, path: str) -> None:
    """Add ended jobs to the history; jobs that are in it already stay as they are."""
    spark = jobs.sparkSession
    try:
        known = spark.read.parquet(path).select("job_id")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = jobs.select("job_id").limit(0)
    jobs.filter("ended").join(known, "job_id", "left_anti").write.mode("append").parquet(path)
