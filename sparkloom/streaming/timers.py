"""Streams that depend on time: jobs that fall silent, rows that come too late, submissions and their outcomes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.storage import shared_dir, stored
from .jobs import run_to_end

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_slices(rows: DataFrame, number: Column, slices: int, name: str, files: int = 1) -> str:
    """Write rows as `slices` slices of so many files, one after another, so that a stream of the folder takes them in that order."""
    at = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for k in range(slices):
        part = rows.filter(number == k)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(at)
    return at


def files_of_slices(rows: DataFrame, number: Column, slices: int, least: int = 100_000) -> int:
    """How many files each slice can have with `least` rows in each; 1 where a slice has fewer rows, so that no file is left out for want of rows."""
    sizes = rows.groupBy(number.alias("slice")).count().filter(F.col("slice").between(0, slices - 1)).agg(F.count("*"), F.min("count")).first()
    return max(1, sizes[1] // least) if sizes[0] == slices else 1


def slice_stream(spark: SparkSession, at: str, schema: StructType, files: int = 1) -> DataFrame:
    """The slices as a stream, one (of `files` files) in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(at)


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keeps state outside of the heap; the session's own store is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def silences(stream: DataFrame, seconds: int, late: str) -> DataFrame:
    """A row whenever a job falls silent for more than `seconds`: job_id, last (its last event), events (since it was last silent).

    stream: job_id, ts, in time order up to `late`, beyond which rows are dropped. A run of events is a session, which ends
    `seconds` after its last event and is given, and its state dropped, once the watermark is there. An event at the very
    end still belongs to it.
    """
    rows = stream.select("job_id", "ts").withWatermark("ts", late)
    runs = rows.groupBy("job_id", F.session_window("ts", f"{seconds} seconds")).agg(F.max("ts").alias("last"), F.count("*").alias("events"))
    return runs.select("job_id", F.col("last").cast("timestamp_ntz").alias("last"), "events")


def over_in_state(left: DataFrame, late: str) -> DataFrame:
    """Of the runs (job_id, start, end, last, events) that a stream of silences() ends with: those that are over all the same.

    A run is over once its job has spoken again, or the newest row is `late` after its end; the stream's watermark gives
    it later, and counts whole milliseconds. What is left are the runs of the last moments, the newest row's among them.
    """
    again = F.lead("start").over(Window.partitionBy("job_id").orderBy("start")).isNotNull()
    newest = left.agg(F.max("last").alias("newest"))  # one row
    rows = left.withColumn("again", again).crossJoin(F.broadcast(newest))
    rows = rows.filter(F.col("again") | (F.col("end") <= F.col("newest") - F.expr(f"INTERVAL {late}")))
    return rows.select("job_id", F.col("last").cast("timestamp_ntz").alias("last"), "events")


def run_silences(stream: DataFrame, seconds: int, late: str) -> DataFrame:
    """silences() of all that is there, as a table, with the runs that are over when the stream ends."""
    spark = stream.sparkSession
    with state_in_rocksdb(spark):
        sink = run_to_end(silences(stream, seconds, late), "silences")
        left = spark.read.format("statestore").load(f"{sink.removesuffix('sink')}checkpoint").select("value.*")
        left = left.select("job_id", "session_window.*", F.col("max").alias("last"), F.col("count").alias("events"))
        over = stored(over_in_state(left, late), "silences-over")
    return spark.read.schema(over.schema).parquet(sink).unionByName(over)


class Losses:
    """Counts by window of a stream, and what each batch lost by coming later than `late` seconds behind the newest row before it.

    A row is lost if its window had ended at the watermark that held when its batch began, as in Spark's own windows. Each
    batch is aggregated once, its lost rows apart from the others, so that nothing goes uncounted. Folders are named by the
    batch, so a batch that runs again takes its own place.
    """

    SUMS = "start timestamp_ntz, state string, lost boolean, events long, value double, newest long"

    def __init__(self, spark: SparkSession, size: str, late: int) -> None:
        self.spark, self.size, self.late = spark, size, late
        self.at = f"{shared_dir(spark)}/losses-{uuid.uuid4().hex}"
        spark.createDataFrame([], self.SUMS).withColumn("batch", F.lit(0)).write.partitionBy("batch").parquet(self.at)

    def _sums(self) -> DataFrame:
        return self.spark.read.schema(self.SUMS + ", batch int").parquet(self.at)

    def batches(self) -> DataFrame:
        """batch, seen, lost, newest (microseconds): what each batch had."""
        lost = F.sum(F.when(F.col("lost"), F.col("events")).otherwise(0))
        return self._sums().groupBy("batch").agg(F.sum("events").alias("seen"), lost.alias("lost"), F.max("newest").alias("newest"))

    def windows(self) -> DataFrame:
        """start, state, events, value of the rows that weren't lost."""
        rows = self._sums().filter("not lost")
        return rows.groupBy("start", "state").agg(F.sum("events").alias("events"), F.round(F.sum("value"), 4).alias("value"))

    def each(self, batch: DataFrame, number: int) -> None:
        newest = self._sums().filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        window, us = F.window("ts", self.size), F.unix_micros("ts")
        lost = F.unix_micros("w.end") <= F.lit(newest - self.late * 1_000_000) if newest is not None else F.lit(False)
        rows = batch.select(window.alias("w"), "state", "value", us.alias("us")).withColumn("lost", lost)
        sums = rows.groupBy("w", "state", "lost").agg(F.count("*").alias("events"), F.sum("value").alias("value"), F.max("us").alias("newest"))
        sums = sums.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "state", "lost", "events", "value", "newest")
        sums.write.mode("overwrite").parquet(f"{self.at}/batch={number}")


def counted_windows(stream: DataFrame, size: str, late: int) -> Losses:
    """Run a stream of events to its end; its windows and the losses of its batches."""
    losses = Losses(stream.sparkSession, size, late)
    run_to_end(stream, "counted", each=losses.each)
    return losses


def outcomes(submitted: DataFrame, ended: DataFrame, within: str, late: str) -> DataFrame:
    """Each submission (job_id, ts, event_id) with every outcome (same columns) of its job within that time after it, or without one.

    Two streams: state is kept for `within` and `late` only; a submission without an outcome is given once none can come.
    """
    a = submitted.select("job_id", F.col("event_id").alias("submission"), F.col("ts").alias("since")).withWatermark("since", late)
    b = ended.select(F.col("job_id").alias("_job"), F.col("event_id").alias("outcome"), F.col("ts").alias("at")).withWatermark("at", late)
    near = (F.col("job_id") == F.col("_job")) & (F.col("at") >= F.col("since")) & (F.col("at") <= F.col("since") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near, "leftOuter").select("job_id", "submission", "since", "outcome", "at")


def run_outcomes(submitted: DataFrame, ended: DataFrame, within: str, late: str) -> DataFrame:
    """outcomes() of all that is there, as a table."""
    rows = outcomes(submitted, ended, within, late)
    return rows.sparkSession.read.schema(rows.schema).parquet(run_to_end(rows, "outcomes"))

