"""Queries over events, as tables and as streams that run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.storage import stored
from ..streaming import jobs, timers
from .catalog import query


@query("""
    WITH w AS (SELECT event_id, count(*) OVER x AS samples, (epoch_us(max(ts) OVER x) - epoch_us(min(ts) OVER x)) / 1e6 AS span FROM events
               WINDOW x AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW))
    SELECT event_id, samples, CASE WHEN span > 0 THEN round(samples / span, 6) ELSE 0.0 END AS rate FROM w""")
def event_rate_60s(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.rate(tables.job_events(spark, folder)).select("event_id", "samples", "rate")


@query("""
    WITH w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done, count(*) OVER (PARTITION BY user_id) AS total,
                      (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6 AS since FROM events)
    SELECT event_id, done, total, round(100.0 * done / total, 4)::DOUBLE AS percent, round(since / done * (total - done), 3) AS seconds_left FROM w""")
def progress_running(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.progress(tables.job_events(spark, folder)).select("event_id", "done", "total", "percent", "seconds_left")


_LAST = "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1"


@query(f"SELECT job_id, state, state IN ('error', 'purchase') AS ended FROM ({_LAST})")
def job_state_latest(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.last_state(tables.job_events(spark, folder)).select("job_id", "state", "ended")


@query("SELECT event_id, gap FROM (SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 3) AS gap FROM events) WHERE gap < 600")
def rate_limit_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Events that break a pause of ten minutes."""
    return jobs.gaps(tables.job_events(spark, folder), 600).select("event_id", "gap")


@query("SELECT user_id AS job_id FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stale_items(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs without an event in the hour before the last one of all."""
    e = tables.job_events(spark, folder)
    end = e.agg(F.max("ts").alias("end"))  # one row
    last = e.groupBy("job_id").agg(F.max("ts").alias("ts"))
    return last.crossJoin(end).filter(F.col("ts") < F.col("end") - F.expr("INTERVAL 1 HOUR")).select("job_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS state, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.tumbling(tables.job_events(spark, folder))


@query("""
    WITH m AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM m)
    SELECT user_id AS job_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n""")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.sessions(tables.job_events(spark, folder), "6 hours")


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || '{\"job_id\":' || user_id || ',\"state\":\"' || event_type || '\"}' || chr(10) || chr(10) AS message FROM events")
def event_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.job_events(spark, folder)
    body = F.to_json(F.struct("job_id", "state"))
    return rows.select("event_id", F.concat(F.lit("event: "), F.col("state"), F.lit("\ndata: "), body, F.lit("\n\n")).alias("message"))


@query("SELECT user_id AS job_id, max(value) AS priority FROM events GROUP BY 1 ORDER BY priority DESC, min(ts), job_id LIMIT 50")
def queue_admission(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.job_events(spark, folder).groupBy("job_id").agg(F.max("value").alias("priority"), F.min("ts").alias("created"))
    return jobs.admitted(e, 50).select("job_id", "priority")


@query("SELECT event_id, least(100 * power(2, event_id % 12), 60000)::BIGINT AS delay_ms FROM events WHERE event_type = 'error'")
def retry_delays(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.job_events(spark, folder).filter("state = 'error'")
    return e.select("event_id", jobs.backoff(F.col("event_id") % 12, 100).alias("delay_ms"))


@query("""
    WITH s(state, lo, hi) AS (VALUES ('view', 0, 25), ('click', 25, 50), ('purchase', 50, 100), ('error', 0, 0), ('signup', 0, 10), ('logout', 0, 0))
    SELECT event_id, max(lo + (hi - lo) * 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS overall
    FROM events JOIN s ON state = event_type""")
def stage_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Stages mapped to overall percent, never going back within a job. The stages' bounds are fixed values."""
    from pyspark.sql import Window

    bounds = {"view": (0, 25), "click": (25, 50), "purchase": (50, 100), "error": (0, 0), "signup": (0, 10), "logout": (0, 0)}
    value = F.lit(None).cast("double")
    for k, (lo, hi) in bounds.items():
        value = F.when(F.col("state") == k, F.lit(lo + (hi - lo) * 0.5)).otherwise(value)
    w = Window.partitionBy("job_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = tables.job_events(spark, folder).withColumn("p", value).filter("p is not null")
    return e.select("event_id", F.max("p").over(w).alias("overall"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS state, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def events_stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts by a stream of the events' files: each batch adds its sums to one table, a folder for each batch."""
    stream = jobs.event_stream(spark, _files(folder, "events"))
    empty = spark.createDataFrame([], "start timestamp, state string, events long, value double")
    sums = stored(empty.withColumn("batch", F.lit(0)), "sums", by="batch").stored_at

    def each(batch: DataFrame, number: int) -> None:
        grouped = batch.groupBy(F.window("ts", "1 day")["start"].alias("start"), "state").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        grouped.write.mode("overwrite").parquet(f"{sums}/batch={number}")  # a batch that is run again takes its own place

    jobs.run_to_end(stream, "events", each=each)
    out = spark.read.schema(empty.schema).parquet(sums)
    return out.groupBy("start", "state").agg(F.sum("events").alias("events"), F.round(F.sum("value"), 4).alias("value"))


@query("SELECT user_id AS job_id, count(*) AS events FROM events GROUP BY 1")
def job_states_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every job's final number of events by a stream with state; the sink keeps a row for each batch."""
    sink = jobs.run_to_end(jobs.job_states(jobs.event_stream(spark, _files(folder, "events"))), "states")
    rows = spark.read.schema("job_id long, events long, state string, ended boolean").parquet(sink)
    return rows.groupBy("job_id").agg(F.max("events").alias("events"))


def _slices(spark: SparkSession, folder: str, late: bool = False) -> DataFrame:
    """The events as a stream of four slices in order of time; with `late`, of their ids, and some rows come a slice later."""
    rows = tables.job_events(spark, folder).drop("props").withColumn("ts", F.col("ts").cast("timestamp"))
    slices = 5 if late else 4
    if late:
        lo, hi = rows.agg(F.min("event_id"), F.max("event_id")).first()
        number = F.floor((F.col("event_id") - F.lit(lo or 0)) * 4 / F.lit((hi or 0) - (lo or 0) + 1))
        number = number + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0)
    else:
        us = F.unix_micros("ts")
        ends = rows.agg(F.percentile_approx(us, [0.25, 0.5, 0.75])).first()[0] or []
        number = sum(((us > end).cast("int") for end in ends), F.when(us.isNotNull(), 0))
    files = timers.files_of_slices(rows, number, slices)
    return timers.slice_stream(spark, timers.in_slices(rows, number, slices, "slices", files), rows.schema, files)


@query("""
    WITH e AS (SELECT user_id, ts, event_id, lead(ts) OVER w AS next, lag(ts) OVER w AS before, max(ts) OVER () AS newest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
    k AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS events FROM r)
    SELECT user_id AS job_id, ts::TIMESTAMP AS last, events FROM k
    WHERE next - ts > INTERVAL 6 HOUR OR (next IS NULL AND ts + INTERVAL 6 HOUR <= newest - INTERVAL 10 MINUTE)""")
def silent_jobs_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs that fall silent for six hours, by timers of a stream."""
    return timers.run_silences(_slices(spark, folder), 6 * 3600, "10 minutes")


_LATE = """
    WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events),
    s AS (SELECT *, floor((event_id - lo) * 4 / (hi - lo + 1)) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS batch FROM events, b),
    n AS (SELECT batch, max(ts) AS newest FROM s GROUP BY batch),
    m AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS watermark FROM n),
    l AS (SELECT s.*, coalesce(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= watermark, false) AS lost FROM s JOIN m USING (batch))"""


@query(_LATE + " SELECT batch::INT AS batch, count(*) AS seen, count(*) FILTER (WHERE lost) AS lost FROM l GROUP BY batch")
def late_rows_by_batch(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each batch saw, and how many of them came after the end of their window and an hour."""
    return timers.counted_windows(_slices(spark, folder, late=True), "1 hour", 3600).batches().select("batch", "seen", "lost")


@query(_LATE + " SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS state, count(*) AS events, round(sum(value), 4) AS value FROM l WHERE NOT lost GROUP BY 1, 2")
def windows_without_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    return timers.counted_windows(_slices(spark, folder, late=True), "1 hour", 3600).windows()


@query("""
    WITH a AS (SELECT user_id AS job_id, event_id AS submission, ts FROM events WHERE event_type = 'signup'),
    b AS (SELECT user_id AS job_id, event_id AS outcome, ts FROM events WHERE event_type IN ('error', 'purchase')),
    m AS (SELECT least((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)) - INTERVAL 10 MINUTE AS watermark)
    SELECT a.job_id, submission, outcome FROM a LEFT JOIN b ON a.job_id = b.job_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOUR, m
    WHERE outcome IS NOT NULL OR a.ts + INTERVAL 12 HOUR < watermark""")
def job_outcomes_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions with their outcomes within twelve hours, by a join of two streams; those that may still get one are left out."""
    events = _slices(spark, folder)
    return timers.run_outcomes(events.filter("state = 'signup'"), events.filter(F.col("state").isin(*jobs.TERMINAL)), "12 HOURS", "10 minutes").select("job_id", "submission", "outcome")


def _files(folder: str, name: str) -> str:
    """A stream reads folders: the table's own, or the pattern that matches its single file."""
    return f"{folder}/{name}.parque[t]"
