from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparkloom.plans import streams
from sparkloom.streaming import timers

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, job_id long, state string, ts timestamp, value double"


def events(spark, rows, slices):
    """rows: (slice, job, minute, state); a stream of the slices."""
    data = [(i, job, state, START + timedelta(minutes=m), 1.0, k) for i, (k, job, m, state) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA + ", slice int")
    at = timers.in_slices(df, F.col("slice"), slices, "test-slices")
    return timers.slice_stream(spark, at, df.schema).drop("slice")


def minutes(ts):
    return (ts - START) / timedelta(minutes=1)


def test_silences_within_and_between_batches(spark):
    rows = [(0, 1, 0, "view"), (0, 1, 10, "view"), (0, 1, 100, "view"), (0, 2, 5, "view"), (1, 3, 200, "view"), (2, 1, 210, "view"), (2, 3, 250, "view"), (3, 9, 1000, "view")]
    found = timers.run_silences(events(spark, rows, 4), 3600, "5 minutes").collect()
    got = sorted((r.job_id, minutes(r["last"]), r.events) for r in found)
    assert got == [(1, 10.0, 2), (1, 100.0, 1), (1, 210.0, 1), (2, 5.0, 1), (3, 250.0, 2)]  # job 9 may still speak
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != timers.ROCKS


def test_losses_are_counted_and_batches_may_run_again(spark):
    rows = [(0, 1, 0, "a"), (0, 1, 130, "a"), (1, 1, 50, "a"), (1, 2, 61, "b"), (1, 2, 131, "b"), (2, 1, 65, "a")]
    losses = timers.counted_windows(events(spark, rows, 3), "1 hour", 600)
    want = [(0, 2, 0), (1, 3, 2), (2, 1, 1)]  # at 130 minutes the windows up to 120 have ended
    assert sorted((r.batch, r.seen, r.lost) for r in losses.batches().collect()) == want
    again = spark.createDataFrame([(9, 1, "a", START, 1.0)], SCHEMA)
    losses.each(again, 1)
    assert sorted((r.batch, r.seen, r.lost) for r in losses.batches().collect()) == [(0, 2, 0), (1, 1, 1), (2, 1, 1)]
    assert sum(r.events for r in losses.windows().collect()) == 2


def test_outcomes_and_those_without(spark):
    rows = [(0, 1, 0, "signup"), (0, 2, 1, "signup"), (0, 1, 30, "error"), (0, 1, 40, "purchase"), (1, 2, 200, "error"), (1, 3, 210, "signup"), (2, 9, 900, "signup"), (2, 9, 901, "error"), (3, 8, 905, "signup"), (3, 8, 5000, "error")]
    stream = events(spark, rows, 4)
    found = timers.run_outcomes(stream.filter("state = 'signup'"), stream.filter("state <> 'signup'"), "1 HOUR", "1 minute")
    got = sorted(((r.job_id, r.submission, r.outcome) for r in found.collect()), key=repr)
    # The slower side is at 905 minutes, so the submission at 905 may still get an outcome.
    assert got == [(1, 0, 2), (1, 0, 3), (2, 1, None), (3, 5, None), (9, 6, 7)]


def test_silences_keep_no_python_state_and_runs_end_after_their_last_moment(spark):
    rows = [(0, 1, 0, "view"), (0, 1, 60, "view"), (0, 1, 121, "view"), (1, 2, 200, "view"), (1, 1, 182, "view"), (2, 9, 305, "view"), (2, 8, 307, "view")]
    stream = events(spark, rows, 3)
    plan = timers.silences(stream, 3600, "5 minutes")._jdf.queryExecution().logical().toString()
    assert "Python" not in plan and "TransformWithState" not in plan
    found = timers.run_silences(stream, 3600, "5 minutes").collect()
    # 60 is exactly an hour after 0; the watermark is at 302 minutes.
    assert sorted((r.job_id, minutes(r["last"]), r.events) for r in found) == [(1, 60.0, 2), (1, 121.0, 1), (1, 182.0, 1), (2, 200.0, 1)]


def test_slices_of_several_files_stay_whole_batches(spark):
    rows = spark.range(4000).selectExpr("id as event_id", "id % 7 as job_id", "'a' as state", "timestamp_seconds(id) as ts", "1.0D as value")
    number = F.floor(F.col("event_id") / 1000)
    files = timers.files_of_slices(rows, number, 4, least=300)
    assert (files, timers.files_of_slices(rows, number, 5, least=300), timers.files_of_slices(rows, number, 4)) == (3, 1, 1)
    at = timers.in_slices(rows, number, 4, "test-files", files)
    assert len(spark.read.parquet(at).inputFiles()) == 12
    losses = timers.counted_windows(timers.slice_stream(spark, at, rows.schema, files), "1 hour", 600)
    assert sorted((r.batch, r.seen) for r in losses.batches().collect()) == [(k, 1000) for k in range(4)]


def test_outcomes_of_events_whose_ids_are_not_in_order_of_time(spark, tmp_path):
    states = ("signup", "view", "error", "purchase")
    data = [(k * 200 + i, START + timedelta(hours=i), k * 10 + i % 3, states[(i + k) % 4], 1.0, "") for k in range(2) for i in range(200)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = {(r.job_id, r.submission, r.outcome) for r in streams.job_outcomes_stream(spark, str(tmp_path)).collect()}
    starts, ends = [d for d in data if d[3] == "signup"], [d for d in data if d[3] in ("error", "purchase")]
    hours = timedelta(hours=12)
    slow = min(max(d[1] for d in starts), max(d[1] for d in ends)) - timedelta(minutes=10)
    want = set()
    for a in starts:
        mine = [b[0] for b in ends if b[2] == a[2] and a[1] <= b[1] <= a[1] + hours]
        want |= {(a[2], a[0], b) for b in mine} or ({(a[2], a[0], None)} if a[1] + hours < slow else set())
    assert found == want


def test_silences_of_jobs_that_speak_again_before_the_watermark(spark):
    rows = [(0, 1, 0, "view"), (0, 2, 1, "view"), (1, 1, 10, "view"), (1, 3, 11, "view"), (2, 2, 62, "view"), (2, 1, 72, "view"), (2, 4, 73, "view")]
    found = timers.run_silences(events(spark, rows, 3), 3600, "5 minutes").collect()
    # The watermark is at 68 minutes: the run that ended at 10 lasts until 70, but job 1 has spoken since; job 3 may still speak.
    assert sorted((r.job_id, minutes(r["last"]), r.events) for r in found) == [(1, 10.0, 2), (2, 1.0, 1)]


def test_silences_end_by_microseconds(spark):
    at = [(1, START + timedelta(microseconds=600)), (2, START + timedelta(microseconds=701)), (3, START + timedelta(minutes=65, microseconds=700))]
    data = [(i, job, "view", ts, 1.0, 0) for i, (job, ts) in enumerate(at)]
    df = spark.createDataFrame(data, SCHEMA + ", slice int")
    stream = timers.slice_stream(spark, timers.in_slices(df, F.col("slice"), 1, "test-micros"), df.schema)
    assert [(r.job_id, r["last"], r.events) for r in timers.run_silences(stream, 3600, "5 minutes").collect()] == [(1, at[0][1], 1)]


def test_silent_jobs_equal_their_sql_up_to_the_last_moment(spark, tmp_path):
    import random

    import duckdb

    from sparkloom.plans.registry import ORACLE_SQL

    rng = random.Random(4)
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    data = [(i, START + timedelta(hours=rng.uniform(*rng.choice(((0, 13), (6.8, 7), (12.8, 13))))), rng.randrange(1500), "view", 1.0, "") for i in range(3000)]
    for k, rows in enumerate((data, data[:1], [])):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{k}/events.parquet")
        found = streams.silent_jobs_stream(spark, f"{tmp_path}/{k}")
        sql = ORACLE_SQL["silent_jobs_stream"]
        with duckdb.connect() as db:
            db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/{k}/events.parquet/*.parquet')")
            want = db.execute(sql).fetchall()
            early = db.execute(f"SELECT count(*) FROM ({sql}) WHERE last + INTERVAL 6 HOUR > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE").fetchall()[0][0]
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert early > 3 if k == 0 else early == 0
