import datetime as dt


from millrace.operators import inspection as op
from millrace.streaming import monitors


def run(spark, rows, schema, make, tmp_path, name, mode="append", parts=2):
    df = spark.createDataFrame(rows, schema)
    n = (len(rows) + parts - 1) // parts
    for i in range(parts):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_drift_like_batch(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [(f"k{i % 2}", at + dt.timedelta(seconds=i), i, float(i % 5), 2.0, 0.1) for i in range(120)]
    schema = "key string, ts timestamp, event_id long, score double, tau double, eps double"
    got = {r.event_id: (r.n, round(r.rate, 6), r.drifting) for r in run(spark, rows, schema, lambda s: monitors.drift_stream(s, window=20, least=10), tmp_path, "drift")}
    want = {r.event_id: (r.n, round(r.rate, 6), r.drifting) for r in op.drift(spark.createDataFrame(rows, schema), "key", 20, 10).collect()}
    assert got == want


def test_latency_and_repeats(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [("k", at + dt.timedelta(seconds=i), i, float(i)) for i in range(50)]
    got = {r.event_id: (r.seen, r.mean_last) for r in run(spark, rows, "key string, ts timestamp, event_id long, ms double", monitors.latency_stream, tmp_path, "latency")}
    assert got[49] == (50, 39.5) and got[0] == (1, 0.0)
    files = [(i, f"c{i % 7}") for i in range(40)]
    assert len(run(spark, files, "id long, content string", monitors.new_files, tmp_path, "files")) == 7
    fired = [(i % 5, "3d") for i in range(20)]
    assert len(run(spark, fired, "id long, level string", monitors.once_per_level, tmp_path, "fired")) == 5


def test_daily_stats(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1 + i // 10, 5), "NG" if i % 2 else "OK") for i in range(40)]
    out = run(spark, rows, "created_at timestamp, verdict string", monitors.daily_stats, tmp_path, "daily", mode="complete")
    assert sorted((r.day.day, r.total, r.ng_count) for r in out) == [(d, 10, 5) for d in (1, 2, 3, 4)]


def test_retry_delays():
    assert [monitors.retry_delay(i) for i in range(4)] == [0, 30, 120, None]


def replay(spark, batches, schema, make, tmp_path, name):
    """Rows of a stream whose input files come one by one; the query stops after each and starts again from its checkpoint."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / name)))
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    return out


def test_drift_goes_on_after_a_restart(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    schema = "key string, ts timestamp, event_id long, score double, tau double, eps double"
    rows = [(f"k{i % 2}", at + dt.timedelta(seconds=i), i, float((i * 7) % 5), 2.0, 0.1 if i < 60 else 0.2) for i in range(120)]
    got = {r.event_id: (r.n, round(r.rate, 6), r.drifting) for r in replay(spark, [rows[:50], rows[50:51], rows[51:]], schema, lambda s: monitors.drift_stream(s, window=20, least=10), tmp_path, "again")}
    want = {r.event_id: (r.n, round(r.rate, 6), r.drifting) for r in op.drift(spark.createDataFrame(rows, schema), "key", 20, 10).collect()}
    assert got == want


def test_reminders_like_the_daily_batch(spark, tmp_path):
    """A reminder a level as the days go by: what a run of the batch rule every day would send, with restarts."""
    start = dt.datetime(2026, 1, 1, 6)
    day = lambda n: (start + dt.timedelta(days=n)).date()
    items = {1: 10, 2: 5, 3: 0, 4: -3, 5: 30, 6: 2}  # id: days until it is due, as of the first day
    schema = "id long, due_date date, status string, ts timestamp"
    first = [(i, day(d), "pending", start) for i, d in items.items()] + [(7, None, "pending", start), (8, day(4), "paid", start)]
    tick = lambda n: (99, None, "pending", start + dt.timedelta(days=n))
    batches = [first] + [[tick(n)] for n in range(1, 6)] + [[(1, day(10), "paid", start + dt.timedelta(days=6)), tick(6)]] + [[tick(n)] for n in range(7, 14)]
    got = sorted((r.id, r.level) for r in replay(spark, batches, schema, monitors.reminder_stream, tmp_path, "remind"))
    sent = set()
    for n in range(13):
        for i, d in items.items():
            left = d - n
            level = "overdue" if left < 0 else "1d" if left <= 1 else "3d" if left <= 3 else "7d" if left <= 7 else None
            if level and not (i == 1 and n >= 6):
                sent.add((i, level))
    assert got == sorted(sent)


def test_retries_wait_and_end(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    s = lambda n: at + dt.timedelta(seconds=n)
    schema = "id long, ok boolean, ts timestamp"
    batches = [[(1, False, s(0)), (2, True, s(0)), (3, False, s(0))], [(9, True, s(31))], [(9, True, s(40)), (1, False, s(35)), (3, True, s(36))], [(9, True, s(100))], [(9, True, s(200))], [(1, False, s(205))], [(9, True, s(900))], [(9, True, s(901))]]
    got = sorted((r.id, r.attempt, r.at) for r in replay(spark, batches, schema, monitors.retry_stream, tmp_path, "retry"))
    assert got == [(1, 2, s(30)), (1, 3, s(155)), (3, 2, s(30))]
