"""Streams over replayed events give what the batch form gives."""

import random

from pyspark.sql import functions as F

from skarn.operators import analytics
from skarn.sources.shared import scratch
from skarn.streaming import state


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "in")
    events.coalesce(1).write.parquet(path)
    return events, state.read_events(spark, path, events.schema)


def test_samples(spark, tmp_path):
    events, s = stream(spark, tmp_path)
    got = {(r.start.timestamp(), r.peak, r.n) for r in run(state.samples(s, "1 day"), "samples_t").collect()}
    want = {(float(r.start), r.peak, r.n) for r in analytics.samples(events, 86400, 10_000).collect()}
    assert got and got <= want and len(want) - len(got) <= 2  # the last windows are still open


def test_sessions(spark, tmp_path):
    events, s = stream(spark, tmp_path)
    closed = run(state.sessions(s), "sessions_t")
    want = {(r.user_id, r.first, r.n) for r in analytics.sessions(events).select("user_id", F.col("first").cast("timestamp").alias("first"), "n").collect()}
    assert {(r.user_id, r.start, r.n) for r in closed.collect()} <= want and closed.count() > 900


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    events, s = stream(spark, tmp_path)
    got = {tuple(r) for r in run(state.rate_limited_stream(s, 2, 3600), "limit_t").collect()}
    assert got == {tuple(r) for r in state.rate_limited(events, 2, 3600).collect()}


def test_misses(spark, tmp_path):
    _, s = stream(spark, tmp_path)
    assert run(state.misses(s), "misses_t").count() >= 5


def test_maintain(spark, tmp_path):
    _, s = stream(spark, tmp_path)
    seen = []
    q = state.maintain(s, lambda df, i: seen.append((i, df.count())), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 1000)]


def test_accepted_never_exceeds():
    rng = random.Random(1)
    times = sorted(rng.uniform(0, 100) for _ in range(300))
    flags, _ = state.accepted(times, [], 5, 10)
    ok = [t for t, f in zip(times, flags, strict=True) if f]
    assert all(sum(t - 10 < u <= t for u in ok) <= 5 for t in ok)


def test_a_repeated_batch_changes_nothing(spark):
    events = state.event_time(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    replay, ledger = state.Replay(events, 4), state.Ledger(spark, scratch(spark, "ledger"))
    tried = []
    note = lambda df: tried.append(1) or df
    ledger.run(replay.add(2).stream(), note)
    before = ledger.lines()
    ledger.unnoted(1)
    ledger.run(replay.add(2).stream(), note)
    assert len(before) == 2 and ledger.lines()[:2] == before and [b for b, _ in ledger.lines()] == [0, 1, 2, 3]
    assert len(tried) == 5  # the second batch ran twice
    assert ledger.table(events.schema).exceptAll(events).isEmpty() and ledger.table(events.schema).count() == 1000
    assert not ledger.apply(events, 0) and ledger.table(events.schema).count() == 1000


def test_cache_hits_over_batches_and_late_rows(spark):
    rows = [("q ", 0), ("Q", 200), ("q", 499), ("q", 800), ("r", 805), ("q", 1000), (None, 1001), (None, 1002)]
    log = state.event_time(spark.createDataFrame([(i, q, t + 86400) for i, (q, t) in enumerate(rows)], "event_id long, query string, ts int"))
    for files in (1, 3):
        got = {r.event_id: r.hit for r in state.finished(state.cache_hits(state.replayed(log, files)), "hits").collect()}
        assert got == {0: False, 1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True}


def test_sliding_windows_close(spark):
    log = state.event_time(spark.createDataFrame([(d + 86400, *x) for d, *x in [(0, "a", 1.0), (3599, "a", 2.0), (3600, "b", 3.0), (20000, "a", 0.0)]], "ts int, event_type string, value double"))
    got = {(r.start.timestamp() - 86400, r.event_type, r.n, r.peak) for r in state.finished(state.sliding(state.replayed(log, 1)), "w").collect()}
    assert got == {(-3600.0, "a", 2, 2.0), (0.0, "a", 2, 2.0), (0.0, "b", 1, 3.0), (3600.0, "b", 1, 3.0)}
