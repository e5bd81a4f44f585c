"""Streams that go on where they ended: state, sinks, timers and joins over several calls."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heronry.streaming import windows
from heronry.streaming.alerts import quiet_users, settled, with_state_store
from heronry.streaming.joins import views_to_purchases
from heronry.streaming.windows import daily_types, run_available, run_updates

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 1, 1)


def arrive(spark, folder, n, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/arrival-{n}")


def stream(spark, folder, **options):
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").options(**options).parquet(str(folder))


def some_events(seed, n, users=4, hours=24 * 12, types=("view", "purchase", "click")):
    rng = random.Random(seed)
    rows = [(i, START + timedelta(seconds=rng.randrange(hours * 3600), microseconds=rng.randrange(10**6)), rng.randrange(users), rng.choice(types), 1.0) for i in range(n)]
    rows.sort(key=lambda r: r[1])
    for k in range(0, n - 1, 9):  # out of order by seconds only, so within the lateness
        rows[k], rows[k + 1] = (rows[k + 1], rows[k]) if rows[k + 1][1] - rows[k][1] < timedelta(minutes=5) else (rows[k], rows[k + 1])
    return rows


def test_the_second_call_reads_only_what_is_new(spark, tmp_path):
    rows = some_events(1, 240)
    arrive(spark, tmp_path / "in", 0, rows[:150])
    at = {"folder": f"file://{tmp_path}/kept", "name": "daily"}
    first = run_available(daily_types(stream(spark, tmp_path / "in")), **at)
    before = sorted(map(tuple, first.collect()))
    arrive(spark, tmp_path / "in", 1, rows[150:])
    seen = []
    listen = daily_types(stream(spark, tmp_path / "in"))
    place = windows._place(spark, at["folder"], at["name"])
    query = listen.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows")
    query.awaitTermination()
    seen = sum(p["numInputRows"] for p in query.recentProgress)
    assert seen == 90
    both = sorted(map(tuple, run_available(daily_types(stream(spark, tmp_path / "in")), **at).collect()))
    assert set(before) < set(both)
    once = run_available(daily_types(stream(spark, tmp_path / "in")), folder=f"file://{tmp_path}/once")
    assert both == sorted(map(tuple, once.collect())) and len(set(both)) == len(both)


def test_updates_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(windows, "TOGETHER", 3)
    rows = some_events(2, 110)
    at = {"folder": f"file://{tmp_path}/kept", "name": "updates"}
    for n in range(11):
        arrive(spark, tmp_path / "in", n, rows[10 * n : 10 * n + 10])
        if n in (6, 10):
            found = run_updates(daily_types(stream(spark, tmp_path / "in", maxFilesPerTrigger=1)), ["from_at", "event_type"], **at)
            whole = daily_types(spark.createDataFrame(rows[: 10 * n + 10], EVENTS))
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    upto, batches = windows._kept_batches(spark, windows._place(spark, at["folder"], at["name"]))
    assert upto >= 5 and len(batches) <= 3


def brute_alerts(rows, hours, lateness=timedelta(minutes=10)):
    bought = sorted({(u, t) for _, t, u, kind, _ in rows if kind == "purchase"})
    end = max(t for _, t in bought) - lateness
    end = end.replace(microsecond=end.microsecond // 1000 * 1000)
    out = set()
    for u, t in bought:
        later = t + timedelta(hours=hours)
        if later <= end and not any(v == u and t < s <= later for v, s in bought):
            out.add((u, t, later))
    return out


@pytest.mark.parametrize("calls", [1, 3])
def test_alerts_equal_a_loop_also_after_restarts(spark, tmp_path, calls):
    rows = some_events(3, 200)
    rows += [(10_000, START + timedelta(hours=24 * 12 + 1), 9, "purchase", 1.0), (10_001, START + timedelta(hours=3), None, "purchase", 1.0), (10_002, None, 1, "purchase", 1.0)]
    at = {"folder": f"file://{tmp_path}/kept", "name": "alerts"}
    cut = [len(rows) * k // calls for k in range(calls + 1)]
    for n, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        arrive(spark, tmp_path / "in", n, rows[a:b])
        found = with_state_store(spark, lambda: run_available(quiet_users(stream(spark, tmp_path / "in"), 20), **at))
    us = lambda c: F.timestamp_micros(c)
    got = [tuple(r) for r in found.select("user_id", us("last_at"), us("alert_at")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_alerts([r for r in rows if None not in r[:3]], 20) and got
    batch = quiet_users(spark.createDataFrame(rows, EVENTS), 20)
    assert {tuple(r) for r in batch.select("user_id", us("last_at"), us("alert_at")).collect()} == set(got)


def test_settled_times_don_t_depend_on_batches():
    rng = random.Random(5)
    for _ in range(300):
        late, quiet = rng.randrange(1, 8), rng.randrange(1, 25)
        times = sorted(rng.randrange(0, 200) for _ in range(rng.randrange(1, 25)))
        arrivals = sorted(times, key=lambda t: t + rng.randrange(late))  # never later than the watermark
        alerts, kept, watermark = [], [], 0
        while arrivals:
            n = rng.randrange(1, 5)
            new, arrivals = arrivals[:n], arrivals[n:]
            assert all(t >= watermark for t in new)
            found, kept = settled([*kept, *new], quiet, watermark)
            alerts += found
            assert len(kept) <= 2 + len([t for t in times if t >= watermark])
            watermark = max(watermark, max(new) - late)
        alerts += settled(kept, quiet, 10**6)[0]
        want = [t for t in sorted(set(times)) if not any(t < s <= t + quiet for s in times)]
        assert alerts == want


def test_joined_streams_equal_tables_and_leave_late_events_out(spark, tmp_path):
    rows = some_events(4, 260, users=2, hours=60)
    rows += [(20_000, rows[100][1], 0, "purchase", 1.0)]  # far behind the watermark of the batches before it
    at = {"folder": f"file://{tmp_path}/kept", "name": "joined"}
    for n, (a, b) in enumerate(((0, 90), (90, 260), (260, 261))):
        arrive(spark, tmp_path / "in", n, rows[a:b])
        events = lambda: stream(spark, tmp_path / "in", maxFilesPerTrigger=1)
        found = run_available(views_to_purchases(events(), events()), **at)
    got = sorted(map(tuple, found.collect()))
    table = spark.createDataFrame(rows[:260] + rows[:5], EVENTS)
    assert got == sorted(map(tuple, views_to_purchases(table, table).collect())) and len(got) > 20
    want = {(v[2], v[0], p[0]) for v in rows[:260] for p in rows[:260] if v[3] == "view" and p[3] == "purchase" and v[2] == p[2] and timedelta(0) <= p[1] - v[1] <= timedelta(hours=1)}
    assert {r[:3] for r in got} == want
