"""Streams whose events come late and in any order against the batch forms, and what their state holds."""

import datetime
import random

import pytest

from quern.streaming import events as E


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def rows(seed, n=120):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    return [(i, start + datetime.timedelta(seconds=rng.randrange(40 * 86_400)), rng.randrange(3), rng.choice(["a", "b"]), float(i), None) for i in range(n)]


def arriving(spark, tmp_path, batches):
    """A stream that reads one batch of rows a trigger."""
    import os
    import time

    now = time.time() - 1000
    for k, batch in enumerate(batches):
        folder = str(tmp_path / f"b{k}")
        spark.createDataFrame(batch, E.EVENTS).coalesce(1).write.parquet(folder)
        part = next(f for f in os.listdir(folder) if f.startswith("part"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(f"{folder}/{part}", tmp_path / "in" / f"{k:03}.parquet")
        os.utime(tmp_path / "in" / f"{k:03}.parquet", (now + k, now + k))
    return spark.readStream.schema(E.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def shuffled(every, batches, hours, seed):
    """Rows in batches, each row up to ``hours`` later than its place in time."""
    rng = random.Random(seed)
    order = sorted(every, key=lambda r: r[1] + datetime.timedelta(hours=rng.uniform(0, hours)))
    size = -(-len(order) // batches)
    return [order[k : k + size] for k in range(0, len(order), size)]


def test_follow_ups_of_late_events_equal_the_batch_form(spark, tmp_path, rocksdb):
    every = rows(1)
    stream = arriving(spark, tmp_path, shuffled(every, 4, 20, 2))
    got = {tuple(r) for r in E.closed(stream, lambda e: E.follow_ups(e, 2)).collect()}
    want = {tuple(r) for r in E.follow_ups(spark.createDataFrame(every, E.EVENTS), 2).collect()}
    assert got == want and len(got) == len(every) and {f for _, f in got} == {True, False}


def test_an_event_between_two_that_came_before_it(spark, tmp_path, rocksdb):
    day = lambda i, d: (i, datetime.datetime(2024, 1, d), 1, "a", 0.0, None)
    stream = arriving(spark, tmp_path, [[day(10, 10)], [day(1, 1)], [day(11, 11)]])
    assert {tuple(r) for r in E.closed(stream, lambda e: E.follow_ups(e, 2, "20 days")).collect()} == {(1, False), (10, False), (11, True)}


def test_state_is_bounded_by_the_watermark(spark, tmp_path):
    every = sorted(rows(3, 400), key=lambda r: r[1])
    batches = [every[k : k + 50] for k in range(0, 400, 50)]
    for name, build in (("days", lambda e: E.provider_days(e, "3 days")), ("first", lambda e: E.deduplicated(e, ["user_id", "event_type"], "12 hours"))):
        reports = []
        E.closed(arriving(spark, tmp_path / name, batches), build, reports)
        held = [r["numRowsTotal"] for r in reports]
        assert max(held) < 60 and held[-1] == 0, held


def test_user_days_of_late_events_equal_the_batch_form(spark, tmp_path):
    every = rows(5)
    got = sorted(map(tuple, E.closed(arriving(spark, tmp_path, shuffled(every, 4, 20, 6)), lambda e: E.provider_days(e, "3 days")).collect()))
    assert got == sorted(map(tuple, E.provider_days(spark.createDataFrame(every, E.EVENTS), "3 days").collect()))
    assert sum(r[3] for r in got) == len(every)


def test_many_keys_share_few_states(spark, tmp_path, rocksdb, monkeypatch):
    monkeypatch.setattr(E, "BUCKETS", 2)
    every = [(i, t, None if u == 0 else 1000 * u + i % 40, k, v, p) for i, t, u, k, v, p in rows(7, 300)]
    got = [tuple(r) for r in E.closed(arriving(spark, tmp_path, shuffled(every, 3, 20, 8)), lambda e: E.follow_ups(e, 2)).collect()]
    want = {tuple(r) for r in E.follow_ups(spark.createDataFrame(every, E.EVENTS), 2).collect()}
    assert set(got) == want and len(got) == 300 and {f for _, f in got} == {True, False}
