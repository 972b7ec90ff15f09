"""Structured Streaming forms of the event operators, each with the same result as its batch form."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.plans.staging import stage_path

#: When the row that closes a stream stands. Tested by its time, as Spark moves other filters below the watermark.
CLOSING = "9000-01-01"
NOT_CLOSING = f"ts <> timestamp '{CLOSING}'"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The event table as a stream of files; the folder is watched for more of them."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def cell_counts(events: DataFrame) -> DataFrame:
    """Records and value of each (type, user): the accumulators of a chunked scan."""
    return events.groupBy("event_type", "user_id").agg(F.count("*").alias("records"), F.round(F.sum("value"), 4).alias("value"))


def deduplicated(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """First row of each key; a stream forgets keys once the watermark has passed, so copies have to lie within ``delay`` of one another."""
    return events.withWatermark("ts", delay).where(NOT_CLOSING).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def tumbling(events: DataFrame, width: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Records and value per window and type."""
    e = events.withWatermark("ts", delay).where(NOT_CLOSING) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("records"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "records", "value")


def provider_days(events: DataFrame, width: str, delay: str = "1 day") -> DataFrame:
    """Distinct (user, day) pairs per window and type, and their records.

    Two aggregates in a chain: rows become user-days, which are then counted
    by window. A stream keeps a user-day until the watermark has passed its
    day, and a count until it has passed the window.
    """
    e = events.withWatermark("ts", delay).where(NOT_CLOSING) if events.isStreaming else events
    days = e.groupBy(F.window("ts", "1 day").alias("day"), "event_type", "user_id").agg(F.count("*").alias("records"))
    g = days.groupBy(F.window(F.window_time("day"), width), "event_type").agg(F.count("*").alias("provider_days"), F.sum("records").alias("records"))
    return g.select(F.col("window.start").alias("start"), "event_type", "provider_days", "records")


def sessions(events: DataFrame, gap: str, delay: str = "1 day") -> DataFrame:
    """Sessions of each user: rows that follow one another within ``gap``."""
    e = events.withWatermark("ts", delay).where(NOT_CLOSING) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("records"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "records")


def _run(stream: DataFrame, mode: str, out: str, state: str) -> tuple[list[int], list[dict]]:
    """(numbers of the batches that were written to ``out``, what the stream's state operators report of each)."""
    done: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return done, [dict(o) for p in query.recentProgress for o in p["stateOperators"]]


def _written(stream: DataFrame, out: str, numbers: list[int]) -> DataFrame:
    spark = stream.sparkSession
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(T.StructType([*stream.schema.fields])).parquet(*[f"{out}/batch={n}" for n in numbers])


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's result once it has taken all that is there: a Parquet table in the shared folder.

    Batches are written by number, so that a batch that is run again after a
    failure replaces what it had written. In complete mode the last one counts.
    """
    out, state = stage_path(stream.sparkSession), stage_path(stream.sparkSession)
    done, _ = _run(stream, mode, out, state)
    return _written(stream, out, done[-1:] if mode == "complete" else sorted(set(done)))


def closed(events: DataFrame, build: Callable[[DataFrame], DataFrame], reports: list[dict] | None = None) -> DataFrame:
    """The result in append mode of ``build`` on a stream that has ended: all that is there, and then a closing row of a far future.

    The closing row takes the watermark past all events, so that every window and every waiting event comes out and no
    state stays behind. It comes by a second source, in a run that goes on
    from the first one's checkpoint. ``reports`` gets the state operators'
    progress of each batch.
    """
    spark = events.sparkSession
    folder, out, state = (stage_path(spark) for _ in range(3))
    spark.createDataFrame([], EVENTS).write.parquet(folder)
    both = events.unionByName(spark.readStream.schema(EVENTS).parquet(folder).select(*events.columns))
    stream = build(both)
    first, told = _run(stream, "append", out, state)
    spark.sql(f"SELECT CAST(NULL AS long) AS event_id, timestamp '{CLOSING}' AS ts, CAST(NULL AS long) AS user_id, CAST(NULL AS string) AS event_type, CAST(NULL AS double) AS value, CAST(NULL AS string) AS props").write.mode("append").parquet(folder)
    second, more = _run(stream, "append", out, state)
    if reports is not None:
        reports += [*told, *more]
    return _written(stream, out, sorted({*first, *second}))


FOLLOW_UP = "event_id long, follows boolean"


#: Users and types are dealt into so many states, as each call of a state costs more than a row in it.
BUCKETS = 4096


class FollowUp(StatefulProcessor):
    """For each event whether one of its key came at most ``days`` days before; a state holds many keys.

    Events wait in the state until the watermark has passed them, as only then
    no earlier one can come any more; a timer at the earliest wakes them. A
    key's latest passed event stays, as ``done``, until nothing can follow it.
    """

    FIELDS = ["event_id", "at", "key", "done"]

    def __init__(self, days: int) -> None:
        self.reach = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, at long, key string, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).assign(done=False)
        self.waiting.appendList(self._tuples(batch))
        self._wake(batch["at"])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.waiting.get()) if self.waiting.exists() else []
        every = pd.DataFrame(held, columns=self.FIELDS).astype({"event_id": "int64", "at": "int64", "done": "bool"})
        now = timerValues.getCurrentWatermarkInMs() * 1000
        past = every["at"] <= now
        final = every[past].sort_values(["key", "done", "at", "event_id"], ascending=[True, False, True, True])
        if final.empty:
            return iter(())
        follows = final["at"] - final.groupby("key")["at"].shift(1) <= self.reach
        carried = final.groupby("key").tail(1)
        carried = carried[carried["at"] + self.reach >= now].assign(done=True)
        rest = every[~past]
        kept = pd.concat([rest, carried])
        if kept.empty:
            self.waiting.clear()
        else:
            self.waiting.put(self._tuples(kept))
            self._wake(pd.concat([rest["at"], carried["at"] + self.reach + 1]))
        new = ~final["done"]
        return iter([pd.DataFrame({"event_id": final.event_id[new], "follows": follows[new]})] if new.any() else ())

    def _tuples(self, rows: pd.DataFrame) -> list[tuple]:
        return list(zip(*(rows[c].tolist() for c in self.FIELDS), strict=True))

    def _wake(self, at: pd.Series) -> None:
        self.handle.registerTimer(-(-int(at.min()) // 1000))

    def close(self) -> None:
        pass


def follow_ups(events: DataFrame, days: int, delay: str = "1 day") -> DataFrame:
    """(event_id, follows). A stream takes events in any order, if none comes later than ``delay`` after a later one; the batch form is a window."""
    if not events.isStreaming:
        before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
        return events.select("event_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp")) <= days * 86_400_000_000, F.lit(False)).alias("follows"))
    timed = events.withWatermark("ts", delay).where(NOT_CLOSING).withColumn("at", F.unix_micros("ts"))
    dealt = timed.select("ts", "event_id", "at", F.to_json(F.struct("user_id", "event_type")).alias("key"), F.pmod(F.xxhash64("user_id", "event_type"), F.lit(BUCKETS)).alias("bucket"))
    return dealt.groupBy("bucket").transformWithStateInPandas(FollowUp(days), FOLLOW_UP, "Append", "EventTime")
