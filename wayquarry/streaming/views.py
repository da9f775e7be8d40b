"""Views counted as they come: scores that follow them, counts a day with late events, quotas, and a table beside a stream.

All take a streaming (or batch) DataFrame of events: event_id, ts, user_id, event_type, value.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.crm import popularity

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """Events from parquet files as they are added to a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def scores(events: DataFrame, as_of: Column) -> DataFrame:
    """Per user: views, purchases and sign-ups, and the score they give. For output mode update or complete."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    counted = events.groupBy("user_id").agg(n("view").alias("views"), n("purchase").alias("purchases"), n("signup").alias("signups"), F.min("ts").alias("since"))
    hours = (F.unix_micros(as_of) - F.unix_micros("since")) / 3.6e9
    return counted.withColumn("score", popularity(F.col("views"), F.col("purchases"), F.col("signups"), hours))


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events a day and type; days are final once events are ``late`` beyond them, so the state stays bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def once(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events without repetitions that come within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class Refreshed:
    """A table beside a stream that is read again once it is older than ``seconds``; in between batches see the version that was read."""

    def __init__(self, spark: SparkSession, path: str, seconds: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.path, self.seconds, self.clock = spark, path, seconds, clock
        self.table, self.at, self.reads = None, 0.0, 0

    def now(self) -> DataFrame:
        if self.table is None or self.clock() - self.at >= self.seconds:
            # a new frame lists the folder's files again
            self.table, self.at, self.reads = self.spark.read.parquet(self.path), self.clock(), self.reads + 1
        return self.table


def beside(stream: DataFrame, side: Refreshed, keys: Sequence[str], write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that gives each batch, joined with the side's table as it is then (left), to ``write``; which must bear getting a batch twice."""
    return stream.writeStream.foreachBatch(lambda batch, number: write(batch.join(side.now(), list(keys), "left"), number))


def quota(events: DataFrame, room: int, kind: str = "purchase", late: str = "2 days") -> DataFrame:
    """event_id, user_id, ts, accepted: events of a kind are accepted while a user has room on that day.

    What a user has used that day is state, and is forgotten when events can't be so late any more. Within a batch events go by time; a later batch's
    events come after those of earlier ones, whatever their time. For output mode append.
    """
    schema = "event_id long, user_id long, ts timestamp, accepted boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (used,) = state.get if state.exists else (0,)
        own = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        yes = own["event_type"] == kind
        accepted = yes & (yes.cumsum() + used <= room)
        state.update((used + int(accepted.sum()),))
        end = int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield own.assign(accepted=accepted)[["event_id", "user_id", "ts", "accepted"]]

    daily_events = events.withWatermark("ts", late).withColumn("day", F.date_trunc("day", "ts")).select("user_id", "day", "event_id", "ts", "event_type")
    return daily_events.groupBy("user_id", "day").applyInPandasWithState(run, schema, "used long", "append", GroupStateTimeout.EventTimeTimeout)
