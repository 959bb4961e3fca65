"""Continuous ingestion (an extension): validated items, per-url deduplication, and a micro-batch upsert."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ingest
from ..operators.dedup import MAX_AGE_DAYS
from ..plans.run import upsert_tables
from ..sources.store import Store


def live_items(items: DataFrame, sources: DataFrame, late: str = "7 days") -> DataFrame:
    """Accepted items of a stream with ``ts``, one per canonical url within the watermark."""
    return ingest.accepted_items(items, sources).withWatermark("ts", late).dropDuplicatesWithinWatermark(["url_canonical"])


#: The state store that keyed processors need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Seen(StatefulProcessor):
    """When each url was accepted, for as long as that counts; a timer lets the state go after that."""

    def __init__(self, age: pd.Timedelta) -> None:
        self.age = age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.accepted = handle, handle.getValueState("accepted", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items = pd.concat(rows).sort_values(["ts", "seq"], kind="stable")
        last = pd.Timestamp(self.accepted.get()[0]) if self.accepted.exists() else None
        kept, before = [], last
        for place, ts in enumerate(items["ts"]):
            if last is None or ts - last > self.age:
                kept.append(place)
                last = ts
        if last is not before:
            self.accepted.update((last.to_pydatetime(),))
            # A timer due already would never come; the next one after the watermark does.
            due = int((last + self.age).timestamp() * 1000) + 1
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield items.iloc[kept].drop(columns="key")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.accepted.exists():
            due = (pd.Timestamp(self.accepted.get()[0]) + self.age).timestamp() * 1000
            if due < expiredTimerInfo.getExpiryTimeInMs():
                self.accepted.clear()
        yield pd.DataFrame()


def unseen_items(items: DataFrame, max_age_days: int = MAX_AGE_DAYS, late: str = "1 day") -> DataFrame:
    """Items of a stream with ``ts`` and ``seq`` whose url was not accepted in the ``max_age_days`` before.

    What is seen is keyed state, a url's time alone: nothing is rewritten as a
    whole, and what has run out goes by a timer of event time. A refused item
    does not renew its url's time. The session's state store has to be STATE_STORE.
    """
    keyed = items.withWatermark("ts", late).withColumn("key", F.sha2("url", 256))
    return keyed.groupBy("key").transformWithStateInPandas(Seen(pd.Timedelta(days=max_age_days)), items.schema, "append", "eventTime")


def hot_sources(items: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Items and points per source in sliding windows."""
    timed = items.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "source_id")
    return timed.agg(F.count("*").alias("items"), F.sum("points").alias("points"))


def upsert_stream(items: DataFrame, sources: DataFrame, store: Store, config: Mapping[str, object], now, checkpoint: str, **trigger):
    """Starts a query that upserts each micro-batch's articles, mentions and topics into ``store``, bucket by bucket.

    ``now`` gives the time of a batch. A batch that is run again finds its own
    articles stored and changes nothing; one that meets another run's commit
    starts over on what that one left.
    """

    def batch(rows: DataFrame, _: int) -> None:
        accepted, moment = ingest.accepted_items(rows, sources).persist(), now()
        store.transact(lambda tx: upsert_tables(tx, accepted, config, moment))
        accepted.unpersist()

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
