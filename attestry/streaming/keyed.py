"""Entries of keys that hold for a time, as a stream with state: versions take precedence, timers let entries expire.

An entry holds until its time is over; of those of a key that hold, the one of the highest version is current. A key's state
has the entries that are or may become current: one that another outranks and outlasts never will. So its size does not grow
with the stream, and neither the order of arrival nor repetitions change what is current.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.versions import Change, Store

#: A key's events: what is current (or that nothing is), and the number of the event.
EVENTS = "key long, rev long, version long, entry_id long, value string, expires_ms long, holds boolean"
#: Entries of a key in order of rank: version, time, id.
STATE = "version long, at_ms long, entry_id long, value string, expires_ms long"
#: The setting of state stores, and those that processors with timers need.
STORES = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def front(entries: list[tuple], now_ms: int) -> list[tuple]:
    """The entries (version, at, id, value, expires) that hold, best first, without those that a better one outlasts."""
    out: list[tuple] = []
    for e in sorted(set(entries), key=lambda e: e[:3], reverse=True):
        if e[4] > now_ms and (not out or e[4] > out[-1][4]):
            out.append(e)
    return out


class Holding(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", STATE)
        self.rev = handle.getValueState("rev", "rev long")

    def _told(self, key: int, before: list[tuple], after: list[tuple]) -> Iterator[pd.DataFrame]:
        """Keep the entries, wait for the first of them to expire, and tell what is current if that has changed."""
        # the timers of a key are those of the entries that it has, so they need not be asked for
        timers, wanted = {e[4] for e in before}, {e[4] for e in after}
        for t in timers - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - timers:
            self.handle.registerTimer(t)
        if after and after != before:
            self.entries.put(after)
        elif not after and before:
            self.entries.clear()
        if before[:1] == after[:1]:
            return
        rev = (self.rev.get()[0] if self.rev.exists() else 0) + 1
        self.rev.update((rev,))
        e = after[0] if after else (None, None, None, None, None)
        yield pd.DataFrame({"key": [key], "rev": [rev], "version": pd.array([e[0]], "Int64"), "entry_id": pd.array([e[2]], "Int64"), "value": [e[3]], "expires_ms": pd.array([e[4]], "Int64"), "holds": [bool(after)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = [tuple(e) for e in self.entries.get()]
        now = timerValues.getCurrentWatermarkInMs()
        new = [(int(r.version), int(r.at_ms), int(r.entry_id), r.value, int(r.expires_ms)) for frame in rows for r in frame.itertuples()]
        yield from self._told(key[0], before, front(before + new, now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = [tuple(e) for e in self.entries.get()]
        yield from self._told(key[0], before, front(before, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())))

    def close(self) -> None:
        pass


def holding(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of keys whose current entry changed: stream has key, ts, version, entry_id, value and ttl_seconds. Rows older than the
    watermark are dropped; expiry is judged by the watermark, so a replay expires the same entries."""
    ms = lambda c: F.unix_millis(F.col(c))
    own = stream.withWatermark("ts", late).withColumns({"at_ms": ms("ts"), "expires_ms": ms("ts") + F.col("ttl_seconds").cast("long") * 1000})
    return own.groupBy("key").transformWithStateInPandas(Holding(), EVENTS, "Update", "EventTime")


def current_table(stream: DataFrame, store: Store, table: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Keep what is current of every key in a table of a store; keys of which nothing holds are not in it. A micro-batch touches the
    buckets of its keys only, and is part of the commit that it makes."""

    done = f"epoch {table} {checkpoint}"

    def merge(batch: DataFrame, epoch: int) -> None:
        def make(change: Change) -> None:
            if change.facts.get(done, -1) >= epoch:
                return
            last = batch.groupBy("key").agg(F.max_by(F.struct(*batch.columns), "rev").alias("x")).select("x.*").drop("rev")
            change.upsert(table, last.where("holds").drop("holds"), "key", last.where("not holds").select("key"))
            change.facts[done] = epoch

        store.transact(make)

    conf = stream.sparkSession.conf
    before = conf.get(STORES, None)
    conf.set(STORES, PROVIDER)  # a query keeps the settings that it starts with
    try:
        return holding(stream, late).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(STORES, before) if before else conf.unset(STORES)


def current_entries(entries: DataFrame, late_seconds: int) -> DataFrame:
    """current_table() of a whole table, as it is when all its rows have come."""
    now = entries.agg(F.unix_millis(F.max("ts")).alias("m")).select((F.col("m") - late_seconds * 1000).alias("now"))
    own = entries.withColumns({"at_ms": F.unix_millis("ts"), "expires_ms": F.unix_millis("ts") + F.col("ttl_seconds").cast("long") * 1000})
    holds = own.join(F.broadcast(now)).where("expires_ms > now")
    return holds.groupBy("key").agg(F.max_by(F.struct("version", "entry_id", "value", "expires_ms"), F.struct("version", "at_ms", "entry_id")).alias("x")).select("key", "x.*")
