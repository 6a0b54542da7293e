"""Incremental imports, freshness, observations, back-off and counters as streams.

Each stream ends in a table that equals its batch twin on the same input. Upserts go through foreachBatch, where a replayed
batch finds its own rows already there. State that would grow without bound is dropped by watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import Change, Store


def read_stream(spark: SparkSession, folder: str, schema: S.StructType, files_per_batch: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def newest_rows(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key; of equal versions the one of the larger other columns."""
    names = df.columns
    return df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(version, *[c for c in names if c not in (key, version)])).alias("x")).select("x.*")


def upsert_stream(stream: DataFrame, store: Store, table: str, key: str, version: str, checkpoint: str) -> StreamingQuery:
    """Keep the row with the highest version of each key in a table of a store; order of arrival and replays change nothing.

    A micro-batch reads and writes the buckets of its keys only, and its number is part of the same commit, so a batch that runs
    again after a crash finds itself done.
    """

    done = f"epoch {table} {checkpoint}"

    def merge(batch: DataFrame, epoch: int) -> None:
        def make(change: Change) -> None:
            if change.facts.get(done, -1) >= epoch:
                return
            new = newest_rows(batch, key, version)
            if change.base.has(table):
                there = change.base.table(table, change.buckets_of(new, key)).select(*new.columns)
                new = newest_rows(there.join(new.select(key), key, "left_semi").unionByName(new), key, version)
            change.upsert(table, new, key)
            change.facts[done] = epoch

        store.transact(make)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def imported_once(stream: DataFrame, ts: str, keys: tuple[str, ...] = ("checksum", "kind"), late: str = "1 day") -> DataFrame:
    """One row per content and kind within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def counters(stream: DataFrame, term: str, ts: str) -> DataFrame:
    """Counter of each text with the first and last time; update or complete mode."""
    return stream.groupBy(term).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def newest_times(stream: DataFrame, kind: str, ts: str) -> DataFrame:
    """Newest time of each kind; freshness is judged against a clock that the reader passes in."""
    return stream.groupBy(kind).agg(F.max(ts).alias("newest"))


BACKOFF_STATE = "in_row int, pauses int, limits int, paused int, stopped boolean, done int"


def backoff_stream(stream: DataFrame, key: str, order: str) -> DataFrame:
    """State of the back-off rules of each key, one row per key and batch; outcomes of one batch are taken in order."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from ..operators.state import PAUSES

    def step(k, frames, state: GroupState):
        in_row, pauses, limits, paused, stopped, done = state.get if state.exists else (0, 0, 0, 0, False, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for outcome in rows["outcome"]:
            if stopped:
                continue
            if outcome != "rate_limit":
                in_row, pauses, done = 0, 0, done + 1
                continue
            limits, in_row = limits + 1, in_row + 1
            if in_row >= 2:
                if pauses >= PAUSES:
                    stopped = True
                else:
                    pauses, paused = pauses + 1, paused + 1
        state.update((in_row, pauses, limits, paused, stopped, done))
        yield pd.DataFrame([(k[0], limits, paused, stopped, done)], columns=[key, "limits", "pauses", "stopped", "done"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, limits int, pauses int, stopped boolean, done int", BACKOFF_STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its table; for tests and small state."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
