"""Ordered state: rate-limit back-off over an outcome log, coverage of served batches, greedy running totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAUSES = 3


def backoff(log: DataFrame, key: str, order: str) -> DataFrame:
    """key, limits, pauses, stopped, done for each key's log in order; outcome is rate_limit, or anything else.

    The first limit widens the gap, a second in a row pauses, a limit after PAUSES pauses stops the run; another outcome
    resets both counters. What comes after a stop is not done. Logs stream through in order, so a long one is not held.
    """
    rows = log.select(key, order, "outcome").repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            for k, outcome in zip(pdf[key].tolist(), pdf["outcome"].tolist(), strict=True):
                if state is None or k != now:
                    if state is not None:
                        out.append(state)
                    now, state, in_row, pauses = k, [k, 0, 0, False, 0], 0, 0
                if state[3]:
                    continue
                if outcome != "rate_limit":
                    in_row = pauses = 0
                    state[4] += 1
                    continue
                state[1] += 1
                in_row += 1
                if in_row >= 2:
                    if pauses >= PAUSES:
                        state[3] = True
                        continue
                    pauses += 1
                    state[2] += 1
            yield pd.DataFrame(out, columns=[key, "limits", "pauses", "stopped", "done"])
        if state is not None:
            yield pd.DataFrame([state], columns=[key, "limits", "pauses", "stopped", "done"])

    return rows.mapInPandas(run, f"{key} long, limits int, pauses int, stopped boolean, done int")


def coverage(served: DataFrame, key: str, offset: str, following: str) -> DataFrame:
    """key and code: a gap where a batch does not begin at the end of the one before, incomplete where the last one has no end."""
    w = Window.partitionBy(key).orderBy(offset)
    rows = served.withColumn("_due", F.coalesce(F.lag(following).over(w), F.lit(0))).withColumn("_last", F.lead(offset).over(w).isNull())
    gap = F.max((F.col("_due") != F.col(offset)).cast("int")) == 1
    open_ = F.max((F.col("_last") & F.col(following).isNotNull()).cast("int")) == 1
    return rows.groupBy(key).agg(F.when(gap, "GAP").when(open_, "INCOMPLETE").otherwise("COMPLETE").alias("code"))


def greedy_batches(items: Column, size: str, limit: int) -> Column:
    """Number of the batch of each of the ordered structs: a batch closes when the next would exceed the limit; an oversize one stands alone."""
    start = F.struct(F.lit(-1).cast("int").alias("b"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("all"))

    def step(acc, x):
        new = (acc["b"] < 0) | (acc["sum"] + x[size] > limit)
        b = F.when(new, acc["b"] + 1).otherwise(acc["b"])
        return F.struct(b.alias("b"), F.when(new, x[size].cast("long")).otherwise(acc["sum"] + x[size]).alias("sum"), F.concat(acc["all"], F.array(b)).alias("all"))

    return F.aggregate(items, start, step, lambda acc: acc["all"])


def fitted(items: Column, size: str, budget: int) -> Column:
    """Whether each of the ordered structs is kept: the first always, a later one while the kept ones' sizes still fit."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<boolean>").alias("all"))

    def step(acc, x):
        keep = (F.size(acc["all"]) == 0) | (acc["sum"] + x[size] <= budget)
        return F.struct(F.when(keep, acc["sum"] + x[size]).otherwise(acc["sum"]).cast("long").alias("sum"), F.concat(acc["all"], F.array(keep)).alias("all"))

    return F.aggregate(items, start, step, lambda acc: acc["all"])
