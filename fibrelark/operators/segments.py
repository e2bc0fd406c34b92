"""Stretches of a series without gaps, and runs of a condition.

With ``block`` (microseconds) a series is worked in blocks of time, by as many tasks; without
it each series is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.operators.scans import running


def with_segments(frame: DataFrame, keys: list[str], value: str, step: int, time: str = "timestamp", block: int | None = None) -> DataFrame:
    """Adds ``segment`` and ``pos``, the row's place in it.

    A segment starts where the value is missing, where the one before was, and where
    the time since the row before is not ``step``; so a missing row is alone in its own.
    """
    us = F.unix_micros(F.col(time))
    before = {"__us": ("lag", us), "__there": ("lag", F.col(value).isNotNull())}
    work = running(frame, keys, before, block, time)
    starts = F.col(value).isNull() | ~F.coalesce("__there", F.lit(False)) | F.coalesce(us - F.col("__us") != F.lit(step), F.lit(True))
    work = work.withColumn("__starts", starts)
    work = running(work, keys, {"segment": ("sum", F.col("__starts").cast("long")), "__first": ("max", F.when(F.col("__starts"), us))}, block, time)
    # Rows of a segment are a step apart.
    return work.withColumn("pos", F.expr(f"(unix_micros(`{time}`) - __first) div {step}")).drop("__us", "__there", "__starts", "__first")


def run_length(
    frame: DataFrame, keys: list[str], holds: Column, breaks: Column | None = None, time: str = "timestamp", name: str = "run", block: int | None = None
) -> DataFrame:
    """Adds how many rows in a row, up to this one, the condition held; ``breaks`` marks rows where a run starts anew."""
    held = F.coalesce(holds, F.lit(False))
    anew = ~held if breaks is None else ~held | F.coalesce(breaks, F.lit(False))
    work = frame.withColumn("__held", held.cast("long")).withColumn("__anew", anew)
    work = running(work, keys, {"__sum": ("sum", F.col("__held"))}, block, time)
    # What was counted before the latest start; sums only grow, so it is the greatest such.
    work = running(work, keys, {"__base": ("max", F.when(F.col("__anew"), F.col("__sum") - F.col("__held")))}, block, time)
    return work.withColumn(name, F.col("__sum") - F.coalesce("__base", F.lit(0))).drop("__held", "__anew", "__sum", "__base")


def last_seen(value: str, keys: list[str], time: str = "timestamp") -> Column:
    """The time of the last row up to this one whose value is present."""
    upto = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(F.col(value).isNotNull(), F.col(time)), ignorenulls=True).over(upto)


def with_last_seen(frame: DataFrame, keys: list[str], value: str, name: str, time: str = "timestamp", block: int | None = None) -> DataFrame:
    """Adds the time of the last row up to this one whose value is present."""
    return running(frame, keys, {name: ("max", F.when(F.col(value).isNotNull(), F.col(time)))}, block, time)
