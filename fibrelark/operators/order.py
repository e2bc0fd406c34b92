"""Totals and neighbours along one global order, without bringing the rows to one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTS = 256


def quantile_cuts(frame: DataFrame, value: str, n: int = CUTS) -> list[float]:
    """At most n values that part a column evenly; bounded whatever the table's size."""
    shares = [k / n for k in range(1, n)]
    found = frame.agg(F.percentile_approx(value, shares, 10 * n).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def with_bucket(frame: DataFrame, value: str, cuts: list[float], name: str = "bucket") -> DataFrame:
    """Adds how many cuts are at or below a value."""
    known = np.array(cuts, float)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known, v.to_numpy(float), "right").astype("int32"), index=v.index)

    return frame.withColumn(name, place(F.col(value).cast("double")))


def running_total(frame: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each one in the order of distinct ``order`` values.

    Rows are dealt by value into buckets; the totals of the buckets before come by a join with a bounded table.
    """
    cuts = quantile_cuts(frame, order)
    dealt = with_bucket(frame, order, cuts)
    sums = dealt.groupBy("bucket").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most CUTS rows
    offsets = sums.select("bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(offsets), "bucket").withColumn(name, F.col("__before") + F.sum(value).over(inside)).drop("bucket", "__before")
