"""Scores on the scale of calibration ranks, and their combination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.functions.columns import finite
from fibrelark.operators.order import quantile_cuts, running_total, with_bucket
from fibrelark.schema import ContractError

LEAST = 100
SMALL = 200_000  # knots that one broadcast holds; more of them meet the scores in buckets


def fit_normalizer(scores: DataFrame, value: str, check: bool = True) -> DataFrame:
    """Knots (value, rank): each distinct calibration score with its mid-rank (cumulative count - count / 2) / n.

    Up to SMALL distinct scores are summed on the driver, more of them in buckets of the value.
    """
    counts = scores.select(finite(F.col(value)).alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    few = counts.limit(SMALL + 1).toPandas()
    if len(few) <= SMALL:
        few = few.sort_values("value")
        n, distinct = int(few["count"].sum()), len(few)
    else:
        total = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("distinct")).first()
        n, distinct = total["n"], total["distinct"]
    if check and n < LEAST:
        raise ContractError(f"only {n} finite calibration scores")
    if check and distinct < 2:
        raise ContractError("calibration scores do not vary")
    if distinct <= SMALL:
        ranks = (few["count"].cumsum() - few["count"] / 2.0) / max(n, 1)
        return scores.sparkSession.createDataFrame(list(zip(few["value"].tolist(), ranks.tolist(), strict=True)), "value double, rank double")
    ranked = running_total(counts, "value", "count", "cumulative")
    return ranked.select("value", ((F.col("cumulative") - F.col("count") / 2.0) / F.lit(float(n))).alias("rank"))


def normalize(scores: DataFrame, value: str, knots: DataFrame, name: str) -> DataFrame:
    """Adds the rank of each score by linear interpolation between knots: 0 below all, 1 above all, NULL if missing."""
    few = knots.select("value", "rank").limit(SMALL + 1).toPandas().sort_values("value")
    if len(few) > SMALL:
        return normalize_in_buckets(scores, value, knots, name)
    known, ranks = few["value"].to_numpy(float), few["rank"].to_numpy(float)

    @F.pandas_udf("double")
    def rank(v: pd.Series) -> pd.Series:
        at = v.to_numpy(float)
        if not len(known):
            return pd.Series(np.full(len(at), np.nan), index=v.index)
        out = np.interp(at, known, ranks)
        return pd.Series(np.where(np.isnan(at), np.nan, np.where(at < known[0], 0.0, np.where(at > known[-1], 1.0, out))), index=v.index)

    made = scores.withColumn("__r", rank(finite(F.col(value))))
    return made.withColumn(name, F.when(~F.isnan("__r"), F.col("__r"))).drop("__r")


def normalize_in_buckets(scores: DataFrame, value: str, knots: DataFrame, name: str) -> DataFrame:
    """``normalize`` for any number of knots.

    Scores and knots meet in buckets of the value; a knot on a cut belongs to both
    sides, so each bucket has both neighbours of its scores.
    """
    cuts = quantile_cuts(knots, "value")
    score = finite(F.col(value))
    left = with_bucket(scores.withColumn("__v", score), "__v", cuts, "__bucket")
    own = with_bucket(knots, "value", cuts, "__bucket")
    # A cut is a knot: it opens its bucket and also closes the one before.
    closing = own.filter(F.col("value").isin(cuts)).withColumn("__bucket", F.col("__bucket") - 1) if cuts else own.limit(0)
    placed = own.unionByName(closing).select("__bucket", F.struct("value", "rank").alias("knot"))
    grouped = left.unionByName(placed.withColumns({"__v": F.col("knot.value")}), allowMissingColumns=True)
    before = Window.partitionBy("__bucket").orderBy("__v").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("__bucket").orderBy(F.desc("__v")).rangeBetween(Window.unboundedPreceding, 0)
    near = grouped.withColumns({"__low": F.last("knot", ignorenulls=True).over(before), "__high": F.last("knot", ignorenulls=True).over(after)})
    low, high, v = F.col("__low"), F.col("__high"), F.col("__v")
    between = low["rank"] + (high["rank"] - low["rank"]) * F.try_divide(v - low["value"], high["value"] - low["value"])
    rank: Column = (
        F.when(v.isNull(), F.lit(None).cast("double"))
        .when(low.isNull(), F.lit(0.0))
        .when(high.isNull(), F.lit(1.0))
        .when(low["value"] == high["value"], low["rank"])
        .otherwise(between)
    )
    return near.filter(F.col("knot").isNull()).withColumn(name, rank).select(*scores.columns, name)


def statistical_raw(features: DataFrame) -> DataFrame:
    """Adds the raw score of the statistical detector: how fast the smoothed residual falls."""
    return features.withColumn("raw", -F.col("slope"))


def combined(*scores: Column) -> Column:
    """The greatest score; missing as soon as one is missing (greatest() alone would skip it)."""
    present = scores[0].isNotNull()
    for s in scores[1:]:
        present = present & s.isNotNull()
    return F.when(present, F.greatest(*scores))
