"""Regular time grids: bins closed on the right, completed between a series' first and last bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.functions.columns import finite, from_micros, micros
from fibrelark.schema import METRICS, ContractError

MINUTE = 60_000_000


def bin_end(us: Column, step: int, anchor: Column) -> Column:
    """The end of the bin (t - step, t] that holds a time; all in microseconds."""
    return us + F.pmod(anchor - us, F.lit(step))


def resample(telemetry: DataFrame, interval_minutes: int, kinds: dict[str, str] | None = None) -> DataFrame:
    """One row for each bin of each series, with ``observed``; gauges are averaged and interval counts summed.

    One shuffle on the series serves the anchor, the aggregate and the completion: the
    missing bins between two present ones come from the next bin's time, without a join.
    """
    if interval_minutes <= 0:
        raise ContractError("the interval must be positive")
    if set(telemetry.columns) != {"timestamp", "entity_id", "metric_name", "value"}:
        raise ContractError(f"not canonical telemetry: {telemetry.columns}")
    kinds = kinds or {name: m.kind for name, m in METRICS.items()}
    unknown = F.when(~F.col("metric_name").isin(list(kinds)), F.raise_error(F.concat(F.lit("unknown metric: "), F.col("metric_name"))).cast("string"))
    counted = F.col("metric_name").isin([k for k, kind in kinds.items() if kind == "interval_count"])
    step = interval_minutes * MINUTE
    series = Window.partitionBy("entity_id", "metric_name")
    us = micros(F.col("timestamp"))
    rows = telemetry.select("entity_id", F.coalesce(unknown, F.col("metric_name")).alias("metric_name"), us.alias("us"), finite(F.col("value")).alias("value"))
    if 1440 % interval_minutes:
        # Bins start at midnight of the series' first day; where the step divides a day, any midnight does.
        first = F.min("us").over(series)
        anchor: Column = first - F.pmod(first, F.lit(1440 * MINUTE))
    else:
        anchor = F.lit(0).cast("long")
    binned = rows.withColumn("bin", bin_end(F.col("us"), step, anchor)).groupBy("entity_id", "metric_name", "bin")
    values = binned.agg(F.when(F.first(counted), F.sum("value")).otherwise(F.avg("value")).alias("value"))
    after = F.lead("bin").over(series.orderBy("bin"))
    filled = values.withColumn("last", F.coalesce(after - F.lit(step), F.col("bin")))
    grid = filled.select("entity_id", "metric_name", "bin", "value", F.explode(F.sequence("bin", "last", F.lit(step).cast("long"))).alias("at"))
    value = F.when(F.col("at") == F.col("bin"), F.col("value"))
    return grid.select(from_micros(F.col("at")).alias("timestamp"), "entity_id", "metric_name", value.alias("value"), value.isNotNull().alias("observed"))


def complete(frame: DataFrame, keys: list[str], step: int, time: str = "timestamp") -> DataFrame:
    """Rows of a regular grid between first and last time of each series; other columns are NULL where a row is new."""
    us = micros(F.col(time))
    after = F.lead(us).over(Window.partitionBy(*keys).orderBy(time))
    others = [c for c in frame.columns if c not in (*keys, time)]
    ended = frame.withColumn("__last", F.coalesce(after - F.lit(step), us))
    spread = ended.withColumn("__at", F.explode(F.sequence(us, "__last", F.lit(step).cast("long"))))
    own = F.col("__at") == us
    return spread.select(*keys, from_micros(F.col("__at")).alias(time), *[F.when(own, F.col(c)).alias(c) for c in others])
