"""Reports on telemetry: quality, missingness, healthy statistics, faults, dependence."""

from __future__ import annotations

import math
from datetime import datetime
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.functions.columns import day_phase, finite
from fibrelark.operators.grid import MINUTE, complete
from fibrelark.operators.matching import meet
from fibrelark.operators.regression import correlation, fitted, least_squares, spearman
from fibrelark.operators.segments import last_seen, run_length
from fibrelark.operators.selection import quantiles

DAY_HOURS = 24.0


def observation_quality(telemetry: DataFrame, interval_minutes: int, window: int = 12, metric: str = "rx_power_dbm") -> DataFrame:
    """Causal indicators of one metric on its regular grid."""
    keys = ["entity_id"]
    rows = telemetry.filter(F.col("metric_name") == metric).select("entity_id", "timestamp", finite(F.col("value")).alias("value"))
    order = Window.partitionBy(*keys).orderBy("timestamp")
    us = F.unix_micros("timestamp")
    rows = rows.withColumn("current_observed", F.col("value").isNotNull())
    rows = rows.withColumn("__gap", F.coalesce(us - F.lag(us).over(order) != F.lit(interval_minutes * MINUTE), F.lit(True)))
    rows = run_length(rows, keys, F.col("current_observed"), F.col("__gap"), name="__present")
    # A row after a gap opens a new count of missing rows, beginning with itself.
    rows = run_length(rows, keys, ~F.col("current_observed"), F.col("__gap"), name="missing_run_intervals")
    recent = order.rowsBetween(-(window - 1), 0)
    full = F.count(F.lit(1)).over(recent) == window
    return rows.select(
        "entity_id",
        "timestamp",
        "current_observed",
        F.when(full, F.avg(F.col("current_observed").cast("double")).over(recent)).alias("recent_observed_fraction"),
        "missing_run_intervals",
        ((us - F.unix_micros(last_seen("value", keys))) / F.lit(60e6)).alias("minutes_since_observation"),
        (F.col("__present") * F.lit(interval_minutes / 60)).alias("contiguous_history_hours"),
    )


def missingness_report(native: DataFrame, time: str = "time", device: str = "device") -> DataFrame:
    """Rows, observed values, missing share, longest missing run and distinct values of each device and column."""
    columns = [c for c in native.columns if c not in (time, device)]
    wide = native.select(F.col(time).alias("timestamp"), F.col(device).cast("string").alias("entity_id"), *[finite(F.col(c)).alias(c) for c in columns])
    long = wide.unpivot(["timestamp", "entity_id"], columns, "measurement", "value")
    runs = run_length(long, ["entity_id", "measurement"], F.col("value").isNull())
    return runs.groupBy("entity_id", "measurement").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("observed"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing_fraction"),
        F.max("run").alias("longest_missing_intervals"),
        F.countDistinct("value").alias("unique_observed_values"),
    )


def healthy_statistics(
    healthy: DataFrame, interval_minutes: int, noise_db: float, sensor_noise_db: float, correlation_hours: float, daily_amplitude_db: float
) -> DataFrame:
    """Path-loss residuals of each device against what the source was set to."""
    expected_var = noise_db**2 + sensor_noise_db**2
    expected_rho = math.exp(-interval_minutes / (60 * correlation_hours)) * noise_db**2 / expected_var
    keys = ["entity_id"]
    loss = finite(F.col("olt_tx_dbm")) - finite(F.col("rx_dbm"))
    rows = healthy.select(F.col("device").alias("entity_id"), F.col("time").alias("timestamp"), loss.alias("loss"))
    us = F.unix_micros("timestamp")
    first = F.min(us).over(Window.partitionBy(*keys))
    rows = rows.withColumn("phase", (us - first) * F.lit(2 * math.pi / (DAY_HOURS * 60 * MINUTE)))
    terms = [F.lit(1.0), F.sin("phase"), F.cos("phase")]
    fits = least_squares(rows, keys, "loss", terms).filter("n >= 100")
    order = Window.partitionBy(*keys).orderBy("timestamp")
    work = rows.join(fits, keys).withColumn("r", F.col("loss") - fitted(terms))
    adjacent = us - F.lag(us).over(order) == F.lit(interval_minutes * MINUTE)
    work = work.withColumn("before", F.when(adjacent, F.lag("r").over(order)))
    amplitude = F.hypot(F.element_at(F.first("beta"), 2), F.element_at(F.first("beta"), 3))
    stats = work.groupBy(*keys).agg(
        amplitude.alias("daily_amplitude_db"), F.var_samp("r").alias("residual_variance"), correlation(F.col("r"), F.col("before"), 2).alias("residual_lag1")
    )
    return stats.select(
        "entity_id",
        "daily_amplitude_db",
        F.lit(daily_amplitude_db).alias("expected_amplitude_db"),
        "residual_variance",
        F.lit(expected_var).alias("expected_variance"),
        "residual_lag1",
        F.lit(expected_rho).alias("expected_lag1"),
        (F.abs(F.col("daily_amplitude_db") - daily_amplitude_db) <= max(0.05, daily_amplitude_db * 0.2)).alias("amplitude_in_band"),
        (F.abs(F.col("residual_variance") / expected_var - 1) <= 0.25).alias("variance_in_band"),
        F.coalesce(F.abs(F.col("residual_lag1") - expected_rho) <= 0.1, F.lit(False)).alias("correlation_in_band"),
    )


def development_faults(truth: DataFrame, native: DataFrame, end: datetime, interval_minutes: int, minimum_lead_minutes: float = 30, opportunity_intervals: int = 3) -> DataFrame:
    """Faults that end by ``end``, with duration, warning time and whether readings at the exact cadence gave a chance."""
    faults = truth.filter((F.col("onset_time") < F.lit(end)) & (F.col("end_time") <= F.lit(end)))
    until = F.timestamp_micros(F.unix_micros("impact_time") - F.lit(int(minimum_lead_minutes * MINUTE)))
    spans = faults.select("fault_id", F.col("entity_id").alias("e"), F.col("observable_onset_time").alias("from"), until.alias("until"))
    seen = native.select(F.col("device").alias("entity_id"), F.col("time").alias("timestamp"), finite(F.col("rx_dbm")).alias("value"))
    view = meet(seen, "entity_id", "timestamp", spans, "e", "from", "until", closed=True)
    us = F.unix_micros("timestamp")
    order = Window.partitionBy("fault_id").orderBy("timestamp")
    view = view.withColumn("__gap", F.coalesce(us - F.lag(us).over(order) != F.lit(interval_minutes * MINUTE), F.lit(True)))
    # At the exact cadence the row after a break counts from zero, so it is a break itself.
    runs = run_length(view, ["fault_id"], F.col("value").isNotNull(), F.col("__gap"))
    chances = runs.groupBy("fault_id").agg((F.max("run") >= opportunity_intervals).alias("chance"))
    minutes = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(60e6)
    return faults.join(chances, "fault_id", "left").select(
        *truth.columns,
        (minutes("end_time", "onset_time") / 60).alias("duration_hours"),
        minutes("impact_time", "observable_onset_time").alias("warning_minutes"),
        F.coalesce("chance", F.lit(False)).alias("warning_opportunity_proxy"),
    )


def fault_contrasts(native: DataFrame, faults: DataFrame) -> DataFrame:
    """The day before each fault against the fault: medians, low tail, spread, missing shares; one range join."""
    rows = native.select(F.col("device").alias("d"), F.col("time").alias("t"), finite(F.col("rx_dbm")).alias("v"))
    f = faults.select("fault_id", "fault_type", "entity_id", "onset_time", "end_time").withColumn("from", F.expr("onset_time - INTERVAL 1 DAY"))
    joined = meet(rows, "d", "t", f, "entity_id", "from", "end_time")
    before, during = F.col("t") < F.col("onset_time"), F.col("t") >= F.col("onset_time")
    b, d = F.when(before, F.col("v")), F.when(during, F.col("v"))
    sums = joined.groupBy("fault_id", "fault_type").agg(
        F.median(b).alias("mb"), F.median(d).alias("md"), F.percentile(d, 0.05).alias("low"), F.stddev_samp(b).alias("sb"), F.stddev_samp(d).alias("sd"),
        F.avg(F.when(before, F.col("v").isNull().cast("double"))).alias("missing_before"), F.avg(F.when(during, F.col("v").isNull().cast("double"))).alias("missing_during"),
    )
    sums = faults.select("fault_id", "fault_type").distinct().join(sums, ["fault_id", "fault_type"], "left")  # also faults without readings
    return sums.select(
        "fault_id", "fault_type", (F.col("md") - F.col("mb")).alias("median_change_db"), (F.col("low") - F.col("mb")).alias("low_tail_change_db"),
        F.when(F.col("sb") > 0, F.col("sd") / F.col("sb")).alias("std_ratio"), "missing_before", "missing_during",
    )


def _lagged(frame: DataFrame, keys: list[str], value: str, lags: list[int]) -> DataFrame:
    """Adds the value some rows back; the grid is regular, so rows are intervals."""
    order = Window.partitionBy(*keys).orderBy("timestamp")
    return frame.withColumns({f"lag_{k}": F.lag(value, k).over(order) for k in lags})


def canonical_statistics(telemetry: DataFrame, interval_minutes: int) -> DataFrame:
    """Moments, autocorrelations and the gain of daily and weekly terms on held-out time, for each series."""
    keys = ["entity_id", "metric_name"]
    rows = telemetry.select(*keys, "timestamp", finite(F.col("value")).alias("value"))
    grid = complete(rows, keys, interval_minutes * MINUTE)
    daily, weekly = max(1, round(1440 / interval_minutes)), max(1, round(10080 / interval_minutes))
    by = Window.partitionBy(*keys)
    us = F.unix_micros("timestamp")
    grid = _lagged(grid, keys, "value", sorted({1, daily, weekly}))
    grid = grid.withColumn("days", (us - F.min(us).over(by)) / F.lit(86_400e6)).withColumn("span", F.max("days").over(by))
    grid = grid.withColumn("train", F.col("days") < F.col("span") * 0.7).persist()
    v = F.col("value")
    base = grid.groupBy(*keys).agg(
        F.count(v).alias("observed"), F.avg(v.isNull().cast("double")).alias("missing_fraction"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        correlation(v, F.col("lag_1"), 2).alias("lag1"), correlation(v, F.col(f"lag_{daily}"), 2).alias("lag_daily"),
        F.when(F.max("span") >= 14, correlation(v, F.col(f"lag_{weekly}"), 2)).alias("lag_weekly"),
        F.count(F.when(F.col("train"), v)).alias("n_train"), F.count(F.when(~F.col("train"), v)).alias("n_test"),
        F.avg(F.when(F.col("train"), v)).alias("train_mean"), (F.max("span") * 0.7).alias("cut"),
    )
    phase = F.col("days") * F.lit(2 * math.pi)
    terms = [F.lit(1.0), F.sin(phase), F.cos(phase), F.sin(phase / 7), F.cos(phase / 7)]
    out = base
    for n, name in ((3, "daily"), (5, "weekly")):
        fits = least_squares(grid.filter("train"), keys, "value", terms[:n]).withColumnRenamed("n", "fit_n")
        means = base.select(*keys, "train_mean")
        tests = grid.filter(~F.col("train") & v.isNotNull()).join(fits, keys).join(means, keys)
        errors = tests.groupBy(*keys).agg(
            F.avg(F.pow(v - fitted(terms[:n]), 2)).alias("mse"), F.avg(F.pow(v - F.col("train_mean"), 2)).alias("flat"), F.first("beta").alias("beta")
        )
        amplitude = F.hypot(F.element_at("beta", 2), F.element_at("beta", 3))
        out = out.join(errors.select(*keys, (1 - F.try_divide("mse", "flat")).alias(f"{name}_r2"), amplitude.alias(f"{name}_amp")), keys, "left")
    enough = (F.col("n_train") >= 100) & (F.col("n_test") >= 30)
    return out.select(
        *keys, "observed", "missing_fraction", "mean", "std", "minimum", "maximum", "lag1", "lag_daily", "lag_weekly",
        F.when(enough, F.col("daily_amp")).alias("daily_amplitude"), F.when(enough, F.col("daily_r2")).alias("daily_holdout_r2"),
        F.when(enough & (F.col("cut") >= 21), F.col("weekly_r2")).alias("daily_weekly_holdout_r2"),
    )


def _views(telemetry: DataFrame, interval_minutes: int) -> DataFrame:
    """entity_id, metric_name, timestamp, view, value on each entity's grid; the second view has the daily pattern removed."""
    keys = ["entity_id", "metric_name"]
    rows = telemetry.select(*keys, "timestamp", finite(F.col("value")).alias("value"))
    ends = rows.groupBy("entity_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    times = ends.select("entity_id", F.explode(F.sequence(F.unix_micros("a"), F.unix_micros("b"), F.lit(interval_minutes * MINUTE).cast("long"))).alias("us"))
    series = rows.select(*keys).distinct().join(times, "entity_id").select(*keys, F.timestamp_micros("us").alias("timestamp"))
    raw = series.join(rows, [*keys, "timestamp"], "left")
    phase = day_phase(F.col("timestamp"))
    terms = [F.lit(1.0), F.sin(phase), F.cos(phase)]
    varied = rows.groupBy(*keys).agg((F.countDistinct("value") >= 2).alias("varied"), F.max(F.abs("value")).alias("top"))
    fits = least_squares(raw, keys, "value", terms).join(varied, keys).filter("n >= 4 and varied")
    left = raw.join(fits, keys, "left").withColumn("r", F.col("value") - fitted(terms))
    flat = left.groupBy(*keys).agg((F.stddev_samp("r") > F.greatest(F.lit(1.0), F.first("top")) * 100 * 2.220446049250313e-16).alias("keeps"))
    residual = left.join(flat, keys).select(*keys, "timestamp", F.lit("daily_residual").alias("view"), F.when(F.col("keeps"), F.col("r")).alias("value"))
    return raw.select(*keys, "timestamp", F.lit("raw").alias("view"), "value").unionByName(residual)


def dependence_reports(telemetry: DataFrame, interval_minutes: int, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """(correlations of every pair of metrics, autocorrelations at fixed lags), raw and without the daily pattern."""
    views = _views(telemetry, interval_minutes)
    keys = ["entity_id", "view"]
    wide = views.groupBy(*keys, "timestamp").agg(*[F.max(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in metrics])
    there = views.select("entity_id", "metric_name").distinct()
    pairs = None
    for a, b in combinations(metrics, 2):
        plain = wide.groupBy(*keys).agg(
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("paired_observations"), correlation(F.col(a), F.col(b)).alias("pearson")
        )
        own = plain.join(spearman(wide, keys, a, b).drop("paired"), keys, "left").withColumns({"left": F.lit(a), "right": F.lit(b)})
        for side in ("left", "right"):
            own = own.join(there.withColumnRenamed("metric_name", side), ["entity_id", side], "left_semi")
        pairs = own if pairs is None else pairs.unionByName(own)
    lags = sorted({1, *(max(1, round(m / interval_minutes)) for m in (30, 60, 360, 720, 1440, 2880, 10080))})
    series = ["entity_id", "view", "metric_name"]
    lagged = _lagged(views, series, "value", lags)
    rows = lagged.unpivot([*series, "timestamp", "value"], [f"lag_{k}" for k in lags], "lag", "before")
    acf = rows.groupBy(*series, "lag").agg(
        F.count_if(F.col("value").isNotNull() & F.col("before").isNotNull()).alias("paired_observations"), correlation(F.col("value"), F.col("before")).alias("autocorrelation")
    )
    n = F.substring_index("lag", "_", -1).cast("long")
    acf = acf.select("entity_id", "view", "metric_name", n.alias("lag_intervals"), (n * interval_minutes).alias("lag_minutes"), "paired_observations", "autocorrelation")
    if pairs is not None:
        pairs = pairs.select("entity_id", "view", "left", "right", "paired_observations", "pearson", "spearman")
    return pairs, acf


def feature_availability(features: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """For each feature set: the share of rows with all its features, and the first such time."""
    out = None
    for name, columns in sets.items():
        ready = F.lit(True)
        for c in columns:
            ready = ready & F.col(c).isNotNull()
        own = features.agg(F.avg(ready.cast("double")).alias("available_fraction"), F.min(F.when(ready, F.col("timestamp"))).alias("first_ready")).select(
            F.lit(name).alias("feature_set"), F.lit(len(columns)).alias("features"), "available_fraction", "first_ready"
        )
        out = own if out is None else out.unionByName(own)
    return out


def error_regimes(native: DataFrame, columns: list[str]) -> DataFrame:
    """For each count column: rows, share of zeros, median and 99th percentile."""
    long = native.select(*[finite(F.col(c)).alias(c) for c in columns]).unpivot([], columns, "measurement", "value")
    v = F.col("value")
    base = long.groupBy("measurement").agg(F.count(v).alias("observed"), F.avg(F.when(v.isNotNull(), (v == 0).cast("double"))).alias("zero_fraction"))
    return base.join(quantiles(long, ["measurement"], "value", {"median": 0.5, "p99": 0.99}), "measurement")


def hourly_profile(telemetry: DataFrame) -> DataFrame:
    """Median of values centred on their series' median, by UTC hour."""
    keys = ["entity_id", "metric_name"]
    middle = quantiles(telemetry, keys, "value", {"m": 0.5})
    centred = telemetry.join(middle, keys).select("metric_name", F.hour("timestamp").alias("hour"), (F.col("value") - F.col("m")).alias("c"))
    return quantiles(centred, ["metric_name", "hour"], "c", {"median_centred": 0.5})


def outcome_summary(outcomes: DataFrame, by: Column | str = "fault_type") -> DataFrame:
    """Counts and median delay of fault outcomes by type."""
    return outcomes.groupBy(by).agg(
        F.count(F.lit(1)).alias("faults"), F.count_if("detected").alias("detected"), F.count_if("opportunity").alias("opportunities"),
        F.median("delay_minutes").alias("median_delay_minutes"),
    )

