"""The test tables as telemetry: event types are entities, hourly means of their values a received power."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.operators.features import FeatureSpec, summarise
from fibrelark.operators.grid import resample
from fibrelark.operators.incidents import Policy, latch
from fibrelark.operators.reference import fit_references, residuals
from fibrelark.operators.scoring import fit_normalizer, normalize
from fibrelark.operators.selection import quantiles

START = datetime(2024, 1, 1, tzinfo=UTC)
HOUR = 3_600_000_000
SPEC = FeatureSpec(window=12, long_window_hours=24.0, interval_minutes=60, smoothing_hours=3.0, allowance=0.25)
POLICY = Policy(high=0.9, low=0.5, opening_intervals=2, closing_intervals=3, interval_minutes=60, max_gap_hours=6.0)
TRAIN_END, CALIBRATION_END, VALIDATION_END, END = (START + timedelta(days=d) for d in (12, 16.5, 22.5, 30))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts as a timestamp; the parquet has it without a zone, and it means UTC."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def telemetry(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    # Types alone are too thin for references on the smallest tables; ``grouped`` joins them into two entities.
    entity = F.when(F.col("event_type").isin("view", "click"), "visits").otherwise("actions") if grouped else F.col("event_type")
    return events(spark, sf_dir).select(F.col("ts").alias("timestamp"), entity.alias("entity_id"), F.lit("rx_power_dbm").alias("metric_name"), "value")


def grid(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    return resample(telemetry(spark, sf_dir, grouped), 60)


def long(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    return grid(spark, sf_dir, grouped).select("entity_id", "timestamp", F.lit("rx").alias("channel"), F.col("value").alias("raw"))


def references(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    train = long(spark, sf_dir, grouped).filter(F.col("timestamp") < F.lit(TRAIN_END))
    return fit_references(train, SPEC.window, 60)


def residual_rows(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    return residuals(long(spark, sf_dir, grouped), references(spark, sf_dir, grouped))


def features(spark: SparkSession, sf_dir: str, *names: str, grouped: bool = False) -> DataFrame:
    return summarise(residual_rows(spark, sf_dir, grouped), SPEC, set(names)).drop("channel")


def scored(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    """entity_id, timestamp, raw and score of the statistical detector."""
    # Calibration and scoring both read the raw scores; the cache is shared by queries with the same plan.
    raw = features(spark, sf_dir, "slope", grouped=grouped).select("entity_id", "timestamp", (-F.col("slope")).alias("raw")).persist()
    calibration = raw.filter((F.col("timestamp") >= F.lit(TRAIN_END)) & (F.col("timestamp") < F.lit(CALIBRATION_END)))
    return normalize(raw, "raw", fit_normalizer(calibration, "raw", check=False), "score")


def incidents(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    return latch(scored(spark, sf_dir, grouped).select("entity_id", "timestamp", "score"), POLICY).persist()


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for fault truth: single high values of a type, a day long, that no other one overlaps."""
    rows = events(spark, sf_dir).select("event_id", F.col("event_type").alias("entity_id"), "ts", "value")
    bound = quantiles(rows, ["entity_id"], "value", {"bound": 0.98})
    high = rows.join(bound, "entity_id").filter(F.col("value") > F.col("bound"))
    us = F.unix_micros("ts")
    before = F.lag(us).over(Window.partitionBy("entity_id").orderBy("ts", "event_id"))
    alone = high.withColumn("before", before).filter(F.coalesce(us - F.col("before") >= 24 * HOUR, F.lit(True)))
    at = lambda hours: F.timestamp_micros(us + F.lit(hours * HOUR))
    return alone.select(
        F.concat(F.lit("F-"), F.col("event_id").cast("string")).alias("fault_id"),
        "entity_id",
        F.when(F.col("event_id") % 3 == 0, "variance_shift").otherwise("exponential").alias("fault_type"),
        F.col("ts").alias("onset_time"),
        F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("observable_onset_time"),
        F.when(F.col("event_id") % 5 != 0, at(12)).alias("impact_time"),
        at(24).alias("end_time"),
    )
