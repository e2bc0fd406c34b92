"""Measurement channels: canonical rows side by side, losses and logarithmic error fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrelark.schema import DIRECTIONS, METRICS, fec_metric

ERROR_SCALE = 1e-6


def side_by_side(telemetry: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each entity and time with a column for each metric, in one aggregate without a discovery job."""
    columns = [F.max(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in metrics]
    return telemetry.filter(F.col("metric_name").isin(metrics)).groupBy("entity_id", "timestamp").agg(*columns)


def error_fraction(kind: str, direction: str) -> Column:
    """log1p of the share of codewords per million; NULL if the counts contradict each other."""
    corrected, lost, total = (F.col(fec_metric(direction, k)) for k in ("corrected", "uncorrectable", "total"))
    share = F.when(total > 0, F.col(fec_metric(direction, kind)) / total)
    contradicts = F.coalesce(corrected + lost > total, F.lit(False))
    return F.when(share.between(0.0, 1.0) & ~contradicts, F.log1p(share / ERROR_SCALE))


def derivations() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Each channel with the metrics it needs."""
    out: dict[str, tuple[tuple[str, ...], Column]] = {
        "upstream_rx": (("upstream_rx_power_dbm",), F.col("upstream_rx_power_dbm")),
        "downstream_loss": (("olt_tx_power_dbm", "rx_power_dbm"), F.col("olt_tx_power_dbm") - F.col("rx_power_dbm")),
        "upstream_loss": (("ont_tx_power_dbm", "upstream_rx_power_dbm"), F.col("ont_tx_power_dbm") - F.col("upstream_rx_power_dbm")),
    }
    for direction in DIRECTIONS:
        for kind in ("corrected", "uncorrectable"):
            needed = tuple(fec_metric(direction, k) for k in ("corrected", "uncorrectable", "total"))
            out[f"{direction}_fec_{kind}"] = (needed, error_fraction(kind, direction))
    return out | {
        "ont_temperature": (("ont_temperature_c",), F.col("ont_temperature_c")),
        "olt_temperature": (("olt_temperature_c",), F.col("olt_temperature_c")),
    }


def measurement_channels(telemetry: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """entity_id, timestamp and every channel whose metrics are there. ``metrics`` names those of the table."""
    there = list(METRICS) if metrics is None else metrics
    wide = side_by_side(telemetry, there)
    made = {name: value for name, (needs, value) in derivations().items() if set(needs) <= set(there)}
    return wide.select("entity_id", "timestamp", *[value.alias(name) for name, value in made.items()])


def to_long(channels: DataFrame, names: list[str]) -> DataFrame:
    return channels.unpivot(["entity_id", "timestamp"], names, "channel", "raw")
