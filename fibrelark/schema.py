"""Canonical measurements and the shapes of the engine's tables."""

from __future__ import annotations

from dataclasses import dataclass


class ContractError(ValueError):
    """A table or a setting breaks its contract."""


@dataclass(frozen=True)
class Metric:
    unit: str
    kind: str  # gauge, or interval_count for counts of the reporting interval that ends at the timestamp
    description: str


DIRECTIONS = ("downstream", "upstream")
FEC_KINDS = ("corrected", "uncorrectable", "total")


def fec_metric(direction: str, kind: str) -> str:
    return f"{direction}_fec_{kind}_codewords"


# The canonical measurements.
METRICS: dict[str, Metric] = {
    "rx_power_dbm": Metric("dBm", "gauge", "power received by the subscriber unit"),
    "upstream_rx_power_dbm": Metric("dBm", "gauge", "power received by the line terminal from the unit"),
    "ont_tx_power_dbm": Metric("dBm", "gauge", "power sent by the subscriber unit"),
    "olt_tx_power_dbm": Metric("dBm", "gauge", "power sent by the shared port"),
    "ont_temperature_c": Metric("C", "gauge", "temperature of the subscriber unit"),
    "olt_temperature_c": Metric("C", "gauge", "temperature of the shared port"),
    "ber": Metric("ratio", "gauge", "bit error ratio before correction, downstream"),
    "upstream_ber": Metric("ratio", "gauge", "bit error ratio before correction, upstream"),
} | {
    fec_metric(d, k): Metric("interval_count", "interval_count", f"{k} codewords of the interval, {d}")
    for d in DIRECTIONS
    for k in FEC_KINDS
}

# Columns of the wide source and their canonical names.
NATIVE_TO_CANONICAL: dict[str, str] = {
    "rx_dbm": "rx_power_dbm",
    "upstream_rx_dbm": "upstream_rx_power_dbm",
    "ont_tx_dbm": "ont_tx_power_dbm",
    "olt_tx_dbm": "olt_tx_power_dbm",
    "ont_temperature_c": "ont_temperature_c",
    "olt_temperature_c": "olt_temperature_c",
} | {fec_metric(d, k): fec_metric(d, k) for d in DIRECTIONS for k in FEC_KINDS}

CANONICAL = "timestamp timestamp, entity_id string, metric_name string, value double"
KEYS = ["entity_id", "metric_name", "timestamp"]
