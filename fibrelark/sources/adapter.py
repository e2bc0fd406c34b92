"""Wide source tables to canonical telemetry: declared mappings, units, time zones, checked keys."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fibrelark.functions.columns import count_or_null, finite, milliwatt_to_dbm, ratio_or_null
from fibrelark.schema import KEYS, METRICS, NATIVE_TO_CANONICAL, ContractError


@dataclass(frozen=True)
class TelemetryAdapter:
    """``metrics`` maps source columns to canonical names; unit and kind are declared for each, never guessed."""

    metrics: dict[str, str]
    units: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    timestamp_column: str = "timestamp"
    entity_column: str = "entity_id"
    timezone: str = "UTC"

    def _check_mapping(self, native: DataFrame) -> None:
        if not self.metrics:
            raise ContractError("no measurement is mapped")
        missing = {self.timestamp_column, self.entity_column, *self.metrics} - set(native.columns)
        if missing:
            raise ContractError(f"missing columns: {sorted(missing)}")
        if len(set(self.metrics.values())) < len(self.metrics):
            raise ContractError("two columns map to one measurement")
        for name in self.metrics.values():
            if name not in METRICS:
                raise ContractError(f"unknown measurement: {name}")
            if self.kinds.get(name) != METRICS[name].kind:
                raise ContractError(f"{name} must be declared as {METRICS[name].kind}")
            if self.units.get(name) != METRICS[name].unit and not (METRICS[name].unit == "dBm" and self.units.get(name) in ("mW", "W")):
                raise ContractError(f"no conversion to {METRICS[name].unit} for {name}")

    def _value(self, source: str, name: str) -> Column:
        value = finite(F.col(f"`{source}`").cast("double"))  # ANSI casts raise on text that is no number
        if self.units[name] != METRICS[name].unit:
            value = milliwatt_to_dbm(value, 1000.0 if self.units[name] == "W" else 1.0)
        if METRICS[name].unit == "ratio":
            value = ratio_or_null(value)
        if METRICS[name].kind == "interval_count":
            value = count_or_null(value)
        return value

    def _timestamp(self, native: DataFrame) -> Column:
        column = F.col(f"`{self.timestamp_column}`")
        if isinstance(native.schema[self.timestamp_column].dataType, T.TimestampType):
            return column
        local = column.cast("timestamp_ntz")
        utc = F.convert_timezone(F.lit(self.timezone), F.lit("UTC"), local)
        back = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(self.timezone), t)
        hour = F.expr("INTERVAL 1 HOUR")
        twice = (back(utc + hour) == local) | (back(utc - hour) == local)
        return (
            F.when(local.isNull(), F.lit(None).cast("timestamp"))
            .when(back(utc) != local, F.raise_error(F.concat(F.lit("no such local time: "), local.cast("string"))).cast("timestamp"))
            .when(twice, F.raise_error(F.concat(F.lit("ambiguous local time: "), local.cast("string"))).cast("timestamp"))
            .otherwise(F.to_utc_timestamp(local.cast("timestamp"), F.lit("UTC")) if self.timezone == "UTC" else utc.cast("timestamp"))
        )

    def transform(self, native: DataFrame, check: bool = True) -> DataFrame:
        """timestamp, entity_id, metric_name, value; missing values stay as rows with NULL.

        ``check`` runs one aggregate over the keys; without it the caller vouches for them.
        """
        self._check_mapping(native)
        entity = F.col(f"`{self.entity_column}`").cast("string")
        wide = native.select(
            self._timestamp(native).alias("timestamp"), entity.alias("entity_id"), *[self._value(s, name).alias(name) for s, name in self.metrics.items()]
        )
        long = wide.unpivot(["timestamp", "entity_id"], list(self.metrics.values()), "metric_name", "value")
        if check:
            check_keys(long)
        return long.select("timestamp", "entity_id", "metric_name", "value")


def check_keys(telemetry: DataFrame) -> None:
    """Raises if a timestamp is missing, an entity is blank or a key repeats."""
    per_key = telemetry.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    row = per_key.agg(
        F.max(F.col("timestamp").isNull()).alias("no_time"),
        F.max(F.coalesce(F.trim("entity_id") == "", F.lit(True))).alias("no_entity"),
        F.max(F.col("n") > 1).alias("twice"),
    ).first()
    for name, said in (("no_time", "missing timestamps"), ("no_entity", "blank entity ids"), ("twice", "duplicate entity/metric/timestamp keys")):
        if row[name]:
            raise ContractError(said)


def synthetic_adapter(sources: Iterable[str] | None = None) -> TelemetryAdapter:
    """The adapter of the simulated source, for all or some of its columns."""
    chosen = list(NATIVE_TO_CANONICAL) if sources is None else list(sources)
    if unknown := set(chosen) - set(NATIVE_TO_CANONICAL):
        raise ContractError(f"unknown source columns: {sorted(unknown)}")
    metrics = {s: NATIVE_TO_CANONICAL[s] for s in chosen}
    return TelemetryAdapter(
        metrics, {m: METRICS[m].unit for m in metrics.values()}, {m: METRICS[m].kind for m in metrics.values()}, timestamp_column="time", entity_column="device"
    )


def require_downstream_rx(telemetry: DataFrame) -> None:
    """Every entity needs a present rx_power_dbm value; lists up to 20 that have none."""
    has = F.max((F.col("metric_name") == "rx_power_dbm") & F.col("value").isNotNull())
    lacking = telemetry.groupBy("entity_id").agg(has.alias("has")).filter(~F.coalesce("has", F.lit(False))).orderBy("entity_id").limit(20)
    if rows := lacking.collect():
        raise ContractError(f"no received power for: {[r['entity_id'] for r in rows]}")
