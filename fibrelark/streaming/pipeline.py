"""Streams: right-closed bins with a watermark, and incidents with state per entity."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fibrelark.functions.columns import finite
from fibrelark.operators.incidents import INCIDENT, Machine, Policy
from fibrelark.schema import METRICS, ContractError


def streaming_bins(telemetry: DataFrame, interval_minutes: int, lateness: str = "10 minutes") -> DataFrame:
    """Bins (t - step, t] of canonical telemetry; rows later than the watermark are dropped.

    Windows of Spark close on the left, so times move back by a microsecond first.
    """
    shifted = telemetry.withColumn("shifted", F.expr("timestamp - INTERVAL 1 MICROSECOND")).withWatermark("shifted", lateness)
    counts = [name for name, m in METRICS.items() if m.kind == "interval_count"]
    value = finite(F.col("value"))
    binned = shifted.groupBy("entity_id", "metric_name", F.window("shifted", f"{interval_minutes} minutes").alias("bin")).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))
    chosen = F.when(F.col("metric_name").isin(counts), F.col("total")).otherwise(F.col("mean"))
    return binned.select(F.col("bin.end").alias("timestamp"), "entity_id", "metric_name", chosen.alias("value"))


class GridProcessor(StatefulProcessor):
    """Completed bins (t - step, t] of one series: a bin comes out when the watermark reaches its end, after the missing ones before it.

    State is the bins that are still open and the last one that came out; both are bounded
    by the lateness. Rows of bins that are out are dropped.
    """

    def __init__(self, step: int, counts: list[str]) -> None:
        self.step, self.counts = step, counts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "bin bigint")
        self.bins = handle.getMapState("bins", "bin bigint", "total double, n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        for frame in rows:
            us, value = frame["us"].astype("int64"), frame["value"].astype(float)
            ends = us + (-us) % self.step
            for end, own in value.groupby(ends):
                if last is not None and end <= last:
                    continue
                place = (int(end),)
                there = self.bins.containsKey(place)
                total, n = self.bins.getValue(place) if there else (0.0, 0)
                self.bins.updateValue(place, (total + float(own.sum()), n + int(own.notna().sum())))
                if not there:
                    self.handle.registerTimer(int(end) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for end, (total, n) in sorted((k[0], v) for k, v in self.bins.iterator()):
            if end > until:
                break
            out += [(at, None) for at in range(end if last is None else last + self.step, end, self.step)]
            out.append((end, None if not n else total if key[1] in self.counts else total / n))
            self.bins.removeKey((end,))
            last = end
        if out:
            self.last.update((last,))
            times, values = zip(*out, strict=True)
            values = pd.Series(values, dtype="float64")
            yield pd.DataFrame({"timestamp": pd.to_datetime(pd.Series(times), unit="us"), "entity_id": key[0], "metric_name": key[1], "value": values, "observed": values.notna()})

    def close(self) -> None:
        pass


def streaming_grid(telemetry: DataFrame, interval_minutes: int, lateness: str = "10 minutes") -> DataFrame:
    """The rows of ``resample`` from a stream of canonical telemetry, missing bins too; the interval must divide a day.

    A bin is complete when the watermark is at its end, as rows of the end itself are late then.
    """
    if interval_minutes <= 0 or 1440 % interval_minutes:
        raise ContractError("the interval must divide a day")
    counts = [name for name, m in METRICS.items() if m.kind == "interval_count"]
    value = finite(F.col("value")).alias("value")
    rows = telemetry.withWatermark("timestamp", lateness).select("timestamp", "entity_id", "metric_name", F.unix_micros("timestamp").alias("us"), value)
    return rows.groupBy("entity_id", "metric_name").transformWithStateInPandas(
        statefulProcessor=GridProcessor(interval_minutes * 60_000_000, counts),
        outputStructType="timestamp timestamp, entity_id string, metric_name string, value double, observed boolean",
        outputMode="Append", timeMode="EventTime",
    )


_STATE = "status boolean, high int, low int, previous bigint, last_valid bigint, start bigint, peak double, number int"


class IncidentProcessor(StatefulProcessor):
    """The incident rules over the rows of each batch; emits closures and a snapshot of what is open, to be upserted by incident_id.

    ``strict`` raises for rows at or before the last one seen; otherwise they are dropped.
    """

    def __init__(self, policy: Policy, strict: bool = False) -> None:
        self.policy, self.strict = policy, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entity = key[0]
        machine = Machine(self.policy, tuple(self.state.get()) if self.state.exists() else None)
        frame = pd.concat(list(rows)).sort_values("timestamp")
        times = frame["timestamp"].astype("datetime64[us, UTC]" if frame["timestamp"].dt.tz is not None else "datetime64[us]").astype("int64")
        events = []
        for at, score in zip(times.tolist(), frame["score"].tolist(), strict=True):
            if machine.previous is not None and at <= machine.previous:
                if self.strict:
                    raise ContractError("replayed or overlapping timestamps")
                continue
            events += machine.step(at, score)
        events += machine.active()
        self.state.update(machine.state())
        if events:
            at = lambda us: None if us is None else pd.Timestamp(us, unit="us")
            yield pd.DataFrame(
                [(f"{entity}-{n}", entity, at(start), at(end), peak, "OPEN" if why == "active" else "CLOSED", why) for n, start, end, peak, why in events],
                columns=[c.split()[0] for c in INCIDENT.split(", ")],
            )

    def close(self) -> None:
        pass


def streaming_incidents(scores: DataFrame, policy: Policy, strict: bool = False) -> DataFrame:
    """Incident updates of a stream of (entity_id, timestamp, score)."""
    return scores.select("entity_id", "timestamp", "score").groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=IncidentProcessor(policy, strict), outputStructType=INCIDENT, outputMode="Update", timeMode="None"
    )
