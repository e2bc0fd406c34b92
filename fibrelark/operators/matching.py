"""One-to-one matching of alerts and faults, as many pairs as possible."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.schema import ContractError


# The finest cells of the interval index, in microseconds; each level's cells are twice as long.
UNIT = 3_600_000_000


def _cell(time: str) -> Column:
    return F.expr(f"unix_micros(`{time}`) div shiftleft({UNIT}L, __level)")


def with_cells(spans: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each cell that a span touches, with ``__level`` and ``__cell``: three at most, however long it is.

    A span's level is the finest one with cells of half its length or more.
    """
    length = F.unix_micros(F.greatest(start, end)) - F.unix_micros(start)
    level = F.ceil(F.log2(F.greatest(length, F.lit(UNIT)) / F.lit(2.0 * UNIT))).cast("int")
    placed = spans.withColumn("__level", F.greatest(F.lit(0), level)).withColumn("__last", F.greatest(start, end))
    return placed.withColumn("__cell", F.explode(F.sequence(_cell(start), _cell("__last")))).drop("__last")


def meet(points: DataFrame, entity: str, time: str, spans: DataFrame, of: str, start: str, end: str, closed: bool = False) -> DataFrame:
    """Pairs of a point and a span of its entity with start <= time < end (<= end if ``closed``); column names must differ.

    Points probe one cell of each level that the spans use; these are few, and found while
    the plan is built.
    """
    placed = with_cells(spans, start, end)
    levels = sorted(r[0] for r in placed.select("__level").distinct().collect())
    probes = points.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("__cell", _cell(time))
    probes = probes.withColumnsRenamed({"__level": "__at_level", "__cell": "__at_cell"})
    same = (F.col(entity) == F.col(of)) & (F.col("__at_level") == F.col("__level")) & (F.col("__at_cell") == F.col("__cell"))
    before = F.col(time) <= F.col(end) if closed else F.col(time) < F.col(end)
    return probes.join(placed, same & (F.col(start) <= F.col(time)) & before).drop("__level", "__cell", "__at_level", "__at_cell")


def eligible(alerts: DataFrame, faults: DataFrame, *more: str) -> DataFrame:
    """Pairs of an alert and a fault of its entity that holds the alert's start: onset <= start < end."""
    named = ["entity_id", "incident_id", "start_time", "fault_id", "onset_time", "end_time"]
    spans = faults.select(F.col("entity_id").alias("__of"), "fault_id", "onset_time", "end_time", *more)
    return meet(alerts.select(*named[:3]), "entity_id", "start_time", spans, "__of", "onset_time", "end_time").select(*named, *more)


def with_islands(faults: DataFrame) -> DataFrame:
    """Adds ``island``: faults of an entity are in one if their spans are connected by overlaps."""
    order = Window.partitionBy("entity_id").orderBy("onset_time", "end_time", "fault_id")
    reach = F.max("end_time").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("onset_time") >= reach, F.lit(True)).cast("long")
    return faults.withColumn("__apart", apart).withColumn("island", F.sum("__apart").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__apart")


def _pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Augmenting paths within one island, without recursion.

    Alerts come by (start, id); an alert tries its faults by (end, onset, id).
    """
    frame = frame.sort_values(["start_time", "incident_id", "end_time", "onset_time", "fault_id"])
    options = {alert: group["fault_id"].tolist() for alert, group in frame.groupby("incident_id", sort=False)}
    holder: dict[str, str] = {}
    for alert in options:
        tried: set[str] = set()
        # Depth-first: each level is an alert with its faults left to try; ``via`` is the fault tried there.
        path = [(alert, iter(options[alert]))]
        via: list[str] = []
        while path:
            step = next((x for x in path[-1][1] if x not in tried), None)
            if step is None:
                path.pop()
                if via:
                    via.pop()
                continue
            tried.add(step)
            via.append(step)
            if step not in holder:
                for (owner, _), fault in zip(path, via, strict=True):
                    holder[fault] = owner
                break
            path.append((holder[step], iter(options[holder[step]])))
    rows = [(frame["entity_id"].iloc[0], fault, owner) for fault, owner in holder.items()]
    return pd.DataFrame(rows, columns=["entity_id", "fault_id", "incident_id"])


def match_events(alerts: DataFrame, faults: DataFrame, check: bool = True) -> DataFrame:
    """entity_id, fault_id, incident_id: a matching of greatest size.

    An alert lies in faults of one island only, so islands of overlapping faults are solved alone.
    """
    if check:
        for table, key in ((alerts, "incident_id"), (faults, "fault_id")):
            n = table.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d")).first()
            if n["n"] != n["d"]:
                raise ContractError(f"missing or repeated {key}")
    pairs = eligible(alerts, with_islands(faults), "island")
    return pairs.groupBy("entity_id", "island").applyInPandas(_pairs, "entity_id string, fault_id string, incident_id string")
