"""Healthy references: a daily harmonic and a robust scale for each entity and channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrelark.functions.columns import day_phase
from fibrelark.operators.selection import quantiles
from fibrelark.schema import ContractError
from fibrelark.sources.scratch import written

MAD_TO_SD = 1.4826
FLOOR, TEMPERATURE_FLOOR = 0.05, 0.1
DAY = 86_400_000_000


def _sums(y: Column, phase: Column) -> list[Column]:
    """Sufficient statistics of a regression on 1, sin and cos."""
    s, c = F.when(y.isNotNull(), F.sin(phase)), F.when(y.isNotNull(), F.cos(phase))
    named = {"n": F.count(y), "s": F.sum(s), "c": F.sum(c), "ss": F.sum(s * s), "cc": F.sum(c * c), "sc": F.sum(s * c), "y": F.sum(y), "ys": F.sum(y * s), "yc": F.sum(y * c)}
    return [column.cast("double").alias(f"t_{name}") for name, column in named.items()]


def _solved() -> tuple[Column, list[Column]]:
    """Determinant (scaled to 0..1) and coefficients of the 3 x 3 normal equations, by cofactors."""
    n, s, c, ss, cc, sc, y, ys, yc = (F.col(f"t_{k}") for k in ("n", "s", "c", "ss", "cc", "sc", "y", "ys", "yc"))
    a, b, d = ss * cc - sc * sc, c * sc - s * cc, s * sc - ss * c
    e, f, g = n * cc - c * c, s * c - n * sc, n * ss - s * s
    det = n * a + s * b + c * d
    scaled = F.try_divide(det, n * n * n)
    return scaled, [F.try_divide(a * y + b * ys + d * yc, det), F.try_divide(b * y + e * ys + f * yc, det), F.try_divide(d * y + f * ys + g * yc, det)]


def harmonic_fit(frame: DataFrame, keys: list[str], value: str, phase: Column) -> DataFrame:
    """keys, n, rank_ok, c0, c1, c2: least squares on 1, sin and cos of the phase, in one aggregate."""
    sums = frame.groupBy(*keys).agg(*_sums(F.col(value), phase))
    scaled, coefficients = _solved()
    ok = F.coalesce(scaled > 1e-9, F.lit(False))
    return sums.select(*keys, F.col("t_n").cast("long").alias("n"), ok.alias("rank_ok"), *[F.when(ok, c).alias(f"c{k}") for k, c in enumerate(coefficients)])


def residual(value: Column, phase: Column) -> Column:
    return (value - (F.col("c0") + F.col("c1") * F.sin(phase) + F.col("c2") * F.cos(phase))) / F.col("scale")


def fit_references(long: DataFrame, window: int, interval_minutes: int, seasonal: bool = True, strict: bool = False) -> DataFrame:
    """entity_id, channel, c0, c1, c2, scale from training rows (entity_id, channel, timestamp, raw).

    A series needs max(100, 3 * window) values and, if seasonal, two days of grid and
    three distinct phases. Series that have less are left out; ``strict`` raises instead.
    """
    keys = ["entity_id", "channel"]
    phase = day_phase(F.col("timestamp"))
    fitted = written(harmonic_fit(long, keys, "raw", phase), "fits")  # a row for each series
    largest = fitted.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    middle_of = lambda rows, value, name: quantiles(rows, keys, value, {name: 0.5}, largest=largest)
    us = F.unix_micros("timestamp")
    seen = long.groupBy(*keys).agg((F.max(us) - F.min(us) + F.lit(interval_minutes * 60_000_000)).alias("span"))
    enough = F.col("n") >= max(100, 3 * window)
    if seasonal:
        enough = enough & (F.col("span") >= 2 * DAY) & F.col("rank_ok")
    model = fitted.join(seen, keys).withColumn("enough", enough)
    if not seasonal:
        model = model.join(middle_of(long, "raw", "middle"), keys).withColumns({"c0": F.col("middle"), "c1": F.lit(0.0), "c2": F.lit(0.0)})
    if strict and (bad := model.filter(~F.col("enough")).select(*keys).limit(5).collect()):
        raise ContractError(f"too little training history: {[tuple(r) for r in bad]}")
    model = model.filter("enough").select(*keys, "c0", "c1", "c2")
    raw = long.join(model, keys).select(*keys, (F.col("raw") - (F.col("c0") + F.col("c1") * F.sin(phase) + F.col("c2") * F.cos(phase))).alias("r"))
    middle = middle_of(raw, "r", "m")
    spread = middle_of(raw.join(middle, keys).withColumn("apart", F.abs(F.col("r") - F.col("m"))), "apart", "mad")
    floor = F.when(F.col("channel").isin("ont_temperature", "olt_temperature"), TEMPERATURE_FLOOR).otherwise(FLOOR)
    return model.join(spread, keys).select(*keys, "c0", "c1", "c2", F.greatest(F.lit(MAD_TO_SD) * F.col("mad"), floor).alias("scale"))


def residuals(long: DataFrame, references: DataFrame) -> DataFrame:
    """Adds x, the scaled residual, and c0; series without a reference have NULL."""
    phase = day_phase(F.col("timestamp"))
    joined = long.join(references, ["entity_id", "channel"], "left")
    return joined.select("entity_id", "channel", "timestamp", "raw", residual(F.col("raw"), phase).alias("x"), "c0")
