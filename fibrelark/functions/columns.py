"""Column expressions: missing values, units, decibels, windows as arrays, error probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-15


def finite(value: Column) -> Column:
    """NULL for NaN and infinities; missing has this one form in the engine."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def milliwatt_to_dbm(value: Column, factor: float = 1.0) -> Column:
    """Decibels of a power; NULL unless it is positive. ``factor`` 1000 is for watts."""
    return F.when(value > 0, F.lit(10.0) * F.log10(value * F.lit(factor)))


def ratio_or_null(value: Column) -> Column:
    return F.when(value.between(0.0, 1.0), value)


def count_or_null(value: Column) -> Column:
    return F.when((value >= 0) & (value == F.floor(value)), value)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def day_phase(ts: Column) -> Column:
    """Angle of the UTC time of day."""
    us = F.pmod(F.unix_micros(ts), F.lit(86_400_000_000))
    return us.cast("double") * F.lit(2 * math.pi / 86_400_000_000)


def coefficient_of_variation(mean: Column, sd: Column) -> Column:
    """Population deviation over the absolute mean; NULL around a zero mean."""
    return F.when(F.abs(mean) > TINY, sd / F.abs(mean))


def lag_one(window: Column) -> Column:
    """Lag-one autocorrelation of an array, centred on its own mean; 0 if it does not vary."""
    n = F.size(window)
    total = F.aggregate(window, F.lit(0.0), lambda a, x: a + x)
    centred = F.transform(window, lambda x: x - total / n)

    def of(c: Column) -> Column:
        square = F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
        cross = F.aggregate(F.zip_with(F.slice(c, 1, n - 1), F.slice(c, 2, n - 1), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return F.when(square > TINY, cross / square).otherwise(F.lit(0.0))

    return F.element_at(F.transform(F.array(centred), of), 1)


ENTROPY_EDGES = (-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0)


def entropy(counts: list[Column], total: Column) -> Column:
    """Natural-log Shannon entropy of counts; empty classes add nothing."""
    parts = [F.when(c > 0, -(c / total) * F.ln(c / total)).otherwise(F.lit(0.0)) for c in counts]
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def entropy_class(x: Column) -> Column:
    """Class 0..7 of a residual between the edges; each class holds its lower edge."""
    out = F.lit(0)
    for edge in ENTROPY_EDGES:
        out = out + F.when(x >= edge, 1).otherwise(0)
    return out


# Reed-Solomon code of 255 bytes with 239 of data.
CODEWORD_BYTES = 255
CORRECTABLE = 8


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fec_probabilities(ber: Column) -> tuple[Column, Column]:
    """Probabilities that a codeword is corrected, and that it cannot be, for independent bit errors.

    Both are sums of binomial terms in log space, so small tails keep their digits.
    """
    symbol = -F.expm1(F.lit(8.0) * F.log1p(-ber))
    log_p = F.log(symbol)
    log_q = F.lit(8.0) * F.log1p(-ber)

    def mass(low: int, high: int) -> Column:
        terms = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(_log_choose(CODEWORD_BYTES, k)).alias("c")) for k in range(low, high + 1)])
        return F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.exp(t["c"] + t["k"] * log_p + (F.lit(float(CODEWORD_BYTES)) - t["k"]) * log_q))

    inside = (ber > 0) & (ber < 1)
    corrected = F.when(inside, F.least(F.lit(1.0), mass(1, CORRECTABLE))).when(ber.isin(0.0, 1.0), F.lit(0.0))
    lost = F.when(inside, F.least(F.lit(1.0), mass(CORRECTABLE + 1, CODEWORD_BYTES))).when(ber == 0, F.lit(0.0)).when(ber == 1, F.lit(1.0))
    return corrected, lost
