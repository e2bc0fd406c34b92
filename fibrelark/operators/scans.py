"""Running values along a series that may be too long for one task.

A series is cut into blocks of time. Windows run inside a block only, each block is summed up by
one row, and what the blocks before hold is carried in by a join on series and block. All the
running values here are associative (sums, extremes, the last value), so a block's row is enough;
rows of a restarting kind carry their restart's number in front, as in ``lower_cusum``. Blocks
are summed up again by ``FAN``, so that no step has more rows of a series in one task than a
block, or ``FAN`` blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from fibrelark.sources.scratch import written

FAN = 256
DAY = 86_400_000_000


def _over(kind: str, value: Column, window: WindowSpec) -> Column:
    upto, before = (window.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    if kind == "lag":
        return F.lag(value).over(window)
    if kind == "before":
        return F.last(value, ignorenulls=True).over(before)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(upto)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(upto)


def _total(kind: str, value: Column, at: Column) -> Column:
    """One row for many of them; for the kinds of a last value, the one at the latest place."""
    if kind in ("lag", "before", "last"):
        return F.max_by(value, F.when(value.isNotNull(), at))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _joined(kind: str, earlier: Column, later: Column) -> Column:
    if kind in ("lag", "before", "last"):
        return F.coalesce(later, earlier)
    if kind == "sum":
        return F.coalesce(earlier + later, earlier, later)
    return F.greatest(earlier, later) if kind == "max" else F.least(earlier, later)


def _extreme(kind: str, earlier: Column, later: Column) -> Column:
    """greatest() and least() do not order structs of unlike names, so extremes of structs compare as they are."""
    better = later > earlier if kind == "max" else later < earlier
    return F.when(earlier.isNull() | better, later).otherwise(earlier)


def _before_blocks(totals: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """keys, __block and the value of all blocks before each one."""
    wide = totals.withColumn("__wide", F.floor(F.col("__block") / FAN))
    inner = Window.partitionBy(*keys, "__wide").orderBy("__block")
    exclusive = inner.rowsBetween(Window.unboundedPreceding, -1)

    def prior(kind: str, c: str) -> Column:
        if kind in ("lag", "before", "last"):
            return F.last(c, ignorenulls=True).over(exclusive)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](c).over(exclusive)

    near = wide.select(*keys, "__block", "__wide", *[prior(kind, c).alias(c) for c, kind in kinds.items()])
    tops = wide.groupBy(*keys, "__wide").agg(*[_total(kind, F.col(c), F.col("__block")).alias(c) for c, kind in kinds.items()])
    a, b = tops.select(*keys, "__wide").alias("a"), tops.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    # A series has few rows here: one for each FAN blocks.
    pairs = a.join(b, [*same, F.col("b.__wide") < F.col("a.__wide")])
    far = pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.__wide").alias("__wide"))
    far = far.agg(*[_total(kind, F.col(f"b.{c}"), F.col("b.__wide")).alias(f"{c}_far") for c, kind in kinds.items()])
    met = near.join(far, [*keys, "__wide"], "left")
    return met.select(*keys, "__block", *[_merged(kind, F.col(f"{c}_far"), F.col(c), near.schema[c].dataType).alias(f"{c}_carry") for c, kind in kinds.items()])


def _merged(kind: str, earlier: Column, later: Column, of: T.DataType) -> Column:
    if kind in ("max", "min") and isinstance(of, T.StructType):
        return F.when(later.isNull(), earlier).otherwise(_extreme(kind, earlier, later))
    return _joined(kind, earlier, later)


def running(frame: DataFrame, keys: list[str], columns: dict[str, tuple[str, Column]], block: int | None = None, time: str = "timestamp") -> DataFrame:
    """Adds running values: name to (kind, column), for each row over its series in the order of time.

    Kinds: sum, max, min and last (present value) up to the row; before, the last present
    value of the rows before; lag, the row before, present or not. ``block`` is the length
    of a block in microseconds; without it each series is one window. Keys must be present,
    times distinct within a series. In blocks the rows are written to the shared folder once
    for each call, while the plan is built.
    """
    if block is None:
        order = Window.partitionBy(*keys).orderBy(time)
        return frame.withColumns({name: _over(kind, column, order) for name, (kind, column) in columns.items()})
    us = F.unix_micros(time) if isinstance(frame.schema[time].dataType, T.TimestampType) else F.col(time)
    fed = {f"__{name}": F.struct(column.alias("v")) if kind == "lag" else column for name, (kind, column) in columns.items()}
    kinds = {f"__{name}": kind for name, (kind, _) in columns.items()}
    # Read twice, for the totals and for the rows: a written table keeps a chain of scans from doubling at each step.
    work = written(frame.withColumns(fed | {"__block": F.floor(us / F.lit(block)).cast("long")}), "scan")
    order = Window.partitionBy(*keys, "__block").orderBy(time)
    totals = work.groupBy(*keys, "__block").agg(*[_total(kind, F.col(c), F.col(time)).alias(c) for c, kind in kinds.items()])
    carry = _before_blocks(written(totals, "blocks"), keys, kinds)
    local = work.withColumns({f"{c}_local": _over(kind, F.col(c), order) for c, kind in kinds.items()})
    met = local.join(carry, [*keys, "__block"], "left")
    out = {}
    for name, (kind, _) in columns.items():
        value = _merged(kind, F.col(f"__{name}_carry"), F.col(f"__{name}_local"), work.schema[f"__{name}"].dataType)
        out[name] = value["v"] if kind == "lag" else value
    return met.select(*[c for c in frame.columns if c not in out], *[value.alias(name) for name, value in out.items()])


def lower_cusum(frame: DataFrame, keys: list[str], value: str, first_pos: int, allowance: float, name: str = "cusum", block: int | None = None, time: str = "timestamp") -> DataFrame:
    """Adds the lower CUSUM of each segment from row ``first_pos`` on: max(0, before - value - allowance).

    ``frame`` has segment and pos. The sum of falls runs over the whole series; the least sum
    of a segment is the extreme of (segment, sum), as segments only grow along a series.
    """
    counts = F.col(value).isNotNull() & (F.col("pos") >= first_pos)
    fall = F.when(counts, -F.col(value) - F.lit(allowance))
    work = running(frame.withColumn("__fall", fall), keys, {"__sum": ("sum", F.col("__fall"))}, block, time)
    # The first row of a segment may also be measured from the sum before it.
    lowest = F.when(F.col("pos") == first_pos, F.least(F.col("__sum"), F.col("__sum") - F.col("__fall"))).otherwise(F.col("__sum"))
    work = running(work, keys, {"__least": ("max", F.when(counts, F.struct("segment", (-lowest).alias("depth"))))}, block, time)
    return work.withColumn(name, F.when(counts, F.col("__sum") + F.col("__least.depth"))).drop("__fall", "__sum", "__least")
