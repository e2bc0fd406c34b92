"""Exact percentiles and ranks of groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.sources.scratch import written

# Values of a group that one task may sort; beyond it they are narrowed first.
LIMIT = 1_000_000
# Parts into which a round cuts what is left of a group.
GRID = 256


def _met(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the rows of their group in ``state``; keys may be null."""
    other = state.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return values.join(other, same).drop(*[f"__{k}" for k in keys])


def _inside(low: Column, high: Column) -> Column:
    """Strictly between two bounds; a missing one bounds nothing."""
    v = F.col("__v")
    return F.coalesce(v > low, F.lit(True)) & F.coalesce(v < high, F.lit(True))


def quantiles(frame: DataFrame, keys: list[str], value: str, shares: dict[str, float], limit: int = LIMIT, largest: int | None = None) -> DataFrame:
    """keys and a column for each share: exact percentiles with linear interpolation, for all groups at once.

    Groups of up to ``limit`` values are sorted by their tasks. In larger ones each wanted
    rank is narrowed: a mergeable sketch of the values between two bounds gives nearer
    bounds, counts against these say where the rank lies, until ``limit`` values or one
    are left. The counts are exact, so the sketch decides the number of rounds only.
    ``largest``, a bound of the group sizes, saves counting them. Missing values are
    ignored; a group without values has NULL.
    """
    values = frame.select(*keys, F.col(value).cast("double").alias("__v"))
    plain = lambda some: some.groupBy(*keys).agg(*[F.percentile("__v", p).alias(name) for name, p in shares.items()])
    if largest is not None and largest <= limit:
        return plain(values)
    sizes = written(values.groupBy(*keys).agg(F.count("__v").alias("__n")), "sizes")
    if not sizes.filter(F.col("__n") > limit).limit(1).count():
        return plain(values)
    small = _met(values, sizes.filter(F.col("__n") <= limit), keys).drop("__n")
    named = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("__n") - 1)).alias("place")) for name, p in shares.items()])
    wanted = sizes.filter(F.col("__n") > limit).select(*keys, "__n", F.explode(named).alias("w")).select(*keys, "__n", "w.*")
    sides = F.array(*[F.struct(F.lit(k).alias("side"), f("place").cast("long").alias("rank")) for k, f in enumerate((F.floor, F.ceil))])
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    state = wanted.select(*keys, "name", (F.col("place") - F.floor("place")).alias("part"), "__n", F.explode(sides).alias("s")).select(
        *keys, "name", "part", "s.*", none.alias("low"), none.alias("high"), zero.alias("below"), zero.alias("at_low"), F.col("__n").alias("open"), zero.alias("at_high")
    )
    state = written(state, "ranks")
    values = values.filter(F.col("__v").isNotNull())
    columns = state.columns
    target = [*keys, "name", "side"]
    base = F.col("below") + F.col("at_low")
    # The rank is one of the open values, rather than a bound.
    hidden = (F.col("rank") >= base) & (F.col("rank") < base + F.col("open"))
    while True:
        wide = state.filter(hidden & (F.col("open") > limit))
        if not wide.limit(1).count():
            break
        grid = [k / GRID for k in range(1, GRID)]
        cuts = _met(values, wide, keys).filter(_inside(F.col("low"), F.col("high"))).groupBy(*columns).agg(F.percentile_approx("__v", grid, 10 * GRID).alias("cuts"))
        at = F.floor((F.col("rank") - base) / F.col("open") * GRID).cast("int")  # the cut below has this number, from 1
        cut = lambda k: F.when((k >= 1) & (k < GRID), F.get("cuts", k - 1))
        nearer = written(cuts.select(*columns, cut(at - 1).alias("a"), cut(at + 2).alias("b")), "bounds")
        v, a, b = F.col("__v"), F.col("a"), F.col("b")
        counted = _met(values, nearer, keys).filter(_inside(F.col("low"), F.col("high"))).groupBy(*columns, "a", "b")
        counted = counted.agg(F.count_if(v < a).alias("c1"), F.count_if(v == a).alias("c2"), F.count_if(_inside(a, b)).alias("c3"), F.count_if((v == b) & F.coalesce(a < b, F.lit(True))).alias("c4"))
        before, rank = F.col("c1"), F.col("rank") - base
        until = before + F.col("c2") + F.col("c3") + F.col("c4")
        left, right = rank < before, rank >= until
        pick = lambda x, y, z: F.when(left, x).when(right, z).otherwise(y)
        # Below a, from a to b, or above b; a missing one keeps the bound of before.
        moved = {
            "low": pick(F.col("low"), F.coalesce(a, "low"), b),
            "high": pick(a, F.coalesce(b, "high"), F.col("high")),
            "below": pick(F.col("below"), F.when(a.isNull(), F.col("below")).otherwise(base + before), base + before + F.col("c2") + F.col("c3")),
            "at_low": pick(F.col("at_low"), F.when(a.isNull(), F.col("at_low")).otherwise(F.col("c2")), F.col("c4")),
            "open": pick(before, F.col("c3"), F.col("open") - until),
            "at_high": pick(F.col("c2"), F.when(b.isNull(), F.col("at_high")).otherwise(F.col("c4")), F.col("at_high")),
        }
        # Where both bounds are one value, it is a and c4 counts nothing: the values above it are bounded by it too.
        moved["at_low"] = F.when(right & (a == b), F.col("c2")).otherwise(moved["at_low"])
        moved["below"] = F.when(right & (a == b), base + before).otherwise(moved["below"])
        narrowed = counted.select(*[moved.get(c, F.col(c)).alias(c) for c in columns])
        state = written(state.filter(~(hidden & (F.col("open") > limit))).unionByName(narrowed), "ranks")
    last = F.element_at(F.sort_array(F.collect_list("__v")), (F.first("rank") - F.first(base)).cast("int") + 1)
    sorted_ = _met(values, state.filter(hidden), keys).filter(_inside(F.col("low"), F.col("high"))).groupBy(*target, "part").agg(last.alias("value"))
    bound = F.when(F.col("rank") < base, F.col("low")).otherwise(F.col("high"))
    found = state.filter(~hidden).select(*target, "part", bound.alias("value")).unionByName(sorted_)
    of = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("value")))
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("part")))
    large = found.groupBy(*keys).agg(*[(of(n, 0) * (1 - part(n)) + of(n, 1) * part(n)).alias(n) for n in shares])
    return plain(small).unionByName(large)


def average_ranks(frame: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Adds the rank within keys, ties on average; a missing value has none.

    Equal values are counted first, so a tie of any size is one row. Distinct values are
    dealt into ranges of their group; a range begins at the count of the ranges before,
    of which a group has GRID at most.
    """
    distinct = frame.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    cuts = distinct.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), [k / GRID for k in range(1, GRID)], 10 * GRID).alias("__cuts"))
    v = F.col(value).cast("double")
    dealt = _met(distinct, cuts, keys).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < v))).drop("__cuts")
    sums = dealt.groupBy(*keys, "__range").agg(F.sum("__n").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*keys, F.col("__range").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = _met(dealt.withColumn("__upto", upto), offsets, keys).filter("__range = __of")
    ranks = placed.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("__value"), (F.col("__before") + F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    same = F.col(value) == F.col("__value")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return frame.join(ranks, same, "left").drop("__value", *[f"__{k}" for k in keys])
