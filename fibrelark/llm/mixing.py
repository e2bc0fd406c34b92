"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source. A source's target is
whole passes over the source plus a remaining budget, which a bounded-knapsack dynamic
programme fits over the length counts. Budgets up to FITTED words (and those that leave
out no more than that) go to the programme whole, so the sum nearest to the budget is
found; of larger budgets a proportional part of each length is taken before and the
programme fits the last FITTED words or more. The plan says how many documents of each
length are taken once more; which ones is decided by a seeded order of the documents.

The order is resolved without bringing a length's documents together: the plan is
compared with counts by hash bucket, and ranks are taken within a bucket. Sources may
be many: their ranks, targets and budgets are tables.

Defined results: null text has size 0 and is taken 0 words; very long texts are one
document each; a null source is a source of its own, ordered last; a null doc_id is
allowed; repeated rows are documents each (of rows equal in id and text any may be the
ones taken); an empty table gives an empty result; other columns are kept by
``mixed_documents`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.llm.common import Scratch, batches, bytes_column

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
BUCKETS = 1024
# Words that the dynamic programme fits at least: a parameter that bounds its time and memory
# (with the longest document). Larger values make sums of few, long lengths nearer.
FITTED = 1 << 18


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words to take from each source: the total by weight, at most ``most`` times a source, the excess reshared."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in set(over)]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come nearest to the budget.

    ``lengths`` are distinct and positive. Never takes more of a length than there are.
    """
    total = int((lengths * counts).sum())
    budget = max(0, min(int(budget), total))
    if 2 * budget > total:  # what is left out is the smaller sum
        return counts.astype(np.int64) - fit(lengths, counts, total - budget)
    take = np.zeros(len(lengths), np.int64)
    if budget > FITTED:
        before = budget - FITTED
        take[:] = [int(c) * before // total for c in counts]  # whole numbers: exact at any size
        over = before - int((take * lengths).sum())
        for k in np.argsort(-lengths, kind="stable"):  # what rounding left, by the longest that fit
            more = min(int(counts[k] - take[k]), over // int(lengths[k]))
            take[k] += more
            over -= more * int(lengths[k])
        budget = FITTED + over
    return take + _knapsack(lengths, counts - take, budget)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack over sums up to one document beyond the budget; the nearest reachable sum is taken apart."""
    out = np.zeros(len(lengths), np.int64)
    usable = np.flatnonzero(counts > 0)
    if not len(usable) or not budget:
        return out
    # Short of the budget any document left over brings the sum to less than its length beyond.
    room = budget + int(lengths[usable].max())
    # Each length in parts of 1, 2, 4, ... documents, so that every number of them is a sum of parts.
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by_part = np.full(room + 1, -1, np.int32)
    parts: list[tuple[int, int, int]] = []  # length, how many at once, their words
    for k in usable[np.argsort(-lengths[usable], kind="stable")]:
        left, size = min(int(counts[k]), room // int(lengths[k])), 1
        while left > 0 and not reached[budget]:
            n = min(size, left)
            words = n * int(lengths[k])
            fresh = reached[: room + 1 - words] & ~reached[words:]
            by_part[words:][fresh] = len(parts)
            reached[words:] |= fresh
            parts.append((int(k), n, words))
            left -= n
            size *= 2
    sums = np.flatnonzero(reached)
    best = int(sums[np.argmin(np.abs(sums - budget))])
    while best:
        k, n, words = parts[by_part[best]]
        out[k] += n
        best -= words
    return out


def _sizes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(parts):
        sizes = pa.array([len(t.split()) for t in bytes_column(batch, "text")], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], sizes], names=["row_id", "doc_id", "source", "order_key", "size"])


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target and passes from a table of source and source_size; what targets() gives, for any number of sources.

    Sources are ranked by a sort over partitions, whose counts come to the driver. In each
    round those whose share of what is left is beyond their bound are settled, until none is.
    """
    rows = scratch.write(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftrightunsigned("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranks, before = [F.lit(0).cast("long")], 0
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        ranks.append(F.when(part == r["part"], F.lit(before).cast("long")).otherwise(F.lit(0).cast("long")))
        before += r["count"]
    rank = reduce(Column.__add__, ranks) + place
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int") + 1)
    rows = scratch.write(rows.select("source", "source_size", weight.alias("weight")), "weights")
    bound = F.lit(most) * F.col("source_size")
    total = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    left, whole, settled = total, None, None
    while True:
        share = F.lit(left) * F.col("weight") / F.lit(whole) if whole else F.lit(0.0)
        over = share > bound
        # Shares only grow from round to round, so those settled before are settled now.
        now = rows.agg(F.count_if(over).alias("n"), F.sum(F.when(over, bound)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("whole")).first()
        if now["n"] == settled or not now["whole"]:
            break
        settled, left, whole = now["n"], total - (now["taken"] or 0.0), now["whole"]
    target = F.when(over, bound).otherwise(share)
    out = rows.select("source", "source_size", target.cast("double").alias("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return scratch.write(out.withColumn("passes", passes), "targets")


def plan_mix(spark: SparkSession, docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """row_id, doc_id, source, size, source_size, target, copies for every row of ``docs``.

    ``docs`` has row_id, doc_id, source and text. The narrow table of sizes is
    written to the shared folder once; everything after reads that.
    """
    scratch = Scratch(spark, "mixing")
    doc_id = F.col("doc_id").cast("long")
    # The order follows from seed, doc_id and text, so it is the same however the table is read.
    key = F.xxhash64(F.lit(seed), doc_id, F.col("text")).alias("order_key")
    narrow = docs.select("row_id", doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), key, "text")
    sized = scratch.write(narrow.mapInArrow(_sizes, "row_id long, doc_id long, source string, order_key long, size long"), "sizes")
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("order_key"), F.lit(BUCKETS)).cast("int"))
    buckets = scratch.write(sized.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    lengths = buckets.groupBy("source", "size").agg(F.sum("n").alias("n"))
    catalogue = source_targets(scratch, lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights)

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        budget = round(float(frame["target"].iloc[0]) - int(frame["passes"].iloc[0]) * int(frame["source_size"].iloc[0]))
        frame = frame[frame["size"] > 0].sort_values("size")
        take = fit(frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), budget)
        return pd.DataFrame({"source": frame["source"], "size": frame["size"], "take": take})

    # Rows of a group: the distinct lengths of one source, whatever its number of documents.
    budgeted = lengths.alias("l").join(catalogue.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source"))).select("l.*", "s.source_size", "s.target", "s.passes")
    taken = scratch.write(budgeted.groupBy("source").applyInPandas(fitted, "source string, size long, take long").filter("take > 0"), "taken")
    # Documents before a bucket, in the seeded order of the source's documents of that length.
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    at = buckets.withColumn("before", F.coalesce(before, F.lit(0)))
    per_bucket = (
        at.alias("b")
        .join(taken.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("b.size") == F.col("t.size")))
        .select(
            F.col("b.source").alias("source"),
            F.col("b.size").alias("size"),
            F.col("b.bucket").alias("bucket"),
            F.least(F.col("b.n"), F.greatest(F.lit(0), F.col("t.take") - F.col("b.before"))).alias("quota"),
        )
        .filter("quota > 0")
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order_key", "row_id"))
    ranked = sized.withColumn("rank", rank)
    chosen = (
        ranked.alias("d")
        .join(
            per_bucket.alias("q"),
            F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.size") == F.col("q.size")) & (F.col("d.bucket") == F.col("q.bucket")),
            "left",
        )
        .select("d.row_id", "d.doc_id", "d.source", "d.size", (F.col("d.rank") <= F.coalesce(F.col("q.quota"), F.lit(0))).cast("long").alias("extra"))
    )
    return (
        chosen.alias("c")
        .join(catalogue.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        .select("c.row_id", "c.doc_id", "c.source", "c.size", "s.source_size", "s.target", F.when(F.col("c.size") > 0, F.col("s.passes") + F.col("c.extra")).otherwise(F.lit(0)).alias("copies"))
    )


def mix(spark: SparkSession, docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for every document."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", "text")
    return plan_mix(spark, numbered, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(spark: SparkSession, docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``copies``, how often each is taken.

    Where ``docs`` has a column of that name the new one is ``mix_copies``. Rows are
    numbered in a written table, so a number means the same row in every pass.
    """
    named = "copies" if "copies" not in docs.columns else "mix_copies"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row_id"))
    numbered = Scratch(spark, "mix-rows").write(packed, "rows")
    plan = plan_mix(spark, numbered.select("row_id", "doc.doc_id", "doc.source", "doc.text"), seed)
    plan = plan.filter("copies > 0").select(F.col("row_id").alias("__row"), F.col("copies").alias("__copies"))
    return numbered.join(plan, F.col("row_id") == F.col("__row")).select("doc.*", F.col("__copies").alias(named))
