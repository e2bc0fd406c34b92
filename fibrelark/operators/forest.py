"""Isolation forest: trees over a seeded sample, built side by side, scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibrelark.schema import ContractError

TREES, SUBSAMPLE, MOST_ROWS, LEAST_ROWS = 100, 256, 20_000, 100
EULER = 0.5772156649015329
TREE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, depth_left double"


def average_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def complete_rows(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every column is a finite number."""
    holds = F.lit(True)
    for c in columns:
        holds = holds & F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return frame.filter(holds)


def seeded_sample(frame: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows in the order of a hash of their keys: the same for every partitioning."""
    order = F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in keys])
    return frame.orderBy(order, *keys).limit(n)


def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One tree as (node, feature, split, left, right, path length added at a leaf)."""
    out: list[tuple] = []
    work = [(0, rows, 0)]
    made = 1
    while work:
        node, own, depth = work.pop()
        spread = np.flatnonzero(own.max(axis=0) > own.min(axis=0)) if len(own) > 1 and depth < limit else []
        if not len(spread):
            out.append((node, -1, 0.0, -1, -1, depth + average_path(len(own))))
            continue
        feature = int(rng.choice(spread))
        low, high = own[:, feature].min(), own[:, feature].max()
        split = float(rng.uniform(low, high))
        below = own[:, feature] <= split
        if below.all():
            split = float(np.nextafter(high, low))
            below = own[:, feature] <= split
        out.append((node, feature, split, made, made + 1, 0.0))
        work += [(made, own[below], depth + 1), (made + 1, own[~below], depth + 1)]
        made += 2
    return out


@dataclass
class IsolationForest:
    """Fitted trees as arrays; at most TREES * (2 * SUBSAMPLE - 1) nodes, so they can be broadcast."""

    columns: list[str]
    subsample: int
    trees: list[tuple[np.ndarray, ...]]

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean depth / expected depth): near 1 for rows that are soon alone."""
        depth = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, split, left, right, leaf in self.trees:
            node = np.zeros(len(rows), np.int64)
            inner = feature[node] >= 0
            while inner.any():
                goes = rows[at, np.maximum(feature[node], 0)] <= split[node]
                node = np.where(inner, np.where(goes, left[node], right[node]), node)
                inner = feature[node] >= 0
            depth += leaf[node]
        return 2.0 ** (-depth / len(self.trees) / max(average_path(self.subsample), 1e-12))

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (t, n, int(f), float(s), int(a), int(b), float(d))
            for t, tree in enumerate(self.trees)
            for n, (f, s, a, b, d) in enumerate(zip(*tree, strict=True))
        ]
        return spark.createDataFrame(rows, TREE_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame, columns: list[str], subsample: int) -> IsolationForest:
        frame = table.toPandas().sort_values(["tree", "node"])
        kinds = {"feature": np.int64, "split": float, "left": np.int64, "right": np.int64, "depth_left": float}
        trees = [tuple(group[c].to_numpy(k) for c, k in kinds.items()) for _, group in frame.groupby("tree", sort=True)]
        return cls(columns, subsample, trees)


def fit_forest(features: DataFrame, columns: list[str], seed: int = 42, keys: tuple[str, ...] = ("entity_id", "timestamp"), trees: int = TREES) -> IsolationForest:
    """Fits on a seeded sample of at most MOST_ROWS complete rows; the trees are grown in parallel from it."""
    spark = features.sparkSession
    sample = seeded_sample(complete_rows(features.select(*keys, *columns), columns), list(keys), MOST_ROWS, seed)
    rows = sample.select(*columns).toPandas().to_numpy(float)
    if len(rows) < LEAST_ROWS:
        raise ContractError(f"only {len(rows)} complete training rows")
    subsample = min(SUBSAMPLE, len(rows))
    shared = spark.sparkContext.broadcast(rows)
    limit = math.ceil(math.log2(max(subsample, 2)))

    def grow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for tree in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, tree])
                picked = shared.value[rng.choice(len(shared.value), subsample, replace=False)]
                columns_ = zip(*[(tree, *node) for node in _grow(picked, rng, limit)], strict=True)
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, kinds, strict=True)], names=[x.split()[0] for x in TREE_SCHEMA.split(", ")])

    grown = spark.range(trees, numPartitions=min(trees, spark.sparkContext.defaultParallelism)).mapInArrow(grow, TREE_SCHEMA)
    return IsolationForest.from_table(grown, columns, subsample)


def forest_scores(features: DataFrame, forest: IsolationForest, name: str = "raw") -> DataFrame:
    """Adds the raw score; NULL where a feature is missing."""
    shared = features.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        rows = np.stack([c.to_numpy(float) for c in columns], axis=1)
        there = np.isfinite(rows).all(axis=1)
        out = np.full(len(rows), np.nan)
        if there.any():
            out[there] = shared.value.raw(rows[there])
        return pd.Series(out, index=columns[0].index).astype(object).where(there, None)

    scored = features.withColumn(name, score(*[F.col(c) for c in forest.columns]))
    return scored.withColumn(name, F.when(~F.isnan(name), F.col(name)))
