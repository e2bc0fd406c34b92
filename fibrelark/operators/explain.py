"""Permutation Shapley values of the forest's raw score against a background sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibrelark.operators.forest import IsolationForest
from fibrelark.schema import ContractError


def shapley(score, background: np.ndarray, row: np.ndarray, permutations: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:  # noqa: ANN001
    """Mean marginal contributions over random orders and their reverses; they add up to score(row) - base exactly."""
    width = len(row)
    total = np.zeros(width)
    base = float(score(background).mean())
    for _ in range(permutations):
        order = rng.permutation(width)
        for path in (order, order[::-1]):
            # One batch: the background with the first k features of the path taken from the row.
            steps = np.repeat(background[None], width + 1, axis=0)
            for k, f in enumerate(path):
                steps[k + 1 :, :, f] = row[f]
            means = score(steps.reshape(-1, width)).reshape(width + 1, -1).mean(axis=1)
            total[path] += np.diff(means)
    return total / (2 * permutations), base


def explain_scores(forest: IsolationForest, background: DataFrame, observations: DataFrame, permutations: int = 2, seed: int = 42) -> DataFrame:
    """entity_id, timestamp, raw_anomaly_score, background_score, reconstructed_score and a contribution for each feature.

    The background is a small sample (16 rows by default) and is broadcast; rows are explained side by side.
    """
    columns = forest.columns
    rows = background.select(*columns).toPandas().to_numpy(float)
    if permutations < 1 or not len(rows):
        raise ContractError("need background rows and one permutation or more")
    if not np.isfinite(rows).all():
        raise ContractError("the background has missing features")
    shared = observations.sparkSession.sparkContext.broadcast((forest, rows))
    schema = "entity_id string, timestamp timestamp, raw_anomaly_score double, background_score double, reconstructed_score double, " + ", ".join(f"`{c}` double" for c in columns)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = shared.value
        for part in parts:
            out = []
            for entity, time, *values in part[["entity_id", "timestamp", *columns]].itertuples(index=False):
                row = np.array(values, float)
                if not np.isfinite(row).all():
                    raise ContractError("an observation has missing features")
                values, base = shapley(model.raw, known, row, permutations, np.random.default_rng([seed]))
                said = float(model.raw(row[None])[0])
                if not np.isclose(base + values.sum(), said, atol=1e-7, rtol=1e-6):
                    raise ArithmeticError("contributions do not add up")
                out.append((entity, time, said, base, base + values.sum(), *values))
            yield pd.DataFrame(out, columns=["entity_id", "timestamp", "raw_anomaly_score", "background_score", "reconstructed_score", *columns])

    spread = observations.select("entity_id", "timestamp", *columns).repartition(observations.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, schema)


def importance(explained: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean_abs and mean_signed contribution, greatest first."""
    long = explained.select(*columns).unpivot([], columns, "feature", "v")
    return long.groupBy("feature").agg(F.avg(F.abs("v")).alias("mean_abs"), F.avg("v").alias("mean_signed")).orderBy(F.desc("mean_abs"), "feature")


def top_rows(scores: DataFrame, score: str, k: int = 8) -> DataFrame:
    """The k rows with the greatest score; ties by entity and time."""
    return scores.orderBy(F.desc_nulls_last(score), "entity_id", "timestamp").limit(k)
