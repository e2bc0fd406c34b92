"""Least squares from sufficient statistics, and guarded correlations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrelark.operators.selection import average_ranks


def least_squares(frame: DataFrame, keys: list[str], y: str, terms: list[Column]) -> DataFrame:
    """keys, n and beta (an array): regression of y on the terms, minimum-norm where they depend on each other.

    One aggregate per group gives the moments; only those, a row per group, reach Python.
    """
    m = len(terms)
    rows = frame.filter(F.col(y).isNotNull())
    moments = [F.sum(terms[i] * terms[j]).alias(f"m{i}_{j}") for i in range(m) for j in range(i, m)] + [F.sum(terms[i] * F.col(y)).alias(f"y{i}") for i in range(m)]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *moments)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            betas = []
            for _, r in part.iterrows():
                gram = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], float)
                betas.append((np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ np.array([r[f"y{i}"] for i in range(m)], float)).tolist())
            yield part[[*keys, "n"]].assign(beta=betas)

    fields = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, f"{fields}, n long, beta array<double>")


def fitted(terms: list[Column]) -> Column:
    out = F.element_at("beta", 1) * terms[0]
    for k, term in enumerate(terms[1:], 2):
        out = out + F.element_at("beta", k) * term
    return out


def correlation(a: Column, b: Column, least: int = 3) -> Column:
    """Pearson's r over complete pairs as an aggregate; NULL for fewer than ``least`` pairs or a constant side.

    corr() alone divides by zero on constants under ANSI arithmetic.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    varied = (F.count(x) >= least) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(varied, r)


def spearman(frame: DataFrame, keys: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    """keys, paired, spearman: ranks are taken within the complete pairs of each group."""
    pairs = frame.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranks = average_ranks(average_ranks(pairs, keys, a, "__ra"), keys, b, "__rb")
    return ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("paired"), correlation(F.col("__ra"), F.col("__rb"), least).alias("spearman"))
