"""Whitening of embeddings through covariances found by polarisation.

Entries become whole numbers on a fixed grid, so every sum below is exact. One
job counts the fit list and sums each dimension. The next centres the rows by
the whole part of the mean and adds up squares only: of every dimension, and
of the sum of every pair of dimensions. As (a + b)^2 - a^2 - b^2 = 2ab, the
differences recover all cross-covariances; the fraction that the centring left
over is taken off in whole numbers too, before the one division. The driver
holds ``d * (d + 1) / 2`` totals, whatever the number of rows, assembles the
matrix for ``eigh``, and broadcasts its leading vectors. A last job measures
the covariance of the whitened values against the identity.

Rows meet only as totals, one row of totals per task, so no key can be hot.

Defined cases: rows whose vector is null, empty, or holds a null, a NaN, an
infinity or an entry beyond the grid's long numbers are dropped; of vectors of
several lengths the commonest length stays (of equally common ones the
longest). Repeated rows and rows without an id count and are returned each. A
component without variance (an eigenvalue within rounding of zero) has null
``whitened`` and counts in no error. ``deviation`` is null where it does not
fit a long. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.runtime import stage

SCALE, SHIFT = 64, 1_000_000
_LONG_MAX = (1 << 63) - 1


def on_grid(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """Whole numbers ``floor(scale * entry) + shift`` of a vector; null if it has an entry that has none."""
    wide = F.transform(vector, lambda c: c.cast("double") * scale)
    sound = F.forall(wide, lambda c: F.coalesce(F.abs(c) < float(1 << 62), F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(float("nan")))))
    return F.when(sound & (F.size(vector) > 0), F.transform(wide, lambda c: F.floor(c).cast("long") + shift))


def fit_list(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x`` of the rows that remain, staged."""
    rows = vectors.select(F.col(id_col).alias("id"), on_grid(F.col(vector_col)).alias("x")).filter(F.col("x").isNotNull())
    rows, _ = stage(rows, "grid-vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    return rows.filter(F.size("x") == lengths[0]["d"]) if len(lengths) > 1 else rows


def _matrix(lists: pd.Series) -> np.ndarray:
    return np.stack(lists.to_list()).astype(np.int64)


def _small(y: np.ndarray, factor: int = 1) -> np.ndarray:
    """The same numbers as Python integers where sums of their squares could pass a long."""
    most = max(int(y.max(initial=0)), -int(y.min(initial=0))) * 2 * factor
    return y if most * most * (y.size + 1) <= _LONG_MAX else y.astype(object)


def _square_sums(mean: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per task: sums of y_i^2 and of (y_i + y_j)^2, in the order of ``numpy.triu_indices``, as decimal text."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(mean)
        totals = np.zeros(d * (d + 1) // 2, dtype=object)
        for batch in batches:
            y = _matrix(batch["x"]) - np.array(mean, dtype=np.int64)
            y = _small(y)
            found = []
            for i in range(d):
                both = y[:, i:] + y[:, i : i + 1]
                both[:, 0] = y[:, i]
                found.append((both * both).sum(axis=0))
            totals += np.concatenate(found).astype(object)
        yield pd.DataFrame({"pair": np.arange(len(totals), dtype=np.int32), "total": [str(t) for t in totals]})

    return add


def covariance(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """``n``, sums per dimension, and n^2 times the covariance matrix, all exact."""
    first = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    if not first:
        return 0, [], []
    n, d = first[0]["n"], len(first)
    sums = [0] * d
    for r in first:
        sums[r["at"]] = int(r["s"])
    mean = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean, strict=True)]  # sum of the centred values
    squares = (
        rows.select("x").mapInPandas(_square_sums(mean), "pair int, total string")
        .groupBy("pair").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    at = {(int(i), int(j)): k for k, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True))}
    total = {r["pair"]: int(r["total"]) for r in squares}
    own = [n * total[at[i, i]] - rest[i] ** 2 for i in range(d)]  # n^2 times the variance of a dimension
    cov = [[0] * d for _ in range(d)]
    for (i, j), k in at.items():
        if i == j:
            cov[i][i] = own[i]
        else:
            together = n * total[k] - (rest[i] + rest[j]) ** 2
            cov[i][j] = cov[j][i] = (together - own[i] - own[j]) // 2
    return n, sums, cov


def leading(n: int, cov: list[list[int]], components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors as columns by falling eigenvalue, their eigenvalues, and each one's share of the trace."""
    if not n:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0)
    v = np.array([[c / (n * n) for c in row] for row in cov], dtype=np.float64)  # one rounding per entry
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(cov[i][i] for i in range(len(cov))) / (n * n)
    values, vectors = values[order], vectors[:, order]
    return vectors, values, values / trace if trace else np.zeros(len(values))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: longs where they fit, else Python integers."""
    mean = np.array([s // n for s in sums], dtype=np.int64)
    y = x - mean
    y = y if max(int(y.max(initial=0)), -int(y.min(initial=0))) * n + n <= _LONG_MAX else y.astype(object)
    return y * n - np.array([s % n for s in sums], dtype=y.dtype)


def _project(z: np.ndarray, n: int, vectors: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Centred values on the components, each over its deviation; NaN where a component has none."""
    return (z.astype(np.float64) / n) @ vectors / scale


def _product_sums(n: int, sums: list[int], vectors: np.ndarray, scale: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per task: sums of the whitened values and of their products, by place in a (k + 1) x k table."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(scale)
        totals = np.zeros((k + 1, k))
        for batch in batches:
            w = _project(_centred(_matrix(batch["x"]), n, sums), n, vectors, scale)
            totals[:k] += w.T @ w
            totals[k] += w.sum(axis=0)
        yield pd.DataFrame({"at": np.arange(totals.size, dtype=np.int32), "total": totals.ravel()})

    return add


def _whitener(n: int, sums: list[int], vectors: np.ndarray, scale: np.ndarray) -> Callable:
    @F.pandas_udf("deviation long, whitened array<double>")
    def give(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"deviation": [], "whitened": []})
                continue
            z = _centred(_matrix(batch), n, sums)
            exact = _small(z)
            deviation = [int(t) for t in (exact * exact).sum(axis=1)]
            yield pd.DataFrame({
                "deviation": pd.Series([t if t <= _LONG_MAX else None for t in deviation], dtype="Int64"),
                "whitened": list(_project(z, n, vectors, scale))})

    return give


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` per remaining row and leading component.

    ``deviation`` is the row's squared distance from the mean, times n^2, on the grid.
    """
    rows = fit_list(vectors, id_col, vector_col)
    n, sums, cov = covariance(rows)
    basis, values, explained = leading(n, cov, components)
    some = values > max(float(values.max(initial=0.0)), 0.0) * len(sums) * np.finfo(np.float64).eps
    scale = np.where(some, np.sqrt(np.where(some, values, 1.0)), np.nan)
    k = len(scale)
    found = rows.select("x").mapInPandas(_product_sums(n, sums, basis, scale), "at int, total double").groupBy("at").agg(F.sum("total").alias("t")).collect()
    table = np.zeros((k + 1) * k)
    for r in found:
        table[r["at"]] = r["t"]
    table = table.reshape(k + 1, k) / max(n, 1)
    off = np.abs(table[:k] - np.outer(table[k], table[k]) - np.eye(k))[np.ix_(some, some)]
    given = rows.select("id", _whitener(n, sums, basis, scale)("x").alias("w")).select("id", "w.deviation", F.posexplode("w.whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(e)) for e in explained]) if k else F.array().cast("array<double>")
    return given.select(
        "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("whitened"), F.col("whitened")).alias("whitened"), F.get(shares, F.col("at")).alias("explained"),
        F.lit(float(off.max(initial=0.0))).alias("identity_error"))
