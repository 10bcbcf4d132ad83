"""Whitening of embeddings by shifted CholeskyQR.

Rows are centred by their exact mean. A pass sums the Gram matrix of the rows so far divided by all
earlier factors (each by a triangular solve inside the tasks), and the Cholesky factor of that sum is
the next factor. The first factor is shifted so that it exists for any condition number; the next
ones make the rows orthonormal to double precision. The composed factor R has the rows' singular
values and right singular vectors, so the SVD of that small matrix gives the whitening components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from batchtrace.llm.shared import ship, store

#: Passes at most; three are enough unless dimensions depend on each other.
MAX_PASSES = 6
EPS = float(np.finfo(float).eps)
#: Entries beyond this are taken as this, so that differences of two stay exact in a long.
MAX_ENTRY = 1 << 52


def _below(lower: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows divided by lower.T: a triangular solve, one column after the other."""
    out = np.array(rows, np.float64)
    for j in range(len(lower)):
        out[:, j] = (out[:, j] - out[:, :j] @ lower[j, :j]) / lower[j, j]
    return out


def _centred(vectors: pd.Series, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n as doubles: whole parts are subtracted as longs first."""
    x = np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), len(base))
    return (x - base).astype(np.float64) - rest


def _summed(rows: DataFrame, of, size: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Sum over all rows of ``of(centred rows).T @ of(centred rows)``: one partial matrix a task, added up
    by entry in Spark."""
    def parts(batches):
        total = np.zeros((size, size))
        for pdf in batches:
            q = of(_centred(pdf["x"], base, rest))
            total += q.T @ q
        yield pd.DataFrame({"g": [total.ravel()]})

    got = (rows.select("x").mapInPandas(parts, "g array<double>").select(F.posexplode("g").alias("i", "v"))
           .groupBy("i").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(size * size)
    for r in got:
        out[r["i"]] = r["v"]
    return out.reshape(size, size)


def factor(gram, n: int, width: int) -> np.ndarray:
    """Upper triangular R (a square root of the centred rows' Gram matrix) from Gram passes:
    ``gram(factors)`` is the Gram matrix of the rows divided by all ``factors`` (lower triangles)."""
    factors: list[np.ndarray] = []
    composed = np.eye(width)
    for _ in range(MAX_PASSES):
        g = gram(factors)
        g = (g + g.T) / 2
        if not factors and not g.any():
            return np.zeros((width, width))
        shift = 0.0 if factors else 11 * (n * width + width * (width + 1)) * (EPS / 2) * float(np.trace(g))
        orthonormal = bool(factors) and np.abs(g - np.eye(width)).max() < 64 * width * EPS
        try:
            lower = np.linalg.cholesky(g + shift * np.eye(width))
        except np.linalg.LinAlgError:  # dependent dimensions: shift again
            lower = np.linalg.cholesky(g + 4 * width * EPS * float(np.trace(g)) * np.eye(width))
        if orthonormal:
            return lower.T @ composed
        factors.append(lower)
        composed = lower.T @ composed
    # dimensions that depend on each other never become orthonormal; the last Gram matrix has what is left
    g = gram(factors)
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    return (vectors * np.sqrt(np.maximum(values, 0.0))).T @ composed


def whiten(rows: DataFrame, x: Column, carry: list[str], components: int = 8) -> DataFrame:
    """``carry`` columns, component (from 1), n, deviation, whitened, explained, identity_error: a row for
    each input row and component.

    ``x`` is an array of longs, as integers. n counts the rows; deviation is the sum over dimensions
    of (n*x - S)^2, exact (null beyond a long); whitened is the centred row's projection on the
    component over the root of its eigenvalue; explained is the eigenvalue's share of the trace;
    identity_error the largest absolute entry of whitened's covariance minus the identity, measured
    over all rows. Components are ordered by falling eigenvalue, each with its largest entry positive.

    Rows whose ``x`` is null, holds nulls, or has another length than most have (ties: the longest)
    are left out. Entries beyond 2^52 count as that. Components without variance (eigenvalue at most
    double precision of the largest) have a null ``whitened``, explained 0, and don't count for
    identity_error, which is null if none is left. Vectors shorter than ``components`` have as many
    components as dimensions. Repeated rows count each. Input columns with the names of result columns
    are replaced. Empty table: empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    keep = [F.col(f"`{c}`") for c in carry if c not in added]
    clipped = F.transform(x, lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-MAX_ENTRY)), F.lit(MAX_ENTRY))))
    base = rows.select(F.struct(*keep, F.lit(0).alias("_")).alias("_row"), clipped.alias("x"))
    base = store(base.where("x is not null and forall(x, c -> c is not null)"), "whiten-rows")
    most = base.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width, n = (most["width"], most["count"]) if most else (0, 0)
    base = base.where(F.size("x") == width)
    # high and low halves, so that no sum of longs overflows
    half = [F.sum(F.shiftright("c", 26)).alias("high"), F.sum(F.col("c").bitwiseAND((1 << 26) - 1)).alias("low")]
    got = {r["i"]: (r["high"] << 26) + r["low"] for r in base.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(*half).collect()}
    sums = [got[i] for i in range(width)]
    whole, left = np.array([s // max(1, n) for s in sums], np.int64), [s % max(1, n) for s in sums]
    rest = np.array([v / max(1, n) for v in left], np.float64)

    def gram(factors: list[np.ndarray]) -> np.ndarray:
        def divided(y: np.ndarray) -> np.ndarray:
            for lower in factors:
                y = _below(lower, y)
            return y
        return _summed(base, divided, width, whole, rest)

    r = factor(gram, n, width) if width and n else np.zeros((width, width))
    _, sigma, axes = np.linalg.svd(r) if width else (None, np.zeros(0), np.zeros((0, 0)))
    values = sigma ** 2 / max(1, n)
    count = min(components, width)
    live = [bool(values[0] > 0 and values[k] > width * EPS * values[0]) for k in range(count)]
    share = [float(values[k] / values.sum()) if live[k] else 0.0 for k in range(count)]
    axes = axes[:count] * np.sign(axes[np.arange(count), np.abs(axes[:count]).argmax(axis=1)])[:, None] if count else axes
    scaled = np.array([axes[k] / np.sqrt(values[k]) if live[k] else np.zeros(width) for k in range(count)]).reshape(count, width).T

    error = None
    if any(live):
        used = scaled[:, [k for k in range(count) if live[k]]]
        covariance = _summed(base, lambda y: y @ used, used.shape[1], whole, rest) / n
        error = float(np.abs(covariance - np.eye(len(covariance))).max())

    def deviations(vectors: pd.Series) -> list:
        x = np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), width)
        near = x - whole
        if width == 0 or float(np.abs(near).max(initial=0) + 1) * n < 2.0 ** 31 / np.sqrt(max(1, width)):
            return ((n * near - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
        out = [sum((n * c - s) ** 2 for c, s in zip(v, left, strict=True)) for v in near.tolist()]
        return [s if s < 1 << 63 else None for s in out]

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(vectors: pd.Series) -> pd.DataFrame:
        w = _centred(vectors, whole, rest) @ scaled
        return pd.DataFrame({"deviation": pd.Series(deviations(vectors), dtype="Int64"), "whitened": list(w)})

    out = base.select("_row", project("x").alias("_p")).select("_row", "_p.deviation", F.posexplode("_p.whitened").alias("_k", "_v"))
    constant = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("_k"))
    out = out.withColumn("component", (F.col("_k") + 1).cast("int")).withColumn("n", F.lit(n).cast("long"))
    out = out.withColumn("whitened", F.when(constant(live, "boolean"), F.col("_v"))).withColumn("explained", constant(share, "double"))
    out = out.withColumn("identity_error", F.lit(error).cast("double"))
    return out.select("_row.*", *added).drop("_")
