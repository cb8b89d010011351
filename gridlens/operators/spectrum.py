"""Leading axes of units by items, any number of either: subspace iteration whose products are joins and sums in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import settle

#: Vectors that are iterated; a panel of no more units or items than these is exact after two rounds.
WIDTH = 32
#: What the axes sought may still hold of others when the rounds end, and rounds at most.
MIXED, ROUNDS = 1e-10, 100


def gram(vectors: DataFrame, k: int) -> np.ndarray:
    sums = vectors.agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")) for i in range(k) for j in range(i + 1)]).first()
    out = np.zeros((k, k))
    out[np.tril_indices(k)] = [x or 0.0 for x in sums]
    return out + np.tril(out, -1).T


def times(vectors: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """The vectors times a small matrix of the driver."""
    k, m = matrix.shape
    return vectors.select(key, *[sum((F.col(f"v{i}") * float(matrix[i, j]) for i in range(k)), F.lit(0.0)).alias(f"v{j}") for j in range(m)])


def applied(entries: DataFrame, vectors: DataFrame, by: str, to: str, k: int) -> DataFrame:
    """Sums of x times the vectors of by, for each to."""
    return settle(entries.join(vectors, by).groupBy(to).agg(*[F.sum(F.col("x") * F.col(f"v{j}")).alias(f"v{j}") for j in range(k)]), "axes")


def scores(cells: DataFrame, unit: str, item: str, value: Column, axes: int = 2, width: int = WIDTH) -> DataFrame:
    """(unit, pc1 .., share1 ..): coordinates of units on the leading axes of their item vectors, centred by item, and the shares
    of variance; a unit without an item has its mean there.

    A few more vectors than axes are multiplied by the table and its transpose in turn and made orthogonal, until what is left of
    the first axis beyond them is under MIXED. Units and items stay in Spark; the driver sees matrices of width x width.
    Signs are such that scores go with the units' mean values. Axes beyond the rank are zero.
    """
    raw = cells.select(F.col(unit).alias("u"), F.col(item).alias("i"), value.cast("double").alias("v"))
    means = raw.groupBy("i").agg(F.avg("v").alias("m"))
    entries = settle(raw.join(means, "i").select("u", "i", (F.col("v") - F.col("m")).alias("x"), "v"), "entries")
    n_units, n_items, total = entries.agg(F.countDistinct("u"), F.countDistinct("i"), F.sum(F.col("x") * F.col("x"))).first()
    k = max(1, min(width, n_units, n_items))
    start = [(F.xxhash64("i", F.lit(j)) / 2.0**63).alias(f"v{j}") for j in range(k)]
    vectors = entries.select("i").distinct().select("i", *start)
    for round_ in range(1, ROUNDS + 1):
        g = gram(vectors, k)
        size, turn = np.linalg.eigh(g)
        keep = size > max(size.max(), 1e-300) * 1e-14
        vectors = times(vectors, "i", turn[:, keep] / np.sqrt(size[keep]))
        k = int(keep.sum())
        left = applied(entries, vectors, "i", "u", k)
        squares, turn = np.linalg.eigh(gram(left, k))
        squares, turn = np.maximum(squares[::-1], 0), turn[:, ::-1]
        wanted = squares[min(axes, k) - 1]
        rest = squares[-1] / wanted if wanted > 0 else 0.0
        # the first round's vectors are arbitrary; from the second on they lie where the table's rows do
        if k >= n_items or round_ > 1 and (squares.sum() >= total * (1 - 1e-13) or rest**round_ < MIXED):
            break
        vectors = applied(entries, left, "u", "i", k)
    own = [times(left, "u", turn[:, [a]]).withColumnRenamed("v0", f"pc{a + 1}") for a in range(min(axes, k))]
    out = entries.groupBy("u").agg(F.avg("v").alias("rate"))
    for part in own:
        out = out.join(part, "u")
    out = settle(out, "scores")
    names = [f"pc{a + 1}" for a in range(len(own))]
    signs = out.agg(*[F.coalesce(F.covar_pop(c, "rate"), F.lit(0.0)) for c in names]).first()
    columns = [(F.col(c) * (-1.0 if s < 0 else 1.0)).alias(c) for c, s in zip(names, signs, strict=True)]
    zero = [F.lit(0.0).alias(f"pc{a + 1}") for a in range(len(own), axes)]
    shares = [F.lit(float(squares[a] / total) if a < k and total else 0.0).alias(f"share{a + 1}") for a in range(axes)]
    return out.select(F.col("u").alias(unit), *columns, *zero, *shares)
