"""Exact quantiles and Kendall's tau-b of columns of any length, without ordering all rows in one place."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import settle

#: Values that may be gathered once a rank is narrowed down to them.
GATHERED = 4096


@dataclass(frozen=True)
class Bracket:
    """Where a rank lies: between two values, each in or out, with what is counted below and inside; spread: of the next pass."""

    low: float | None = None
    low_in: bool = True
    high: float | None = None
    high_in: bool = True
    below: int = 0
    size: int = 0
    spread: float = 1e-3

    def inside(self) -> Column:
        x = F.col("x")
        own = F.lit(True) if self.low is None else x >= self.low if self.low_in else x > self.low
        return own if self.high is None else own & (x <= self.high if self.high_in else x < self.high)


def order_statistics(df: DataFrame, value: Column, ranks: Iterable[int]) -> dict[int, float]:
    """The value of each rank (from 0) among the values that aren't null.

    Each pass puts two values around every rank with a sketch, counts exactly what lies below and between them, and looks only
    where the rank is from then on, until that is one value or few. If a pass gains nothing the next one puts them closer, and
    in the end on one value; a sketch that is off only makes for another pass.
    """
    x = df.select(value.cast("double").alias("x")).where("x is not null")
    n, done = x.count(), {}
    open_ = {r: Bracket(size=n) for r in ranks if 0 <= r < n}
    while wide := {r: s for r, s in open_.items() if s.size > GATHERED}:
        asks = []
        for r, s in wide.items():
            at = (r - s.below + 0.5) / s.size
            asks.append(F.percentile_approx(F.when(s.inside(), F.col("x")), [max(0.0, at - s.spread), min(1.0, at + s.spread)], 10_000))
        brackets = dict(zip(wide, x.agg(*asks).first(), strict=True))
        counts = [F.sum(c.cast("long")) for a, b in brackets.values() for c in (F.col("x") < a, F.col("x") <= b)]
        found = list(x.agg(*counts).first())
        for k, (r, (a, b)) in enumerate(brackets.items()):
            old, less, upto = wide[r], found[2 * k], found[2 * k + 1]
            if r < less:
                open_[r] = replace(old, high=a, high_in=False, size=less - old.below)
            elif r >= upto:
                open_[r] = replace(old, low=b, low_in=False, below=upto, size=old.below + old.size - upto)
            elif a == b:
                done[r] = a
                del open_[r]
            else:
                open_[r] = Bracket(a, True, b, True, less, upto - less, old.spread * 2 if 2 * (upto - less) < old.size else old.spread / 8)
    if open_:
        lists = [F.sort_array(F.collect_list(F.when(s.inside(), F.col("x")))) for s in open_.values()]
        for (r, s), own in zip(open_.items(), x.agg(*lists).first(), strict=True):
            done[r] = own[r - s.below]
    return done


def quantiles(df: DataFrame, value: Column, at: list[float]) -> DataFrame:
    """(q, value): exact quantiles, by linear interpolation between the two nearest ranks; null without values."""
    n = df.where(value.isNotNull()).count()
    places = {q: (n - 1) * q for q in at} if n else {}
    found = order_statistics(df, value, {r for h in places.values() for r in (math.floor(h), math.ceil(h))})
    rows = []
    for q in at:
        if q in places:
            low, high = found[math.floor(places[q])], found[math.ceil(places[q])]
            rows.append((q, low + (high - low) * (places[q] - math.floor(places[q])) if high != low else low))
        else:
            rows.append((q, None))
    return df.sparkSession.createDataFrame(rows, "q double, value double")


def inversions(key: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Weighted pairs with a smaller key and a larger y, both strictly, by merging blocks of doubled width."""
    order = np.lexsort((y, key))  # equal keys come by y, so none of their pairs counts
    rank = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    weight = n[order].astype(np.int64)
    size, width, out, place = len(rank), 1, 0, np.arange(len(rank))
    span = int(rank.max()) + 1 if size else 1
    while width < size:
        block = place // (2 * width)
        left = (place // width) % 2 == 0
        keys = block * span + rank
        by = np.argsort(keys[left], kind="stable")
        sums = np.concatenate([[0], np.cumsum(weight[left][by])])
        own = keys[left][by]
        right = ~left
        ends = np.searchsorted(own, (block[right] + 1) * span, "left")
        upto = np.searchsorted(own, keys[right], "right")
        out += int((weight[right] * (sums[ends] - sums[upto])).sum())
        width *= 2
    return out


def ranged(df: DataFrame, column: str, name: str, ranges: int) -> DataFrame:
    """Adds the range of a column's value: values at a cut have a range of their own, so a value that fills many rows is one
    range without any other."""
    cuts = df.select(F.array_distinct(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 10_000)).alias("cuts"))
    before = F.size(F.filter("cuts", lambda c: c < F.col(column)))
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, (2 * before + F.array_contains("cuts", F.col(column)).cast("int")).cast("int")).drop("cuts")


def discordant(pairs: DataFrame, ranges: int) -> DataFrame:
    """One row (d): weighted pairs of pairs(x, y, n) in opposite order.

    Pairs in different ranges of both columns come from the table of ranges, at most (2 ranges)^2 counts. The others share a
    range, and are counted range by range; a range of one value has none.
    """
    placed = settle(ranged(ranged(pairs, "x", "bx", ranges), "y", "by", ranges), "ranges")
    grid = placed.groupBy("bx", "by").agg(F.sum("n").alias("n"))
    whole = grid.select("bx").distinct().crossJoin(grid.select("by").distinct()).join(grid, ["bx", "by"], "left").fillna(0, ["n"])
    above = F.coalesce(F.sum("n").over(Window.partitionBy("bx").orderBy(F.desc("by")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum("above").over(Window.partitionBy("by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = whole.withColumn("above", above).withColumn("before", before).agg(F.sum(F.col("n") * F.col("before")).alias("d"))

    def within(key: str):
        def count(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"d": [inversions(group[key].to_numpy(), group["y"].to_numpy(), group["n"].to_numpy())]})

        return count

    same_x = placed.where("bx % 2 = 0").groupBy("bx").applyInPandas(within("x"), "d long")
    same_y = placed.where("by % 2 = 0").groupBy("by").applyInPandas(within("bx"), "d long")
    return apart.unionByName(same_x).unionByName(same_y).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"))


def tau_b(df: DataFrame, x: str, y: str, ranges: int | None = None) -> DataFrame:
    """One row (n, tau_b) for the rows where neither column is null; equal rows are one with a number. Null without two values of
    each. No pair of rows is formed: a range holds about one in ranges of the rows, which grow to 1,024 with the table."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    pairs = settle(rows.groupBy("x", "y").agg(F.count("*").alias("n")), "pairs")
    ranges = ranges or min(1024, max(2, pairs.count() // 20_000))
    tied = lambda *keys: pairs.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("t"))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    one = total.crossJoin(tied("x").withColumnRenamed("t", "tx")).crossJoin(tied("y").withColumnRenamed("t", "ty")).crossJoin(tied("x", "y").withColumnRenamed("t", "txy")).crossJoin(discordant(pairs, ranges))
    every = F.col("n") * (F.col("n") - 1) / 2
    s = every - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d")
    return one.select("n", F.try_divide(s, F.sqrt((every - F.col("tx")) * (every - F.col("ty")))).alias("tau_b"))
