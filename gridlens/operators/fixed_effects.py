"""Run effects with model and prompt effects on panels with holes: alternating projections, clustered errors, crossed bootstrap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import settle
from .resample import numbered, replicates, weights


@dataclass(frozen=True)
class Fit:
    """Effects of runs against the first one, their covariance, and what entered."""

    runs: list[int]
    effects: np.ndarray
    covariance: np.ndarray
    observations: int
    parameters: int
    rounds: int

    def contrasts(self) -> list[tuple[str, float, float]]:
        """(name, difference, standard error) of each run against the first and of later ones against each other."""
        out = []
        for j, b in enumerate(self.runs):
            for i, a in enumerate(self.runs[:j]):
                c = np.zeros(len(self.effects))
                c[j - 1] = 1
                if i:
                    c[i - 1] = -1
                out.append((f"run {b} vs run {a}", float(c @ self.effects), float(np.sqrt(max(c @ self.covariance @ c, 0.0)))))
        return out


def projected(cells: DataFrame, names: list[str], left: str, right: str, tolerance: float, most: int) -> tuple[DataFrame, DataFrame, int]:
    """Effects of both sides that least squares takes out of each variable; cells(left, right, n, sums by name).

    Each round fits one side to what the other leaves: two aggregates over the cells, however many rows they stand for. Where the
    sides fall into parts that share no cell, effects are fixed up to a shift between sides, which no residual sees.
    """
    other = None
    for round_ in range(1, most + 1):
        fitted = {}
        for own, against in ((left, right), (right, left)):
            source, known = (cells, other) if own == left else (cells, fitted[left])
            if known is None:
                rest = [(F.sum(c) / F.sum("n")).alias(f"{own}_{c}") for c in names]
            else:
                source = source.join(known, against)
                rest = [(F.sum(F.col(c) - F.col("n") * F.col(f"{against}_{c}")) / F.sum("n")).alias(f"{own}_{c}") for c in names]
            fitted[own] = settle(source.groupBy(own).agg(*rest), "effects")
        if other is not None:
            old = other.select(right, *[F.col(f"{right}_{c}").alias(f"old_{c}") for c in names])
            moved = fitted[right].join(old, right).agg(*[F.max(F.abs(F.col(f"{right}_{c}") - F.col(f"old_{c}"))) for c in names]).first()
            if max(moved) < tolerance:
                return fitted[left], fitted[right], round_
        other = fitted[right]
    raise RuntimeError(f"effects did not settle in {most} rounds")


def fit(rows: DataFrame, value: Column, left: str = "model", right: str = "prompt_id", run: str = "run", tolerance: float = 1e-11, most: int = 300) -> Fit:
    """A linear probability model of rows with effects of run, left and right; errors clustered by left and by right.

    Runs are few, the other two any number; rows may be missing anywhere. What run effects explain is what is left of them once
    the other effects are projected out, so the driver only solves for the runs. The covariance adds the sums of scores by left
    and by right and takes off those by cell, each scaled by G / (G - 1) and (N - 1) / (N - K).
    """
    runs = sorted(r[0] for r in rows.select(run).distinct().collect())
    dummies = [f"d{k}" for k in range(1, len(runs))]
    names = ["y", *dummies]
    each = rows.select(left, right, value.cast("double").alias("y"), *[(F.col(run) == r).cast("double").alias(d) for r, d in zip(runs[1:], dummies, strict=True)])
    cells = settle(each.groupBy(left, right).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]), "cells")
    a, b, rounds = projected(cells, names, left, right, tolerance, most)
    rest = each.join(a, left).join(b, right).select(left, right, *[(F.col(c) - F.col(f"{left}_{c}") - F.col(f"{right}_{c}")).alias(c) for c in names])
    products = [F.sum(F.col(p) * F.col(q)) for p in dummies for q in names]
    n, lefts, rights, *sums = rest.agg(F.count("*"), F.countDistinct(left), F.countDistinct(right), *products).first()
    table = np.array(sums).reshape(len(dummies), len(names))
    bread = np.linalg.pinv(table[:, 1:], rcond=1e-12)
    effects = bread @ table[:, 0]
    u = F.col("y") - sum((F.lit(float(e)) * F.col(d) for e, d in zip(effects, dummies, strict=True)), F.lit(0.0))
    scores = rest.withColumn("u", u).groupBy(left, right).agg(*[F.sum(F.col(d) * F.col("u")).alias(d) for d in dummies])
    scores = settle(scores, "scores")
    k = len(runs) + lefts - 1 + rights - 1

    def meat(*keys: str) -> np.ndarray:
        grouped = scores.groupBy(*keys).agg(*[F.sum(d).alias(d) for d in dummies])
        g, *s = grouped.agg(F.count("*"), *[F.sum(F.col(p) * F.col(q)) for p in dummies for q in dummies]).first()
        scale = g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else 1.0
        return scale * np.array(s).reshape(len(dummies), len(dummies))

    return Fit(runs, effects, bread @ (meat(left) + meat(right) - meat(left, right)) @ bread, n, k, rounds)


def crossed_rates(rows: DataFrame, value: Column, reps: int, left: str = "model", right: str = "prompt_id", run: str = "run") -> DataFrame:
    """(rep, run, rate): rates of each run where left and right units are drawn independently; the runs of a draw share it."""
    spark = rows.sparkSession
    sums = settle(rows.groupBy(left, right, run).agg(F.sum(value.cast("double")).alias("x"), F.count("*").alias("n")), "sums")
    sides = [numbered(sums.select(c).distinct(), c) for c in (left, right)]
    wl, wr = (weights(replicates(spark, reps), side.count(), salt).join(side, "pos").select("rep", c, F.col("w").alias("w" + salt)) for side, salt, c in zip(sides, "lr", (left, right), strict=True))
    w = F.col("wl") * F.col("wr")
    return wl.join(sums, left).join(wr, ["rep", right]).groupBy("rep", run).agg((F.sum(w * F.col("x")) / F.sum(w * F.col("n"))).alias("rate"))


def tested(found: Fit, rates: DataFrame, run: str = "run") -> DataFrame:
    """(contrast, estimate, se, low, high, p): each contrast with the percentile interval of its draws and the share of centred
    draws as far out, one counted in; and for "all runs" the length of the vector of effects against that of centred draws."""
    first, *later = found.runs
    wide = settle(rates.groupBy("rep").pivot(run, found.runs).agg(F.first("rate")), "draws")
    contrasts = found.contrasts()
    parts = {name: [int(x) for x in name.replace("run ", "").split(" vs ")] for name, _, _ in contrasts}
    delta = {name: F.col(f"`{b}`") - F.col(f"`{a}`") for name, (b, a) in parts.items()}
    means = wide.agg(*[F.avg(delta[name]).alias(name) for name in delta]).first().asDict()
    size = lambda x: F.round(x, 9)
    out = []
    for name, estimate, se in contrasts:
        far = F.sum((size(F.abs(delta[name] - means[name])) >= size(F.lit(abs(estimate)))).cast("long"))
        ends = [F.percentile(delta[name], F.lit(q)) for q in (0.025, 0.975)]
        out.append(wide.agg(F.lit(name).alias("contrast"), F.lit(estimate).alias("estimate"), F.lit(se).alias("se"), ends[0].alias("low"), ends[1].alias("high"), ((far + 1) / (F.count("*") + 1)).alias("p")))
    names = [f"run {r} vs run {first}" for r in later]
    seen = float(np.sqrt((found.effects**2).sum()))
    long = F.sqrt(sum(((delta[n] - means[n]) ** 2 for n in names), F.lit(0.0)))
    far = F.sum((size(long) >= size(F.lit(seen))).cast("long"))
    none = F.lit(None).cast("double")
    out.append(wide.agg(F.lit("all runs").alias("contrast"), F.lit(seen).alias("estimate"), none.alias("se"), none.alias("low"), none.alias("high"), ((far + 1) / (F.count("*") + 1)).alias("p")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
