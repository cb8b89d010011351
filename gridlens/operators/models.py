"""Regression models: sums over rows in Spark, small solves on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import auroc
from .resample import interval, numbered, replicates, weights


def gram(df: DataFrame, terms: list[Column], weight: Column | None = None) -> np.ndarray:
    """X'WX of the terms in one aggregate: a matrix of terms, whatever the rows."""
    w = weight if weight is not None else F.lit(1.0)
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    row = df.agg(*[F.coalesce(F.sum(w * terms[i] * terms[j]), F.lit(0.0)).cast("double") for i, j in pairs]).first()
    out = np.zeros((len(terms), len(terms)))
    for (i, j), v in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = v
    return out


@dataclass
class Ols:
    names: list[str]
    beta: np.ndarray
    r2: float

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(n, float(b), self.r2) for n, b in zip(self.names, self.beta, strict=True)], "term string, beta double, r2 double")


def ols(df: DataFrame, y: Column, terms: dict[str, Column], ridge: float = 1e-8) -> Ols:
    """Least squares with a ridge on all but the intercept."""
    names = ["intercept", *terms]
    cols = [F.lit(1.0), *[c.cast("double") for c in terms.values()], y.cast("double")]
    g = gram(df, cols)
    xx, xy, yy, n = g[:-1, :-1], g[:-1, -1], g[-1, -1], g[0, 0]
    penalty = np.eye(len(names)) * ridge
    penalty[0, 0] = 0
    beta = np.linalg.lstsq(xx + penalty, xy, rcond=None)[0]
    total = yy - xy[0] ** 2 / max(n, 1)
    rest = yy - 2 * beta @ xy + beta @ xx @ beta
    return Ols(names, beta, float(1 - rest / total) if total > 0 else 0.0)


@dataclass
class Logit:
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    covariance: np.ndarray | None = None

    @property
    def mcfadden(self) -> float:
        return 1 - self.log_likelihood / self.null_log_likelihood if self.null_log_likelihood else 0.0

    def linear(self, terms: dict[str, Column]) -> Column:
        out = F.lit(float(self.beta[0]))
        for b, c in zip(self.beta[1:], terms.values(), strict=True):
            out = out + F.lit(float(b)) * c
        return out

    def frame(self, spark) -> DataFrame:
        rows = [(n, float(b), float(s), math.exp(max(-700.0, min(700.0, float(b)))), self.mcfadden) for n, b, s in zip(self.names, self.beta, self.se, strict=True)]
        return spark.createDataFrame(rows, "term string, beta double, se double, odds_ratio double, mcfadden double")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))


def logit(df: DataFrame, successes: Column, trials: Column, terms: dict[str, Column], ridge: float = 1e-4, rounds: int = 50, tol: float = 1e-8) -> Logit:
    """Grouped-binomial logistic regression by Newton steps with halving.

    Rows of equal terms are summed once and kept; each step is then one aggregate over that table, not over what it came from.
    The ridge is half ridge times the squared norm of all coefficients but the intercept.
    """
    names = ["intercept", *terms]
    k = len(names)
    design = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values(), 1)], successes.cast("double").alias("s"), trials.cast("double").alias("n"))
    design = design.groupBy(*[f"x{i}" for i in range(1, k)]).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).persist()
    cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, k)]]
    s, n = F.col("s"), F.col("n")
    penalty = np.full(k, ridge)
    penalty[0] = 0

    def pieces(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((F.lit(float(b)) * c for b, c in zip(beta[1:], cols[1:], strict=True)), F.lit(float(beta[0])))
        p = sigmoid(z)
        ll = F.sum(s * z - n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))))
        w = F.greatest(n * p * (1 - p), F.lit(1e-12))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = design.agg(ll, *[F.sum((s - n * p) * c) for c in cols], *[F.sum(w * cols[i] * cols[j]) for i, j in pairs]).first()
        row = [0.0 if v is None else v for v in row]
        hess = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[1 + k :], strict=True):
            hess[i, j] = hess[j, i] = v
        return row[0] - 0.5 * float(penalty @ beta**2), np.array(row[1 : 1 + k]) - penalty * beta, hess + np.diag(penalty)

    try:
        beta, value, hess = ascend(pieces, k, rounds, tol)
        totals = design.agg(F.sum(s), F.sum(n)).first()
    finally:
        design.unpersist()
    share = totals[0] / totals[1] if totals[1] else 0.0
    null = totals[0] * math.log(share) + (totals[1] - totals[0]) * math.log(1 - share) if 0 < share < 1 else 0.0
    covariance = np.linalg.pinv(hess)
    return Logit(names, beta, np.sqrt(np.maximum(np.diag(covariance), 0)), value + 0.5 * float(penalty @ beta**2), null, covariance)


def ascend(pieces, k: int, rounds: int = 50, tol: float = 1e-8) -> tuple[np.ndarray, float, np.ndarray]:
    """Newton steps with halving; pieces(beta) gives the penalised likelihood, its gradient and the negative Hessian."""
    beta = np.zeros(k)
    value, grad, hess = pieces(beta)
    for _ in range(rounds):
        step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        scale = 1.0
        while True:
            new = beta + scale * step
            got = pieces(new)
            if got[0] >= value - 1e-12 or scale < 1e-4:
                break
            scale /= 2
        moved = np.abs(new - beta).max()
        beta, (value, grad, hess) = new, got
        if moved < tol:
            break
    return beta, value, hess


def logit_of(x: np.ndarray, s: np.ndarray, n: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Coefficients, intercept first, of one small design that is at hand."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(design.shape[1], ridge)
    penalty[0] = 0

    def pieces(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = design @ beta
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        w = np.maximum(n * p * (1 - p), 1e-12)
        value = float((s * z - n * np.logaddexp(0, z)).sum()) - 0.5 * float(penalty @ beta**2)
        return value, design.T @ (s - n * p) - penalty * beta, (design * w[:, None]).T @ design + np.diag(penalty)

    return ascend(pieces, design.shape[1])[0]


def prediction_band(df: DataFrame, model: Logit, terms: dict[str, Column], z: float = 1.96) -> DataFrame:
    """Adds p, low and high: the prediction and its Wald band, made on the logit scale with the fit's covariance."""
    x = [F.lit(1.0), *[c.cast("double") for c in terms.values()]]
    eta = model.linear({k: c.cast("double") for k, c in terms.items()})
    variance = sum((F.lit(float(model.covariance[i, j])) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    se = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return df.withColumns({"p": sigmoid(eta), "low": sigmoid(eta - z * se), "high": sigmoid(eta + z * se)})


def marginal_effects(df: DataFrame, model: Logit, terms: dict[str, Column], weight: Column, binary: set[str] = frozenset()) -> DataFrame:
    """(term, ame): the mean derivative, or for a binary term the mean difference between 1 and 0."""
    w = weight.cast("double")
    z = model.linear(terms)
    p = sigmoid(z)
    out = []
    for name, b in zip(model.names[1:], model.beta[1:], strict=True):
        if name in binary:
            one, zero = model.linear(terms | {name: F.lit(1.0)}), model.linear(terms | {name: F.lit(0.0)})
            effect = sigmoid(one) - sigmoid(zero)
        else:
            effect = F.lit(float(b)) * p * (1 - p)
        out.append((name, F.sum(w * effect) / F.sum(w)))
    wide = df.agg(*[e.alias(n) for n, e in out])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("term"), F.col(n).alias("ame")) for n, _ in out])))


def fit_summary(df: DataFrame, model: Logit, terms: dict[str, Column], successes: Column, trials: Column) -> DataFrame:
    """One row for a fit: trials, the share of successes, both log-likelihoods, McFadden's R2, and the area under the curve of its
    predictions, ties at one half; one half where all trials end alike."""
    eta = model.linear({k: c.cast("double") for k, c in terms.items()})
    each = df.select(eta.alias("eta"), successes.cast("double").alias("s"), trials.cast("double").alias("n"))
    both = each.select("eta", F.inline(F.array(F.struct(F.lit(True).alias("hit"), F.col("s").alias("w")), F.struct(F.lit(False).alias("hit"), (F.col("n") - F.col("s")).alias("w"))))).where("w > 0")
    area = auroc(both, "eta", F.col("hit"), F.col("w")).select(F.coalesce("auroc", F.lit(0.5)).alias("auc"))
    sums = each.agg(F.sum("n").alias("n"), F.try_divide(F.sum("s"), F.sum("n")).alias("positive_rate"))
    own = [F.lit(float(v)).alias(n) for n, v in (("log_likelihood", model.log_likelihood), ("null_log_likelihood", model.null_log_likelihood), ("mcfadden", model.mcfadden))]
    return sums.select("n", "positive_rate", *own).crossJoin(F.broadcast(area))


def standardised(df: DataFrame, names: list[str], by: DataFrame | None = None) -> DataFrame:
    """Adds z_<name>: (x - mean) / sample deviation, both of `by` (a training part) or of df; no spread counts as one."""
    stats = (by if by is not None else df).agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(f"s_{n}") for n in names])
    out = df.crossJoin(F.broadcast(stats))
    sd = lambda n: F.when(F.col(f"s_{n}") > 0, F.col(f"s_{n}")).otherwise(1.0)
    return out.withColumns({f"z_{n}": (F.col(n) - F.col(f"m_{n}")) / sd(n) for n in names}).drop(*[f"{p}_{n}" for n in names for p in "ms"])


def folds(clusters: DataFrame, cluster: str, prompts: str, cells: str, positives: str, k: int = 10) -> DataFrame:
    """(cluster, fold): clusters by falling rate, then prompts, then hash, each to the fold of fewest cells so far, of these to the
    one whose rate comes nearest to the rate of all, of these to the first.

    Each choice rests on those before, so the driver makes them: clusters are the distinct signatures of a benchmark's prompts.
    """
    rows = clusters.select(cluster, prompts, cells, positives, F.sha2(F.col(cluster).cast("string"), 256).alias("h")).collect()
    target = sum(r[positives] for r in rows) / max(1, sum(r[cells] for r in rows))
    size, good = [0.0] * k, [0.0] * k
    out = []
    for r in sorted(rows, key=lambda r: (-r[positives] / r[cells], -r[prompts], r.h)):
        to = min(range(k), key=lambda f: (size[f], abs((good[f] + r[positives]) / (size[f] + r[cells]) - target), f))
        size[to] += r[cells]
        good[to] += r[positives]
        out.append((r[cluster], to))
    return clusters.sparkSession.createDataFrame(out, f"{cluster} {clusters.schema[cluster].dataType.simpleString()}, fold int")


def standardised_array(x: np.ndarray, train: np.ndarray, flags: list[bool]) -> np.ndarray:
    """Columns less the training rows' mean, over their sample deviation (one where there is none); flags stay as they are."""
    mean, sd = x[train].mean(0), x[train].std(0, ddof=1) if train.sum() > 1 else np.ones(x.shape[1])
    return np.where(flags, x, (x - mean) / np.where(sd > 0, sd, 1.0))


def cross_validate(df: DataFrame, fold: str, successes: str, trials: str, specs: dict[str, list[str]], k: int, flags: tuple[str, ...] = ("barrier",), units: str | None = None, ridge: float = 1e-4) -> DataFrame:
    """Held-out predictions p of each spec (model, p and df's columns): each fold by a model of the others, standardised on those.

    Every fold and spec is one group of items that its own worker fits; the items of a benchmark are few. units: a column of
    items within which there are dummies, one less than values.
    """
    spark = df.sparkSession
    levels = [r[0] for r in df.select(units).distinct().orderBy(units).collect()][1:] if units else []
    asked = spark.createDataFrame([(m, f) for m in specs for f in range(k)], "model string, held int")
    out = df.schema

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = specs[key[0]]
        test = (rows[fold] == key[1]).to_numpy()
        x = standardised_array(rows[names].to_numpy(float), ~test, [n in flags for n in names])
        if units:
            x = np.column_stack([x, rows[units].to_numpy()[:, None] == np.array(levels)[None, :]])
        beta = logit_of(x[~test], rows[successes].to_numpy(float)[~test], rows[trials].to_numpy(float)[~test], ridge)
        z = beta[0] + x[test] @ beta[1:]
        return rows[test].drop(columns=["held"]).assign(p=1 / (1 + np.exp(-np.clip(z, -35, 35))))

    both = df.crossJoin(F.broadcast(asked))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", model string, p double"
    return both.groupBy("model", "held").applyInPandas(fit, schema)


def prediction_metrics(scored: DataFrame, successes: str, trials: str, *keys: str) -> DataFrame:
    """Log loss and Brier score of predictions p over grouped trials."""
    s, n, p = F.col(successes), F.col(trials), F.greatest(F.least(F.col("p"), F.lit(1 - 1e-12)), F.lit(1e-12))
    return scored.groupBy(*keys).agg(
        F.sum(n).alias("n"), (-F.sum(s * F.log(p) + (n - s) * F.log(1 - p)) / F.sum(n)).alias("log_loss"), (F.sum(s * (1 - p) * (1 - p) + (n - s) * p * p) / F.sum(n)).alias("brier")
    )


def prediction_auroc(scored: DataFrame, successes: str, trials: str, *keys: str) -> DataFrame:
    """(keys, auc) of predictions p over grouped trials: each row is its successes and its failures at one score."""
    s, n = F.col(successes).cast("double"), F.col(trials).cast("double")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("good"), s.alias("w")), F.struct(F.lit(False).alias("good"), (n - s).alias("w")))).alias("x")
    rows = scored.select(*keys, F.round("p", 12).alias("p"), sides).select(*keys, "p", "x.good", "x.w")
    return auroc(rows, "p", F.col("good"), F.col("w"), *keys).select(*keys, F.col("auroc").alias("auc"))


def cv_deltas(scored: DataFrame, cluster: str, successes: str, trials: str, base: str, reps: int) -> DataFrame:
    """(model, metric, value, delta, low, high): of each model, its metrics, and what they differ by from the base model's, with a
    percentile interval over draws of clusters; all models share the draws."""
    units = numbered(scored.select(F.col(cluster).alias("cluster")).distinct(), "cluster")
    w = weights(replicates(scored.sparkSession, reps), units.count(), "cv").join(F.broadcast(units), "pos").select("rep", F.col("cluster").alias(cluster), "w")
    w = w.unionByName(units.select(F.lit(0).cast("long").alias("rep"), F.col("cluster").alias(cluster), F.lit(1).cast("long").alias("w")))  # draw 0: all once
    own = scored.select("model", cluster, F.col("p"), F.col(successes).alias("s"), F.col(trials).alias("n"))
    own = own.groupBy("model", cluster, "p").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    drawn = own.join(F.broadcast(w), cluster).withColumns({"s": F.col("w") * F.col("s"), "n": F.col("w") * F.col("n")})
    both = prediction_metrics(drawn, "s", "n", "model", "rep").join(prediction_auroc(drawn, "s", "n", "model", "rep"), ["model", "rep"])
    long = both.select("model", "rep", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("log_loss", "brier", "auc")])))
    other = long.where(F.col("model") == base).select("rep", "metric", F.col("value").alias("base"))
    diff = long.join(other, ["rep", "metric"]).withColumn("estimate", F.col("value") - F.col("base"))
    ends = interval(diff.where("rep > 0"), "model", "metric").select("model", "metric", "low", "high")
    return diff.where("rep = 0").select("model", "metric", "value", F.col("estimate").alias("delta")).join(ends, ["model", "metric"])


def improvements(deltas: DataFrame, base: str) -> DataFrame:
    """Deltas in points, signed so that more is better: losses change sign and their interval's ends change places."""
    sign = F.when(F.col("metric") == "auc", 100.0).otherwise(-100.0)
    low, high = sign * F.col("low"), sign * F.col("high")
    return deltas.where(F.col("model") != base).select("model", "metric", (sign * F.col("delta")).alias("estimate"), F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))


def bootstrap_models(items: DataFrame, cluster: str, analyses: dict[str, tuple[str, str, list[str]]], reps: int, flags: tuple[str, ...] = ("barrier",), ridge: float = 1e-4, salt: str = "m") -> DataFrame:
    """(analysis, rep, term, log_odds, ame): logistic fits of each analysis (successes, trials, terms) over draws of clusters; draw 0
    is the data as they are. Draws are made in Spark by hash; each analysis and draw is one group that a worker fits. Terms but
    flags are standardised on the items of the analysis, once and not in each draw. Items without trials take no part.
    """
    units = numbered(items.select(F.col(cluster).alias("cluster")).distinct(), "cluster")
    w = weights(replicates(items.sparkSession, reps), units.count(), salt).join(F.broadcast(units), "pos").select("rep", F.col("cluster").alias(cluster), "w")
    w = w.unionByName(units.select(F.lit(0).cast("long").alias("rep"), F.col("cluster").alias(cluster), F.lit(1).cast("long").alias("w")))
    terms = list(dict.fromkeys(t for *_, own in analyses.values() for t in own))
    drawn = None
    for name, (s, n, own) in analyses.items():
        z = standardised(items.where(F.col(n) > 0), [t for t in own if t not in flags])
        part = z.select(F.lit(name).alias("analysis"), cluster, F.col(s).cast("double").alias("s"), F.col(n).cast("double").alias("n"), *[(F.col(t if t in flags else f"z_{t}") if t in own else F.lit(None)).cast("double").alias(t) for t in terms])
        drawn = part if drawn is None else drawn.unionByName(part)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = analyses[key[0]][2]
        x, times = rows[own].to_numpy(float), rows["w"].to_numpy(float)
        s, n = times * rows["s"].to_numpy(), times * rows["n"].to_numpy()
        beta = logit_of(x, s, n, ridge)
        curve = lambda v: 1 / (1 + np.exp(-np.clip(beta[0] + v @ beta[1:], -35, 35)))
        p, effects = curve(x), []
        for k, t in enumerate(own):
            if t in flags:
                on, off = x.copy(), x.copy()
                on[:, k], off[:, k] = 1, 0
                each = curve(on) - curve(off)
            else:
                each = beta[k + 1] * p * (1 - p)
            effects.append(float((n * each).sum() / n.sum()))
        return pd.DataFrame({"analysis": key[0], "rep": key[1], "term": own, "log_odds": beta[1:], "ame": effects})

    both = drawn.join(F.broadcast(w), cluster)
    return both.groupBy("analysis", "rep").applyInPandas(fit, "analysis string, rep long, term string, log_odds double, ame double")


def model_intervals(draws: DataFrame) -> DataFrame:
    """(analysis, term, odds_ratio, or_low, or_high, ame, ame_low, ame_high, excludes_null) from bootstrap_models()."""
    odds = F.exp(F.greatest(F.least("log_odds", F.lit(30.0)), F.lit(-30.0)))
    point = draws.where("rep = 0").select("analysis", "term", odds.alias("odds_ratio"), "ame")
    ends = lambda c, name: interval(draws.where("rep > 0").withColumn("estimate", c), "analysis", "term").select("analysis", "term", F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
    out = point.join(ends(odds, "or"), ["analysis", "term"]).join(ends(F.col("ame"), "ame"), ["analysis", "term"])
    return out.withColumn("excludes_null", (F.col("or_high") < 1) | (F.col("or_low") > 1))


def effect_contrasts(draws: DataFrame, analysis: str, against: str, terms: list[str]) -> DataFrame:
    """(term, difference, low, high) of the marginal effects of one analysis less another's, on shared draws."""
    a, b = (draws.where((F.col("analysis") == x) & F.col("term").isin(*terms)).select("rep", "term", F.col("ame").alias(n)) for x, n in ((analysis, "a"), (against, "b")))
    diff = a.join(b, ["rep", "term"]).withColumn("estimate", F.col("a") - F.col("b"))
    ends = interval(diff.where("rep > 0"), "term").select("term", "low", "high")
    return diff.where("rep = 0").select("term", F.col("estimate").alias("difference")).join(ends, "term")


def two_way_effects(runs: DataFrame, endpoint: str = "signature") -> DataFrame:
    """Run effects of a balanced linear probability model with model and prompt effects, with two-way clustered errors.

    On a balanced panel an effect is the difference of run means and the residual is the cell less its item mean and run
    effect, so the covariance is three aggregates of residual sums: by model, by prompt, less by cell.
    """
    y = F.col(endpoint).cast("double")
    effects = runs.groupBy("run").agg(F.avg(y).alias("rate"))
    every = runs.agg(F.avg(y).alias("every"))
    item = Window.partitionBy("model", "prompt_id")
    e = runs.join(F.broadcast(effects), "run").crossJoin(F.broadcast(every)).withColumn("u", y - F.avg(y).over(item) - F.col("rate") + F.col("every"))
    n = runs.select(F.countDistinct("model", "prompt_id").alias("items"))
    base = effects.where("run = 1").select(F.col("rate").alias("r1"))

    def meat(name: str, *keys: str) -> DataFrame:
        sums = e.groupBy(*keys).agg(*[F.sum(F.when(F.col("run") == r, F.col("u")).when(F.col("run") == 1, -F.col("u")).otherwise(0.0)).alias(f"d{r}") for r in (2, 3)])
        g = sums.agg(F.count("*").alias("g"), F.sum(F.col("d2") ** 2).alias("v2"), F.sum(F.col("d3") ** 2).alias("v3")).crossJoin(n)
        scale = F.col("g") / (F.col("g") - 1) / F.col("items") / F.col("items")
        return g.select((F.col("v2") * scale).alias(f"{name}2"), (F.col("v3") * scale).alias(f"{name}3"))

    v = meat("a", "model").crossJoin(meat("b", "prompt_id")).crossJoin(meat("c", "model", "prompt_id"))
    var = F.when(F.col("run") == 2, F.col("a2") + F.col("b2") - F.col("c2")).otherwise(F.col("a3") + F.col("b3") - F.col("c3"))
    return effects.where("run > 1").crossJoin(F.broadcast(base)).crossJoin(F.broadcast(v)).select("run", (F.col("rate") - F.col("r1")).alias("effect"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"))


def hamming(cells: DataFrame, unit: str, item: str, flag: str) -> DataFrame:
    """(a, b, distance) of all pairs of units (models): the share of common items where flags differ."""
    own = cells.select(unit, item, flag)
    a, b = own.select(F.col(unit).alias("a"), item, F.col(flag).alias("fa")), own.select(F.col(unit).alias("b"), item, F.col(flag).alias("fb"))
    return a.join(b, item).where("a < b").groupBy("a", "b").agg(F.avg((F.col("fa") != F.col("fb")).cast("int")).alias("distance"))


def average_linkage(distances: DataFrame) -> DataFrame:
    """(step, left, right, height, size): agglomerative clustering of few units; ties go to the least ids."""
    rows = distances.collect()
    d = {frozenset((r.a, r.b)): r.distance for r in rows}
    size = {u: 1 for r in rows for u in (r.a, r.b)}
    out, new = [], max(size, default=-1) + 1
    while len(size) > 1:
        pairs = [(round(d[frozenset((a, b))], 12), a, b) for a in size for b in size if a < b]
        height, a, b = min(pairs)
        for c in size:
            if c not in (a, b):
                d[frozenset((new, c))] = (size[a] * d[frozenset((a, c))] + size[b] * d[frozenset((b, c))]) / (size[a] + size[b])
        size[new] = size.pop(a) + size.pop(b)
        out.append((len(out), int(a), int(b), float(height), size[new]))
        new += 1
    return distances.sparkSession.createDataFrame(out, "step int, left long, right long, height double, size long")


def nearest_pairs(distances: DataFrame, items: int, k: int = 12) -> DataFrame:
    """The k pairs of least distance, ties by names, and on how many of so many items they differ."""
    return distances.orderBy("distance", "a", "b").limit(k).withColumn("disagreements", F.bround(F.col("distance") * items, 0).cast("long"))


def leaf_order(linkage: DataFrame) -> list[int]:
    """The units from left to right below the last merge; a linkage has a row less than units, which are few."""
    rows = linkage.orderBy("step").collect()
    # merges are numbered on from the units, and every one but the last is merged again, so the largest number is known
    first = max((x for r in rows for x in (r.left, r.right)), default=0) - len(rows) + 2
    below: dict[int, list[int]] = {}
    for r in rows:
        below[first + r.step] = below.get(r.left, [r.left]) + below.get(r.right, [r.right])
    return below[first + rows[-1].step] if rows else []
