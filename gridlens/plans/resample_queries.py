"""Bootstrap intervals, permutation tests and post-stratified rates; the draws are the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import agreement as A
from ..operators import models as M
from ..operators import resample as R
from . import fixtures as D
from .cells_queries import _SIG, r6, signatures
from .registry import query

#: Draws of bootstraps and permutations, of sign flips, and of ranks.
REPS, FLIPS, RANK_REPS = 5000, 50_000, 2000
_RND = "CAST(('0x' || substr(sha256({}), 1, 8)) AS BIGINT)"
_CL = f"s AS ({_SIG}), cs AS (SELECT sig, count(*) FILTER (WHERE signature) AS x, count(*) AS n FROM cells JOIN s USING (prompt_id) GROUP BY 1), un AS (SELECT *, row_number() OVER (ORDER BY sig) - 1 AS pos, count(*) OVER () AS size FROM cs)"
_WT = "SELECT rep, {rnd} % size AS pos, count(*) AS w FROM (SELECT unnest(range(1, {reps})) AS rep) CROSS JOIN (SELECT pos AS i, size FROM {units}) GROUP BY 1, 2".replace("{reps}", str(REPS + 1))
_CI = "count(estimate) AS reps, round(avg(estimate), 6) AS mean, round(quantile_cont(estimate, 0.025::DOUBLE), 6) AS low, round(quantile_cont(estimate, 0.975::DOUBLE), 6) AS high"


def _sums(spark, sf):
    sums = D.cells(spark, sf).join(F.broadcast(signatures(spark, sf)), "prompt_id").groupBy(F.col("sig").alias("cluster"))
    return sums.agg(X.ones(F.col("signature")).alias("x"), F.count("*").alias("n"))


@query("cluster_bootstrap_ci", f"WITH {_CL}, wt AS ({_WT.format(rnd=_RND.format(chr(39) * 2 + ' || rep || ' + repr(':') + ' || i'), units='un')}), es AS (SELECT rep, sum(w * x) / sum(w * n) AS estimate FROM wt JOIN un USING (pos) GROUP BY rep) SELECT {_CI} FROM es")
def _(spark, sf):
    return r6(R.interval(R.cluster_bootstrap(_sums(spark, sf), REPS)), "mean", "low", "high")


_XB = f"""s AS ({_SIG}), sm AS (SELECT model, sig, count(*) FILTER (WHERE signature) AS x, count(*) AS n FROM cells JOIN s USING (prompt_id) GROUP BY 1, 2),
 lu AS (SELECT model, row_number() OVER (ORDER BY model) - 1 AS pos, count(*) OVER () AS size FROM (SELECT DISTINCT model FROM sm)), ru AS (SELECT sig, row_number() OVER (ORDER BY sig) - 1 AS pos, count(*) OVER () AS size FROM (SELECT DISTINCT sig FROM sm)),
 wl AS ({_WT.format(rnd=_RND.format("'l' || rep || ':' || i"), units='lu')}), wr AS ({_WT.format(rnd=_RND.format("'r' || rep || ':' || i"), units='ru')}),
 es AS (SELECT wl.rep, sum(wl.w * wr.w * x) / sum(wl.w * wr.w * n) AS estimate FROM wl JOIN lu USING (pos) JOIN sm USING (model) JOIN ru ON ru.sig = sm.sig JOIN wr ON wr.rep = wl.rep AND wr.pos = ru.pos GROUP BY wl.rep)"""


@query("crossed_bootstrap_ci", f"WITH {_XB} SELECT {_CI} FROM es")
def _(spark, sf):
    sums = D.cells(spark, sf).join(F.broadcast(signatures(spark, sf)), "prompt_id").groupBy(F.col("model").alias("left"), F.col("sig").alias("right"))
    return r6(R.interval(R.crossed_bootstrap(sums.agg(X.ones(F.col("signature")).alias("x"), F.count("*").alias("n")), REPS)), "mean", "low", "high")


@query("sign_flip_p", f"""WITH d AS (SELECT prompt_id, sum(CAST(signature AS INT)) FILTER (WHERE model = 1) - sum(CAST(signature AS INT)) FILTER (WHERE model = 2) AS d FROM cells WHERE model IN (1, 2) GROUP BY 1 HAVING count(*) = 2),
 u AS (SELECT *, row_number() OVER (ORDER BY prompt_id) - 1 AS pos FROM d), f AS (SELECT rep, abs(sum(CASE WHEN {_RND.format("rep || ':' || pos")} % 2 = 0 THEN d ELSE -d END)) AS s FROM (SELECT unnest(range(1, {FLIPS + 1})) AS rep) CROSS JOIN u GROUP BY rep)
 SELECT CAST((SELECT abs(sum(d)) FROM u) AS BIGINT) AS observed, round((count(*) FILTER (WHERE s >= (SELECT abs(sum(d)) FROM u)) + 1) / {FLIPS + 1}.0, 6) AS p FROM f""")
def _(spark, sf):
    at = lambda m: F.sum(F.when(F.col("model") == m, F.col("signature").cast("int")))
    d = D.cells(spark, sf).where("model in (1, 2)").groupBy(F.col("prompt_id").alias("cluster")).agg((at(1) - at(2)).alias("d"), F.count("*").alias("n")).where("n = 2").select("cluster", "d")
    return r6(R.sign_flip(d, FLIPS), "p")


_RK = "sr AS (SELECT prompt_id, any_value(gates) AS gates, avg(CAST(signature AS INT)) AS rate FROM cells JOIN features USING (prompt_id) GROUP BY 1), rk AS (SELECT prompt_id, rank() OVER (ORDER BY gates) + (count(*) OVER (PARTITION BY gates) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0::DOUBLE AS ry FROM sr)"


@query("permutation_p", f"""WITH {_RK}, u AS (SELECT *, row_number() OVER (ORDER BY prompt_id) - 1 AS pos FROM rk), g AS (SELECT rep, u.*, row_number() OVER (PARTITION BY rep ORDER BY sha256(rep || ':' || pos)) - 1 AS to_ FROM (SELECT unnest(range(1, {REPS + 1})) AS rep) CROSS JOIN u),
 c AS (SELECT rep, round(abs(corr(g.rx, o.ry)), 9) AS r FROM g JOIN u o ON o.pos = g.to_ GROUP BY rep), o AS (SELECT round(abs(corr(rx, ry)), 9) AS observed FROM u)
 SELECT round((SELECT observed FROM o), 6) AS observed, round((count(*) FILTER (WHERE r >= (SELECT observed FROM o)) + 1) / {REPS + 1}.0, 6) AS p FROM c""")
def _(spark, sf):
    rates = D.cells(spark, sf).groupBy("prompt_id").agg(F.avg(F.col("signature").cast("int")).alias("rate")).join(D.features(spark, sf), "prompt_id")
    ranks = rates.select("prompt_id", X.average_rank(F.col("gates")).alias("rx"), X.average_rank(F.col("rate")).alias("ry"))
    return r6(R.permutation_correlation(ranks, "prompt_id", "rx", "ry", REPS), "observed", "p")


_BR = f"""s AS ({_SIG}), sm AS (SELECT model, sig, count(*) FILTER (WHERE signature) AS x, count(*) AS n FROM cells JOIN s USING (prompt_id) GROUP BY 1, 2), un AS (SELECT sig, row_number() OVER (ORDER BY sig) - 1 AS pos, count(*) OVER () AS size FROM (SELECT DISTINCT sig FROM sm)),
 wt AS ({_WT.format(rnd=_RND.format("'b' || rep || ':' || i"), units='un').replace(str(REPS + 1), str(RANK_REPS + 1))}), es AS (SELECT rep, model, round(sum(w * x) / sum(w * n), 9) AS estimate FROM wt JOIN un USING (pos) JOIN sm USING (sig) GROUP BY 1, 2),
 rr AS (SELECT *, CAST(rank() OVER (PARTITION BY rep ORDER BY estimate DESC) AS DOUBLE) AS r FROM es)"""


def _model_scores(spark, sf):
    """Models' rates in replicates that draw signatures, and as they are."""
    sums = D.cells(spark, sf).join(F.broadcast(signatures(spark, sf)), "prompt_id").groupBy("model", "sig").agg(X.ones(F.col("signature")).alias("x"), F.count("*").alias("n"))
    units = R.numbered(sums.select("sig").distinct(), "sig")
    w = R.weights(R.replicates(spark, RANK_REPS), units.count(), "b").join(F.broadcast(units), "pos")
    rates = w.join(F.broadcast(sums), "sig").groupBy("rep", "model").agg(F.round(F.sum(F.col("w") * F.col("x")) / F.sum(F.col("w") * F.col("n")), 9).alias("estimate"))
    return rates, sums.groupBy("model").agg(F.round(F.sum("x") / F.sum("n"), 9).alias("score"))


@query("bootstrap_ranks", f"WITH {_BR} SELECT model, round(median(r), 6) AS median_rank, round(quantile_cont(r, 0.025::DOUBLE), 6) AS low, round(quantile_cont(r, 0.975::DOUBLE), 6) AS high, round(avg(CAST(r <= 3 AS INT)), 6) AS in_top3, round(avg(CAST(r <= 5 AS INT)), 6) AS in_top5 FROM rr GROUP BY model")
def _(spark, sf):
    rates = _model_scores(spark, sf)[0]
    return r6(R.bootstrap_ranks(rates, "model", "estimate"), "median_rank", "low", "high", "in_top3", "in_top5")


_AVERAGE = lambda c, of, within="": f"rank() OVER ({within} ORDER BY {c}) + (count(*) OVER (PARTITION BY {of}{c.removesuffix(' DESC')}) - 1) / 2.0::DOUBLE"
_SCORES = f"{_BR}, ob AS (SELECT model, round(sum(x) / sum(n), 9) AS score FROM sm GROUP BY 1)"


@query("bootstrap_scores", f"""WITH {_SCORES}, ar AS (SELECT *, {_AVERAGE('estimate DESC', 'rep, ', 'PARTITION BY rep')} AS a FROM es), o2 AS (SELECT *, {_AVERAGE('score DESC', '')} AS rank FROM ob)
 SELECT model, round(any_value(score), 6) AS score, any_value(rank) AS rank, round(quantile_cont(estimate, 0.025::DOUBLE), 6) AS score_low, round(quantile_cont(estimate, 0.975::DOUBLE), 6) AS score_high, median(a) AS rank_median, round(quantile_cont(a, 0.025::DOUBLE), 6) AS rank_low, round(quantile_cont(a, 0.975::DOUBLE), 6) AS rank_high,
 round(avg(CAST(a <= 3 AS INT)), 6) AS top3, round(avg(CAST(a <= 5 AS INT)), 6) AS top5 FROM ar JOIN o2 USING (model) GROUP BY model""")
def _(spark, sf):
    out = R.bootstrap_scores(*_model_scores(spark, sf), "model")
    return r6(out, *out.columns[1:])


@query("bootstrap_rank_correlation", f"""WITH {_SCORES}, ar AS (SELECT *, {_AVERAGE('estimate', 'rep, ', 'PARTITION BY rep')} AS a FROM es), o2 AS (SELECT *, {_AVERAGE('score', '')} AS rank FROM ob), c AS (SELECT rep, corr(a, rank) AS estimate FROM ar JOIN o2 USING (model) GROUP BY rep) SELECT {_CI} FROM c""")
def _(spark, sf):
    return r6(R.interval(R.rank_correlations(*_model_scores(spark, sf), "model")), "mean", "low", "high")


@query("poststratified_rates", """WITH b AS (SELECT prompt_id, CASE WHEN types <= 2 THEN '1-2' WHEN types <= 4 THEN '3-4' ELSE '5+' END AS bin FROM features), e AS (SELECT run, bin, avg(CAST(signature AS INT)) AS rate FROM runs JOIN b USING (prompt_id) GROUP BY 1, 2)
 SELECT run, round(sum(rate * share) / sum(share), 6) AS rate FROM (SELECT *, CASE bin WHEN '1-2' THEN 42.0 WHEN '3-4' THEN 85.0 ELSE 27.0 END AS share FROM e) GROUP BY run""")
def _(spark, sf):
    bins = D.features(spark, sf).select("prompt_id", X.bins(F.col("types"), *X.TYPE_BINS).alias("bin"))
    return r6(R.poststratified(D.runs(spark, sf), bins, F.col("signature"), {"1-2": 42.0, "3-4": 85.0, "5+": 27.0}, "run"), "rate")


#: Prompts of the whole set by bin of gate types. Draws of their bootstrap.
BIN_COUNTS, STRATA_REPS = {"1-2": 42.0, "3-4": 85.0, "5+": 27.0}, 1000
#: In this panel, where a prompt has at most three types of gate, its number stands for the bin.
_BY_ID = "CASE prompt_id % 3 WHEN 0 THEN '1-2' WHEN 1 THEN '3-4' ELSE '5+' END"
_DRAWN = "SELECT rep, {key}, count(*) AS w FROM (SELECT rep, {rnd} % size AS pos, {by} FROM (SELECT unnest(range(1, 1001)) AS rep) CROSS JOIN (SELECT pos AS i, size, {by} FROM {units})) JOIN {units} USING (pos, {by}) GROUP BY 1, 2"


@query("poststratified_bootstrap", f"""WITH sm AS (SELECT model, prompt_id, run, {_BY_ID} AS bin, sum(CAST(signature AS INT)) AS x, count(*) AS n FROM runs GROUP BY 1, 2, 3),
 mu AS (SELECT model, row_number() OVER (ORDER BY model) - 1 AS pos, count(*) OVER () AS size, 'm' AS salt FROM (SELECT DISTINCT model FROM sm)), pu AS (SELECT prompt_id, row_number() OVER (PARTITION BY bin ORDER BY prompt_id) - 1 AS pos, count(*) OVER (PARTITION BY bin) AS size, bin AS salt FROM (SELECT DISTINCT prompt_id, bin FROM sm)),
 wm AS ({_DRAWN.format(key='model', units='mu', by='salt', rnd=_RND.format("salt || rep || ':' || i"))}), wp AS ({_DRAWN.format(key='prompt_id', units='pu', by='salt', rnd=_RND.format("salt || rep || ':' || i"))}),
 es AS (SELECT rep, run, bin, sum(wm.w * wp.w * x) / sum(wm.w * wp.w * n) AS rate FROM wm JOIN sm USING (model) JOIN wp USING (rep, prompt_id) GROUP BY 1, 2, 3),
 st AS (SELECT rep, run, sum(rate * CASE bin WHEN '1-2' THEN 42.0::DOUBLE WHEN '3-4' THEN 85.0 ELSE 27.0 END / 154) AS estimate FROM es GROUP BY 1, 2) SELECT run, {_CI} FROM st GROUP BY run""")
def _(spark, sf):
    runs = D.runs(spark, sf)
    name = F.when(F.col("prompt_id") % 3 == 0, "1-2").when(F.col("prompt_id") % 3 == 1, "3-4").otherwise("5+")
    bins = runs.select("prompt_id").distinct().withColumn("bin", name)
    return r6(R.interval(R.poststratified_bootstrap(runs, bins, F.col("signature").cast("int"), BIN_COUNTS, STRATA_REPS, "run"), "run"), "mean", "low", "high")


# --------------------------------------------------------------------------------------------- means, cohorts, two groups


_PR = "pr AS (SELECT prompt_id AS unit, avg(CAST(signature AS INT)) AS x FROM cells GROUP BY 1)"


def _prompt_rates(spark, sf):
    return D.cells(spark, sf).groupBy(F.col("prompt_id").alias("unit")).agg(F.avg(F.col("signature").cast("int")).alias("x"))


def _side(name: str, salt: str, where: str) -> str:
    units = f"{name}u AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS pos, count(*) OVER () AS size FROM pr WHERE {where})"
    drawn = _WT.format(rnd=_RND.format(f"'{salt}' || rep || ':' || i"), units=f"{name}u")
    return f"{units}, {name}w AS ({drawn}), {name}m AS (SELECT rep, sum(w * x) / sum(w) AS m FROM {name}w JOIN {name}u USING (pos) GROUP BY rep)"


@query("iid_bootstrap_mean", f"WITH {_PR}, {_side('a', '', 'true')} SELECT count(m) AS reps, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025::DOUBLE), 6) AS low, round(quantile_cont(m, 0.975::DOUBLE), 6) AS high FROM am")
def _(spark, sf):
    one = _prompt_rates(spark, sf).select(F.col("unit").alias("cluster"), "x", F.lit(1).alias("n"))
    return r6(R.interval(R.cluster_bootstrap(one, REPS)), "mean", "low", "high")


@query("iid_bootstrap_difference", f"WITH {_PR}, {_side('a', 'a', 'unit % 3 = 0')}, {_side('b', 'b', 'unit % 3 <> 0')}, es AS (SELECT am.m - bm.m AS estimate FROM am JOIN bm USING (rep)) SELECT {_CI} FROM es")
def _(spark, sf):
    x = _prompt_rates(spark, sf)
    return r6(R.interval(R.iid_difference(x.where("unit % 3 = 0"), x.where("unit % 3 <> 0"), REPS)), "mean", "low", "high")


@query("permutation_mean_p", f"""WITH {_PR}, u AS (SELECT *, unit % 3 = 0 AS observed, row_number() OVER (ORDER BY unit) - 1 AS pos FROM pr), o AS (SELECT count(*) FILTER (WHERE observed) AS n, abs(avg(x) FILTER (WHERE observed) - avg(x) FILTER (WHERE NOT observed)) AS actual FROM u),
 d AS (SELECT rep, x, row_number() OVER (PARTITION BY rep ORDER BY sha256(rep || ':' || pos)) AS to_ FROM (SELECT unnest(range(1, {REPS + 1})) AS rep) CROSS JOIN u), g AS (SELECT rep, abs(avg(x) FILTER (WHERE to_ <= n) - avg(x) FILTER (WHERE to_ > n)) AS delta, any_value(actual) AS actual FROM d, o GROUP BY rep)
 SELECT round(max(actual), 6) AS difference, round((count(*) FILTER (WHERE delta >= actual - 1e-9) + 1) / {REPS + 1}.0, 6) AS p FROM g""")
def _(spark, sf):
    return r6(R.permutation_means(_prompt_rates(spark, sf).withColumn("observed", F.col("unit") % 3 == 0), REPS), "difference", "p")


@query("cohen_d", f"WITH {_PR}, g AS (SELECT count(*) FILTER (WHERE o) AS na, count(*) FILTER (WHERE NOT o) AS nb, avg(x) FILTER (WHERE o) AS ma, avg(x) FILTER (WHERE NOT o) AS mb, var_samp(x) FILTER (WHERE o) AS va, var_samp(x) FILTER (WHERE NOT o) AS vb FROM (SELECT *, unit < 70 AS o FROM pr)) SELECT na, nb, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM g")
def _(spark, sf):
    return r6(R.cohen_d(_prompt_rates(spark, sf), F.col("unit") < 70, "x"), "d")


@query("phi_coefficients", "SELECT p.model AS a, q.model AS b, round(corr(CAST(p.signature AS INT), CAST(q.signature AS INT)), 6) AS phi FROM cells p JOIN cells q ON p.prompt_id = q.prompt_id AND p.model < q.model GROUP BY 1, 2")
def _(spark, sf):
    own = D.cells(spark, sf).select("model", "prompt_id", "signature")
    a, b = own.toDF("a", "prompt_id", "x"), own.toDF("b", "prompt_id", "y")
    return r6(R.phi(a.join(b, "prompt_id").where("a < b"), F.col("x"), F.col("y"), "a", "b"), "phi")


@query("line_prediction", f"""WITH {_PR}, j AS (SELECT CAST(gates AS DOUBLE) AS g, x FROM pr JOIN features ON prompt_id = unit), f AS (SELECT regr_slope(x, g) AS slope, regr_intercept(x, g) AS intercept FROM j)
 SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(sqrt((SELECT avg(pow(x - intercept - slope * g, 2)) FROM j)), 6) AS rmse, round(least(1, greatest(0, intercept + slope * 200)), 6) AS predicted FROM f""")
def _(spark, sf):
    rows = _prompt_rates(spark, sf).join(D.features(spark, sf).select(F.col("prompt_id").alias("unit"), F.col("gates").cast("double").alias("g")), "unit")
    return r6(R.line_prediction(rows, "g", "x", 200.0), "slope", "intercept", "rmse", "predicted")


_CO = "co AS (SELECT model, avg(CAST(signature AS INT)) FILTER (WHERE prompt_id < 70) AS pilot, avg(CAST(signature AS INT)) FILTER (WHERE prompt_id >= 70) AS extension FROM cells GROUP BY 1)"


@query("rank_replication", f"""WITH {_CO}, rk AS (SELECT *, rank() OVER (ORDER BY pilot) + (count(*) OVER (PARTITION BY pilot) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY extension) + (count(*) OVER (PARTITION BY extension) - 1) / 2.0::DOUBLE AS ry FROM co)
 SELECT count(*) AS models, round(corr(rx, ry), 6) AS spearman, round(median(extension - pilot), 6) AS median_change, count(*) FILTER (WHERE extension > pilot) AS improving, count(*) FILTER (WHERE extension < pilot) AS declining, count(*) FILTER (WHERE extension = pilot) AS tied FROM rk""")
def _(spark, sf):
    x = F.col("signature").cast("int")
    co = D.cells(spark, sf).groupBy("model").agg(F.avg(F.when(F.col("prompt_id") < 70, x)).alias("pilot"), F.avg(F.when(F.col("prompt_id") >= 70, x)).alias("extension"))
    change = F.col("extension") - F.col("pilot")
    sums = co.agg(F.count("*").alias("models"), F.percentile(change, F.lit(0.5)).alias("median_change"), X.ones(change > 0).alias("improving"), X.ones(change < 0).alias("declining"), X.ones(change == 0).alias("tied"))
    return r6(sums.crossJoin(A.spearman(co, "pilot", "extension").select("spearman")), "spearman", "median_change")


@query("cohort_bootstrap")
def _(spark, sf):
    """Of each cohort: rates of execution and signature, their gap, and odds ratios of entropy and barrier, with intervals."""
    from .models_queries import SPECS, _items

    cells = D.cells(spark, sf)
    sums = cells.groupBy("prompt_id").agg(F.count("*").alias("n"), X.ones(F.col("signature")).alias("s"), X.ones(F.col("execution")).alias("e")).join(F.broadcast(_items(spark, sf)), "prompt_id")
    out = None
    for cohort, where in (("pilot", "prompt_id < 70"), ("extension", "prompt_id >= 70")):
        own = sums.where(where)
        draws = M.bootstrap_models(own, "sig", {"signature": ("s", "n", SPECS["entropy_plus_barrier"])}, RANK_REPS, salt=cohort)
        odds = M.model_intervals(draws).where("term in ('entropy', 'barrier')").select(F.concat("term", F.lit("_odds_ratio")).alias("metric"), F.col("odds_ratio").alias("value"), F.col("or_low").alias("low"), F.col("or_high").alias("high"))
        parts = [odds]
        for metric, x in (("execution_rate", F.col("e")), ("signature_rate", F.col("s")), ("gap", F.col("e") - F.col("s"))):
            each = own.groupBy(F.col("sig").alias("cluster")).agg(F.sum(x).alias("x"), F.sum("n").alias("n"))
            point = each.agg((F.sum("x") / F.sum("n")).alias("value"))
            parts.append(R.interval(R.cluster_bootstrap(each, RANK_REPS, cohort)).crossJoin(point).select(F.lit(metric).alias("metric"), "value", "low", "high"))
        for p in parts:
            p = p.select(F.lit(cohort).alias("cohort"), *p.columns)
            out = p if out is None else out.unionByName(p)
    return out
