"""Regressions, cross-validation, effects, distances and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import fixed_effects as E
from ..operators import models as M
from ..operators import spectrum
from . import fixtures as D
from .cells_queries import r6, signatures
from .registry import query


def _grouped(spark, sf):
    rates = D.cells(spark, sf).groupBy("prompt_id").agg(X.ones(F.col("signature")).alias("s"), F.count("*").alias("n"))
    f = D.features(spark, sf).select("prompt_id", X.entropy(F.col("counts")).alias("entropy"), F.log1p("gates").alias("log_gates"), F.col("qubits").cast("double").alias("qubits"), F.map_contains_key("counts", "N").cast("double").alias("barrier"))
    return rates.join(F.broadcast(f), "prompt_id")




@query("ols_gram", """SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(qubits) AS DOUBLE) AS sx, round(sum(qubits * ln(1 + gates)), 4) AS sxz, round(sum(ln(1 + gates) * ln(1 + gates)), 4) AS szz, round(sum(qubits * rate), 4) AS sxy
 FROM (SELECT prompt_id, avg(CAST(signature AS INT)) AS rate FROM cells GROUP BY 1) JOIN features USING (prompt_id)""")
def _(spark, sf):
    g = M.gram(_grouped(spark, sf), [F.lit(1.0), F.col("qubits"), F.col("log_gates"), F.col("s") / F.col("n")])
    return spark.createDataFrame([tuple(round(float(x), 4) for x in (g[0, 0], g[0, 1], g[1, 2], g[2, 2], g[1, 3]))], "n double, sx double, sxz double, szz double, sxy double")


@query("ols_slope", "SELECT round(regr_slope(rate, qubits), 6) AS slope, round(regr_intercept(rate, qubits), 6) AS intercept, round(regr_r2(rate, qubits), 6) AS r2 FROM (SELECT prompt_id, avg(CAST(signature AS INT)) AS rate FROM cells GROUP BY 1) JOIN features USING (prompt_id)")
def _(spark, sf):
    fit = M.ols(_grouped(spark, sf), F.col("s") / F.col("n"), {"qubits": F.col("qubits")})
    return spark.createDataFrame([(round(float(fit.beta[1]), 6), round(float(fit.beta[0]), 6), round(fit.r2, 6))], "slope double, intercept double, r2 double")


@query("simple_regression", "SELECT round(regr_slope(rate, gates), 6) AS slope, round(regr_intercept(rate, gates), 6) AS intercept FROM (SELECT prompt_id, avg(CAST(signature AS INT)) AS rate FROM cells GROUP BY 1) JOIN features USING (prompt_id)")
def _(spark, sf):
    df = D.cells(spark, sf).groupBy("prompt_id").agg(F.avg(F.col("signature").cast("int")).alias("y")).join(F.broadcast(D.features(spark, sf)), "prompt_id")
    return r6(df.agg(F.regr_slope("y", "gates").alias("slope"), F.regr_intercept("y", "gates").alias("intercept")), "slope", "intercept")


def _terms():
    return {n: F.col(f"z_{n}") for n in ("entropy", "log_gates")} | {"barrier": F.col("barrier")}


#: Normal equations of rate on standardised entropy and size and the barrier, with the ridge, solved by Cramer's rule.
_OLS = """WITH e AS (SELECT prompt_id, -sum(n / t * ln(n / t)) AS entropy FROM (SELECT prompt_id, n, sum(n) OVER (PARTITION BY prompt_id) AS t FROM gatecounts) GROUP BY 1),
 f AS (SELECT prompt_id, rate, entropy, ln(1 + gates) AS lg, CAST(has_barrier AS INT) AS b FROM (SELECT prompt_id, avg(CAST(signature AS INT)) AS rate FROM cells GROUP BY 1) JOIN features USING (prompt_id) JOIN e USING (prompt_id)),
 z AS (SELECT rate, (entropy - avg(entropy) OVER ()) / coalesce(nullif(stddev_samp(entropy) OVER (), 0), 1) AS x1, (lg - avg(lg) OVER ()) / coalesce(nullif(stddev_samp(lg) OVER (), 0), 1) AS x2, b AS x3 FROM f),
 m AS (SELECT avg(rate) AS my, avg(x3) AS m3, count(*) AS n, sum(x1 * x1) + 1e-8 AS a11, sum(x1 * x2) AS a12, sum(x1 * (x3 - (SELECT avg(x3) FROM z))) AS a13, sum(x2 * x2) + 1e-8 AS a22, sum(x2 * (x3 - (SELECT avg(x3) FROM z))) AS a23, var_pop(x3) * count(*) + 1e-8 AS a33,
 sum(x1 * rate) AS b1, sum(x2 * rate) AS b2, sum((x3 - (SELECT avg(x3) FROM z)) * rate) AS b3 FROM z),
 d AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM m),
 w AS (SELECT my, m3, (b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3)) / det AS w1, (a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13)) / det AS w2,
 (a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13)) / det AS w3 FROM d)
 SELECT 'intercept' AS term, round(my - m3 * w3, 4) AS beta FROM w UNION ALL SELECT 'entropy', round(w1, 4) FROM w UNION ALL SELECT 'log_gates', round(w2, 4) FROM w UNION ALL SELECT 'barrier', round(w3, 4) FROM w"""


@query("ols_fit", _OLS)
def _(spark, sf):
    df = M.standardised(_grouped(spark, sf), ["entropy", "log_gates"])
    return M.ols(df, F.col("s") / F.col("n"), _terms()).frame(spark).select("term", F.round("beta", 4).alias("beta"))


@query("grouped_logit")
def _(spark, sf):
    df = M.standardised(_grouped(spark, sf), ["entropy", "log_gates"])
    return M.logit(df, F.col("s"), F.col("n"), _terms()).frame(spark)


# A fit of one term orders rows as the term does, or the other way round where the rate falls with it, so areas are those of ranks.
@query("fit_summary", """WITH r AS (SELECT prompt_id, count(*) FILTER (WHERE signature) AS s, count(*) AS n FROM cells GROUP BY 1), g AS (SELECT x, CAST(sum(s) AS DOUBLE) AS pos, CAST(sum(n - s) AS DOUBLE) AS neg FROM (SELECT s, n, CAST(n - s AS DOUBLE) AS f, CAST(gates AS DOUBLE) AS x FROM r JOIN features USING (prompt_id)) GROUP BY x),
 t AS (SELECT sum(pos) AS p, sum(neg) AS q, sum(pos * x) / sum(pos) >= sum(neg * x) / sum(neg) AS rising FROM g), a AS (SELECT sum(g.pos * (coalesce(b.below, 0) + g.neg / 2)) / (any_value(p) * any_value(q)) AS area, any_value(rising) AS rising FROM g JOIN (SELECT x, sum(neg) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM g) b USING (x), t)
 SELECT p + q AS n, round(p / (p + q), 6) AS positive_rate, round(p * ln(p / (p + q)) + q * ln(q / (p + q)), 4) AS null_log_likelihood, round(CASE WHEN a.rising THEN area ELSE 1 - area END, 6) AS auc FROM a, t""")
def _(spark, sf):
    df, term = _grouped(spark, sf).withColumn("gates", F.round(F.expm1("log_gates"))), {"gates": F.col("gates")}
    out = M.fit_summary(df, M.logit(df, F.col("s"), F.col("n"), term), term, F.col("s"), F.col("n"))
    return r6(out.select("n", "positive_rate", F.round("null_log_likelihood", 4).alias("null_log_likelihood"), "auc"), "positive_rate", "auc")


@query("marginal_effects")
def _(spark, sf):
    df = M.standardised(_grouped(spark, sf), ["entropy", "log_gates"])
    return M.marginal_effects(df, M.logit(df, F.col("s"), F.col("n"), _terms()), _terms(), F.col("n"), {"barrier"})


@query("logit_band")
def _(spark, sf):
    df = M.standardised(_grouped(spark, sf), ["entropy", "log_gates"])
    return M.prediction_band(df, M.logit(df, F.col("s"), F.col("n"), _terms(), ridge=0.0), _terms()).select("prompt_id", "p", "low", "high")


#: Terms of the models that are compared.
SPECS = {
    "size_only": ["log_gates", "qubits", "clbits"],
    "entropy_plus_barrier": ["entropy", "log_gates", "qubits", "clbits", "barrier"],
    "gate_type_plus_barrier": ["types", "log_gates", "qubits", "clbits", "barrier"],
}
FOLDS, CV_REPS, MODEL_REPS = 10, 200, 2000


def _items(spark, sf):
    """(prompt_id, terms, sig): prompts with all terms of SPECS and their signature."""
    f = D.features(spark, sf)
    out = f.select("prompt_id", X.entropy(F.col("counts")).alias("entropy"), F.col("types").cast("double").alias("types"), F.log1p("gates").alias("log_gates"), F.col("qubits").cast("double").alias("qubits"), F.col("clbits").cast("double").alias("clbits"), F.map_contains_key("counts", "N").cast("double").alias("barrier"))
    return out.join(signatures(spark, sf), "prompt_id")


def _folded(spark, sf):
    cells = D.cells(spark, sf).join(F.broadcast(_items(spark, sf)), "prompt_id").withColumns({"s": F.col("signature").cast("int"), "n": F.lit(1)})
    clusters = cells.groupBy("sig").agg(F.countDistinct("prompt_id").alias("prompts"), F.count("*").alias("cells"), F.sum("s").alias("positives"))
    return cells.join(F.broadcast(M.folds(clusters, "sig", "prompts", "cells", "positives", FOLDS)), "sig")


def _cross_validated(spark, sf):
    terms = list(dict.fromkeys(t for own in SPECS.values() for t in own))
    own = _folded(spark, sf).select("model", "sig", "fold", "s", "n", *terms).withColumnRenamed("model", "unit")
    return M.cross_validate(own, "fold", "s", "n", SPECS, FOLDS, units="unit")


@query("grouped_folds")
def _(spark, sf):
    return _folded(spark, sf).groupBy("fold").agg(F.countDistinct("sig").alias("clusters"), F.countDistinct("prompt_id").alias("prompts"), F.count("*").alias("cells"), F.avg("s").alias("rate"))


@query("grouped_cv")
def _(spark, sf):
    scored = _cross_validated(spark, sf).persist()
    return M.prediction_metrics(scored, "s", "n", "model").join(M.prediction_auroc(scored, "s", "n", "model"), "model")


@query("cv_improvements")
def _(spark, sf):
    return M.improvements(M.cv_deltas(_cross_validated(spark, sf), "sig", "s", "n", "size_only", CV_REPS), "size_only")


#: Prompts of this panel that can't be told from their text.
UNIDENTIFIABLE = (3, 50, 77, 120)


def _model_draws(spark, sf):
    cells = D.cells(spark, sf)
    e, m = F.col("execution"), F.col("signature")
    kept = ~F.col("prompt_id").isin(*UNIDENTIFIABLE)
    sums = cells.groupBy("prompt_id").agg(F.count("*").alias("n"), X.ones(m).alias("s"), X.ones(e).alias("e"), X.ones(m & e).alias("m_e"))
    items = sums.join(F.broadcast(_items(spark, sf)), "prompt_id").withColumns({"n_kept": F.when(kept, F.col("n")).otherwise(0), "s_kept": F.when(kept, F.col("s")).otherwise(0)})
    whole, types = SPECS["entropy_plus_barrier"], SPECS["gate_type_plus_barrier"]
    analyses = {
        "signature_entropy": ("s", "n", whole), "signature_types": ("s", "n", types), "execution_entropy": ("e", "n", whole),
        "signature_given_execution": ("m_e", "e", whole), "signature_entropy_identifiable": ("s_kept", "n_kept", whole),
    }
    return M.bootstrap_models(items, "sig", analyses, MODEL_REPS)


@query("inferential_models")
def _(spark, sf):
    return M.model_intervals(_model_draws(spark, sf).persist())


@query("two_stage_contrasts")
def _(spark, sf):
    return M.effect_contrasts(_model_draws(spark, sf).persist(), "signature_given_execution", "execution_entropy", ["entropy", "barrier"])


_MEAT = "SELECT sum(d2 * d2) * count(*) / (count(*) - 1) AS v2, sum(d3 * d3) * count(*) / (count(*) - 1) AS v3 FROM (SELECT sum(CASE run WHEN 2 THEN u WHEN 1 THEN -u ELSE 0 END) AS d2, sum(CASE run WHEN 3 THEN u WHEN 1 THEN -u ELSE 0 END) AS d3 FROM e GROUP BY {})"
_FE = f"""WITH y AS (SELECT *, CAST(signature AS INT) AS v FROM runs), e AS (SELECT model, prompt_id, run, v - avg(v) OVER (PARTITION BY model, prompt_id) - avg(v) OVER (PARTITION BY run) + avg(v) OVER () AS u FROM y),
 n AS (SELECT count(*) / 3 AS items FROM y), a AS ({_MEAT.format("model")}), b AS ({_MEAT.format("prompt_id")}), c AS ({_MEAT.format("model, prompt_id")}), r AS (SELECT run, avg(v) AS rate FROM y GROUP BY run)
 SELECT r.run, round(r.rate - o.rate, 6) AS effect, round(sqrt(greatest(CASE r.run WHEN 2 THEN a.v2 + b.v2 - c.v2 ELSE a.v3 + b.v3 - c.v3 END, 0)) / items, 6) AS se FROM r, r o, a, b, c, n WHERE o.run = 1 AND r.run > 1"""


@query("two_way_fe", _FE)
def _(spark, sf):
    return r6(M.two_way_effects(D.runs(spark, sf)), "effect", "se")


#: Draws for the tests of run effects.
EFFECT_REPS = 1000
_CONTRAST = "SELECT {b} AS b, {a} AS a, sum(d * d) * count(*) / (count(*) - 1) AS v FROM (SELECT sum(CASE run WHEN {b} THEN u WHEN {a} THEN -u ELSE 0 END) AS d FROM e GROUP BY {keys})"
_VAR = " UNION ALL ".join(f"SELECT {s} AS sign, * FROM ({_CONTRAST.format(a=a, b=b, keys=k)})" for s, k in ((1, "model"), (1, "prompt_id"), (-1, "model, prompt_id")) for b, a in ((2, 1), (3, 1), (3, 2)))
_SIDE = "{c}u AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS pos, count(*) OVER () AS size FROM (SELECT DISTINCT {c} FROM y)), {s}w AS (SELECT rep, {rnd} % size AS pos, count(*) AS w FROM (SELECT unnest(range(1, {n})) AS rep) CROSS JOIN (SELECT pos AS i, size FROM {c}u) GROUP BY 1, 2)"
_SIDES = ", ".join(_SIDE.format(c=c, s=s, n=EFFECT_REPS + 1, rnd=f"CAST(('0x' || substr(sha256('{s}' || rep || ':' || i), 1, 8)) AS BIGINT)") for c, s in (("model", "l"), ("prompt_id", "r")))
#: On a panel whose items have all runs, effects are differences of rates, and only what an item's runs differ by enters the errors.
_EFFECTS = f"""WITH y AS (SELECT *, CAST(signature AS INT) AS v FROM runs), e AS (SELECT model, prompt_id, run, v - avg(v) OVER (PARTITION BY model, prompt_id) - avg(v) OVER (PARTITION BY run) + avg(v) OVER () AS u FROM y),
 k AS (SELECT count(*) AS n, count(*) / 3 AS items, count(DISTINCT model) + count(DISTINCT prompt_id) + 1 AS k FROM y), r AS (SELECT run, avg(v) AS rate FROM y GROUP BY run),
 c AS (SELECT 'run ' || b || ' vs run ' || a AS contrast, b, a, sqrt(greatest(sum(sign * v) * any_value((n - 1) / (n - k)), 0)) / any_value(items) AS se FROM ({_VAR}), k GROUP BY b, a),
 t AS (SELECT c.*, x.rate - z.rate AS estimate FROM c JOIN r x ON x.run = b JOIN r z ON z.run = a), {_SIDES},
 s AS (SELECT model, prompt_id, run, sum(v) AS x, count(*) AS n FROM y GROUP BY 1, 2, 3), d AS (SELECT lw.rep, run, sum(lw.w * rw.w * x) / sum(lw.w * rw.w * n) AS rate FROM lw JOIN modelu USING (pos) JOIN s USING (model) JOIN prompt_idu USING (prompt_id) JOIN rw ON rw.rep = lw.rep AND rw.pos = prompt_idu.pos GROUP BY 1, 2),
 g AS (SELECT t.contrast, p.rep, p.rate - q.rate AS delta, avg(p.rate - q.rate) OVER (PARTITION BY t.contrast) AS mean, t.estimate, t.se FROM t JOIN d p ON p.run = t.b JOIN d q ON q.run = t.a AND q.rep = p.rep),
 j AS (SELECT rep, round(sqrt(sum((delta - mean) * (delta - mean))), 9) AS size FROM g WHERE contrast LIKE '%vs run 1' GROUP BY rep), o AS (SELECT sqrt(sum(estimate * estimate)) AS seen FROM t WHERE a = 1)
 SELECT contrast, round(any_value(estimate), 6) AS estimate, round(any_value(se), 6) AS se, round(quantile_cont(delta, 0.025::DOUBLE), 6) AS low, round(quantile_cont(delta, 0.975::DOUBLE), 6) AS high, round((count(*) FILTER (WHERE round(abs(delta - mean), 9) >= round(abs(estimate), 9)) + 1) / (count(*) + 1), 6) AS p FROM g GROUP BY contrast
 UNION ALL SELECT 'all runs', round(any_value(seen), 6), NULL, NULL, NULL, round((count(*) FILTER (WHERE size >= round(seen, 9)) + 1) / (count(*) + 1), 6) FROM j, o"""


@query("run_effects", _EFFECTS)
def _(spark, sf):
    runs, hit = D.runs(spark, sf), F.col("signature").cast("int")
    out = E.tested(E.fit(runs, hit), E.crossed_rates(runs, hit, EFFECT_REPS))
    return r6(out, "estimate", "se", "low", "high", "p")


@query("pca_scores")
def _(spark, sf):
    return spectrum.scores(D.cells(spark, sf), "model", "prompt_id", F.col("signature").cast("int"))


@query("hamming_pairs", "SELECT p.model AS a, q.model AS b, round(avg(CAST(p.signature <> q.signature AS INT)), 6) AS distance FROM cells p JOIN cells q ON p.prompt_id = q.prompt_id AND p.model < q.model GROUP BY 1, 2")
def _(spark, sf):
    return r6(M.hamming(D.cells(spark, sf), "model", "prompt_id", "signature"), "distance")


@query("average_linkage")
def _(spark, sf):
    return M.average_linkage(M.hamming(D.cells(spark, sf), "model", "prompt_id", "signature"))


@query("nearest_pairs", """SELECT a, b, round(distance, 6) AS distance, CAST(round_even(distance * 154, 0) AS BIGINT) AS disagreements FROM (SELECT p.model AS a, q.model AS b, avg(CAST(p.signature <> q.signature AS INT)) AS distance FROM cells p JOIN cells q ON p.prompt_id = q.prompt_id AND p.model < q.model GROUP BY 1, 2) ORDER BY round(distance, 9), a, b LIMIT 12""")
def _(spark, sf):
    d = M.hamming(D.cells(spark, sf), "model", "prompt_id", "signature").withColumn("distance", F.round("distance", 9))
    return r6(M.nearest_pairs(d, 154), "distance")


@query("cluster_leaves")
def _(spark, sf):
    leaves = M.leaf_order(M.average_linkage(M.hamming(D.cells(spark, sf), "model", "prompt_id", "signature")))
    return spark.createDataFrame(list(enumerate(leaves)), "pos int, model long")
