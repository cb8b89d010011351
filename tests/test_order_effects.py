"""Effects on panels with holes beside a dense solve; order statistics and tau-b beside plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.operators import fixed_effects as E
from gridlens.operators import order_stats as O


def dense(rows):
    """The same model with all dummies, errors clustered both ways."""
    runs, lefts, rights = (sorted({r[k] for r in rows}) for k in (2, 0, 1))
    x = np.array([[1.0, *(r[2] == q for q in runs[1:]), *(r[0] == m for m in lefts[1:]), *(r[1] == p for p in rights[1:])] for r in rows])
    y = np.array([r[3] for r in rows], float)
    bread = np.linalg.pinv(x.T @ x, rcond=1e-12)
    beta = bread @ x.T @ y
    scores = (y - x @ beta)[:, None] * x
    n, k = len(rows), x.shape[1]

    def meat(key):
        groups = {}
        for r, s in zip(rows, scores, strict=True):
            groups[key(r)] = groups.get(key(r), 0) + s
        m = sum(np.outer(s, s) for s in groups.values())
        return m * len(groups) / (len(groups) - 1) * (n - 1) / (n - k)

    cov = bread @ (meat(lambda r: r[0]) + meat(lambda r: r[1]) - meat(lambda r: (r[0], r[1]))) @ bread
    return beta[1 : len(runs)], cov[1 : len(runs), 1 : len(runs)]


@pytest.mark.parametrize("share", [1.0, 0.6])
def test_run_effects_are_those_of_a_dense_solve(spark, share):
    r = random.Random(9)
    rows = [(m, p, q, int(r.random() < 0.3 + 0.05 * m / 6 + 0.1 * (q == 3))) for m in range(6) for p in range(14) for q in (1, 2, 3) if r.random() < share]
    found = E.fit(spark.createDataFrame(rows, "model long, prompt_id long, run long, y int"), F.col("y"))
    effects, cov = dense(rows)
    assert np.allclose(found.effects, effects, atol=1e-8) and np.allclose(found.covariance, cov, atol=1e-8)
    assert found.parameters == 3 + 5 + 13 and found.observations == len(rows)
    if share == 1:
        rates = {q: np.mean([x[3] for x in rows if x[2] == q]) for q in (1, 2, 3)}
        assert np.allclose(found.effects, [rates[2] - rates[1], rates[3] - rates[1]])
    names = [c[0] for c in found.contrasts()]
    assert names == ["run 2 vs run 1", "run 3 vs run 1", "run 3 vs run 2"]
    assert math.isclose(found.contrasts()[2][1], found.effects[1] - found.effects[0])


def test_tests_of_run_effects(spark):
    rows = [(m, p, q, int((m * 7 + p * 3 + q * q) % 5 < 2 + (q == 2))) for m in range(5) for p in range(9) for q in (1, 2, 3)]
    frame = spark.createDataFrame(rows, "model long, prompt_id long, run long, y int")
    found = E.fit(frame, F.col("y"))
    rates = E.crossed_rates(frame, F.col("y"), 200)
    got = {r.contrast: r for r in E.tested(found, rates).collect()}
    draws = {}
    for r in rates.collect():
        draws.setdefault(r.rep, {})[r.run] = r.rate
    d = np.array([[x[2] - x[1], x[3] - x[1]] for x in draws.values()])
    c = d - d.mean(0)
    assert math.isclose(got["run 2 vs run 1"].p, ((np.abs(c[:, 0]).round(9) >= round(abs(found.effects[0]), 9)).sum() + 1) / 201)
    seen = np.sqrt((found.effects**2).sum())
    assert math.isclose(got["all runs"].p, ((np.sqrt((c**2).sum(1)).round(9) >= round(seen, 9)).sum() + 1) / 201)
    assert math.isclose(got["run 3 vs run 1"].low, np.quantile(d[:, 1], 0.025))


@pytest.mark.parametrize("gathered", [4096, 5])
def test_quantiles_by_narrowing(spark, monkeypatch, gathered):
    monkeypatch.setattr(O, "GATHERED", gathered)
    r = np.random.default_rng(2)
    for values in (r.normal(size=3000) ** 3, np.array([1.0] * 2000 + [2.0] * 10 + [-5.0]), np.array([7.0]), np.round(r.exponential(size=999), 2)):
        frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        at = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
        got = [x["value"] for x in O.quantiles(frame, F.col("x"), at).collect()]
        assert np.allclose(got, np.quantile(values, at), rtol=1e-12)
    assert [x["value"] for x in O.quantiles(frame.where("false"), F.col("x"), [0.5]).collect()] == [None]


def pairs_tau(rows):
    s = nx = ny = 0
    for k, (a, b) in enumerate(rows):
        for c, d in rows[k + 1 :]:
            s += np.sign(a - c) * np.sign(b - d)
            nx += a != c
            ny += b != d
    return s / math.sqrt(nx * ny) if nx and ny else None


def test_inversions_with_ties_and_numbers():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 40, 133):
        x, y, w = r.integers(0, 12, n), r.integers(0, 9, n), r.integers(1, 4, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
        assert O.inversions(x, y, w) == want


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_tau_b_is_that_of_all_pairs(spark, ranges):
    r = np.random.default_rng(ranges)
    smooth = [(float(a), float(a + b)) for a, b in r.normal(size=(120, 2))]
    tied = [(float(a), float(b)) for a, b in r.integers(0, 5, (150, 2))]
    hot = [(1.0, float(b)) for b in r.normal(size=80)] + smooth[:60]
    for rows in (smooth, tied, hot, [(1.0, 2.0), (1.0, 3.0)], [(1.0, 1.0)]):
        got = O.tau_b(spark.createDataFrame([*rows, (None, 1.0)], "a double, b double"), "a", "b", ranges).first()
        want = pairs_tau(rows)
        assert got.n == len(rows) and (got.tau_b is None if want is None else math.isclose(got.tau_b, want, abs_tol=1e-12))


def test_tau_b_of_a_million_rows(spark):
    frame = spark.range(1_000_000).select(F.xxhash64("id").alias("a"), (F.xxhash64("id") / 2 + F.xxhash64(F.col("id") + 7) / 2).alias("b"))
    got = O.tau_b(frame, "a", "b").first()
    assert got.n == 1_000_000 and 0.4 < got.tau_b < 0.6


def test_quotas_are_those_of_enumeration(spark):
    from hashlib import sha256
    from itertools import product

    from gridlens.operators import construct

    r = random.Random(3)
    for _ in range(3):
        free = {s: (r.randint(4, 12), r.randint(4, 12)) for s in "abc"}
        frame = spark.createDataFrame([(s, c, n) for s, (p, e) in free.items() for c, n in (("pilot", p), ("extension", e))], "s string, c string, n int")
        fits = [p for p in product(range(9), repeat=3) if sum(p) == 12 and all(x <= free[s][0] and 8 - x <= free[s][1] for x, s in zip(p, "abc", strict=True))]
        best = min(fits, key=lambda p: (max(abs(x - 4) for x in p), sum((x - 4) ** 2 for x in p), sha256(("q\0allocation\0" + ",".join(map(str, p))).encode()).hexdigest()))
        got = construct.quota_table(frame, "s", "c", "n", 8, 12, "q").collect()
        assert [(x.s, x.pilot, x.extension) for x in sorted(got)] == [(s, x, 8 - x) for s, x in zip("abc", best, strict=True)]
    with pytest.raises(ValueError, match="no allocation"):
        construct.quota_table(frame, "s", "c", "n", 8, 100, "q")


def test_quotas_of_thirty_strata(spark):
    from gridlens.operators import construct

    frame = spark.createDataFrame([(k, c, 12 if c == "extension" else k % 9) for k in range(30) for c in ("pilot", "extension")], "s int, c string, n int")
    got = construct.quota_table(frame, "s", "c", "n", 12, 100, "q").collect()
    assert sum(x.pilot for x in got) == 100 and all(x.pilot + x.extension == 12 and x.pilot <= x.s % 9 for x in got)


def test_partial_assembly_is_rejected(spark):
    from gridlens.operators import release

    cells = spark.createDataFrame([("m", "p", True, None, True, True, True), ("m", "q", True, True, True, True, True)], "model string, prompt_id string, execution boolean, assembly boolean, signature boolean, ordered boolean, parameter boolean")
    with pytest.raises(ValueError, match="assembly"):
        release.canonical_faults(cells, [])
    faults = {r.key: (r.expected, r.observed) for r in release.canonical_faults(cells.fillna(True, ["assembly"]), []).collect()}
    assert faults["cells"] == (3234, 2) and faults["attrition"] == (6, 0) and "signature_without_assembly" not in faults
    assert {r.key for r in release.repeat_faults(spark.createDataFrame([("m", "p", 1)], "model string, prompt_id string, run int")).collect()} == {"cells", "models", "prompts", "runs"}


def test_superseded_attempts_have_reasons(spark):
    from gridlens.operators import construct

    rows = [(1, 5, 1, True), (1, 3, 2, False), (1, 4, 3, False), (1, 1, 4, True), (2, 1, 5, True), (2, 2, 6, True), (3, 1, 7, False)]
    got = construct.superseded(spark.createDataFrame(rows, "p int, t int, i int, e boolean"), "p", "t", "i", "e").collect()
    assert sorted((r.p, r.i, r.kept_index, r.reason) for r in got) == [(1, 1, 2, construct.RETRYABLE), (1, 3, 2, construct.DUPLICATE), (1, 4, 2, construct.RETRYABLE), (2, 6, 5, construct.RETRYABLE)]


def test_poststratified_draws(spark):
    from gridlens.operators import resample

    cells = spark.createDataFrame([(m, p, q, (m + p + q) % 3 == 0) for m in range(4) for p in range(6) for q in (1, 2)], "model int, prompt_id int, run int, hit boolean")
    bins = spark.createDataFrame([(p, "ab"[p % 2]) for p in range(6)], "prompt_id int, bin string")
    draws = resample.poststratified_bootstrap(cells, bins, F.col("hit").cast("int"), {"a": 1.0, "b": 3.0}, 50, "run").collect()
    assert len(draws) == 100 and all(0 <= r.estimate <= 1 for r in draws) and len({r.estimate for r in draws}) > 5
    always = resample.poststratified_bootstrap(cells, bins, (F.col("prompt_id") % 2), {"a": 1.0, "b": 3.0}, 20, "run").collect()
    assert {r.estimate for r in always} == {0.75}
    with pytest.raises(ValueError, match="no cells"):
        resample.poststratified_bootstrap(cells, bins, F.col("hit").cast("int"), {"a": 1.0, "c": 1.0}, 5)


def test_majority_and_stability_of_a_small_panel(spark):
    from gridlens.operators import agreement

    items = spark.createDataFrame([("m", [1, 1, 0], [1, 0, 0]), ("m", [1, 1, 1], [0, 0, 0]), ("n", [0, 1, 1], [0, 1, 1]), ("n", [1, 1, 1], [1, 1, 1])], "model string, execution array<int>, signature array<int>")
    r = agreement.majority_summary(items, "model").first()
    assert (r.n, r.execution, r.signature, r.es_gap, r.runwise_wrong) == (4, 4, 2, 2, 1)
    assert (r.signature_change_pp, r.execution_change_pp) == (0.0, 25.0) and r.rank_correlation is None
    rates = spark.createDataFrame([(k, float(k), float(k * k)) for k in range(8)], "model int, a double, b double")
    s = agreement.stability(rates, "model", "a", "b", F.col("model") < 2).first()
    assert (s.spearman, s.tau_b, s.jaccard, s.frontier_first, s.others_second) == (1.0, 1.0, 1.0, 0.5, np.mean([k * k for k in range(2, 8)]))


@pytest.mark.parametrize("width", [32, 6])
def test_axes_are_those_of_a_dense_decomposition(spark, width):
    from gridlens.operators import spectrum

    r = np.random.default_rng(width)
    for n, m in ((21, 60), (300, 40), (5, 3)):
        x = r.normal(size=(n, 3)) @ np.diag([5, 3, 1.5]) @ r.normal(size=(3, m)) + 0.3 * r.normal(size=(n, m))
        frame = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(m)], "unit long, item long, v double")
        got = sorted(map(tuple, spectrum.scores(frame, "unit", "item", F.col("v"), width=width).collect()))
        c = x - x.mean(0)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        want = u[:, :2] * s[:2]
        want *= np.where(want.T @ (x.mean(1) - x.mean()) < 0, -1, 1)
        assert np.allclose([g[1:3] for g in got], want, atol=1e-7 * s[0])
        assert np.allclose(got[0][3:], s[:2] ** 2 / (s**2).sum(), rtol=1e-9)


def test_axes_of_many_units_with_gaps_and_of_little_rank(spark):
    from gridlens.operators import spectrum

    many = spark.range(100_000).select(F.col("id").alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("item")).where("(unit + item) % 7 > 0").withColumn("v", F.sin(F.col("unit") * 0.01) * F.col("item") + F.cos(F.col("unit") * 0.1))
    got = spectrum.scores(many, "unit", "item", F.col("v")).agg(F.count("*"), F.max("share1"), F.sum(F.col("pc1") * F.col("pc2"))).first()
    assert got[0] == 100_000 and 0.5 < got[1] < 1 and abs(got[2]) < 1e-6
    flat = spectrum.scores(spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0)], "unit long, item long, v double"), "unit", "item", F.col("v")).collect()
    assert [tuple(r)[1:] for r in sorted(flat)] == [(0.0, 0.0, 0.0, 0.0)] * 2


def test_model_rows_reject_gaps_and_totals_that_differ(spark):
    from gridlens.operators import release

    reports = spark.createDataFrame([("a", 5, 4, 3, 0.3, 0.5), ("b", 5, 5, 5, 0.5, 0.5)], "model string, execution long, assembly long, signature long, signature_rate double, execution_rate double")
    ordered = spark.createDataFrame([("a", 1), ("b", 2)], "model string, ordered_count long")
    repeats = spark.createDataFrame([("a", 0.4), ("b", 0.6)], "model string, repeat_rate double")
    summary = spark.createDataFrame([(2, 10, 9, 8)], "models long, execution long, assembly long, signature long")
    assert [(r.model, r.place) for r in release.model_rows(reports, ordered, repeats, summary).orderBy("place").collect()] == [("b", 1), ("a", 2)]
    with pytest.raises(ValueError, match="incomplete"):
        release.model_rows(reports, ordered.where("model = 'a'"), repeats, summary)
    with pytest.raises(ValueError, match="add up"):
        release.model_rows(reports, ordered, repeats, summary.withColumn("signature", F.lit(7)))
