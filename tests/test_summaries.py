"""Agreement of digests, rank bootstraps, fits, matrices, report folders and feature sets beside plain versions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.functions.python_forms import tree_digest
from gridlens.operators import agreement as A
from gridlens.operators import features as T
from gridlens.operators import models as M
from gridlens.operators import resample as R
from gridlens.operators import validate as V
from gridlens.sources import readers


def test_digests_agree_by_pair_of_runs(spark):
    code = {("m", "p"): ["x = 1", "x=1  # one", "x = 1"], ("m", "q"): ["x = 2", "x = (", "y = 2"], ("n", "p"): ["f()", None, "f( )"], ("n", "q"): ["", "z", "z"], ("n", "r"): ["a", "b", "c"]}
    rows = [(m, p, k + 1, tree_digest(c)) for (m, p), cs in code.items() for k, c in enumerate(cs)]
    out = {r.pair: (r.items, r.same, r.rate) for r in A.digest_agreement(spark.createDataFrame(rows, "model string, prompt_id string, run int, tree string"), "tree").collect()}
    assert out == {"1-2": (2, 1, 0.5), "1-3": (4, 2, 0.5), "2-3": (3, 2, 2 / 3), "all": (2, 1, 0.5), "pairs": (6, 3, 0.5)}
    none = A.digest_agreement(spark.createDataFrame([("m", "p", 1, "")], "model string, prompt_id string, run int, tree string"), "tree").collect()
    assert {(r["items"], r["same"], r["rate"]) for r in none} == {(0, 0, None)}


def ranks(values):
    return [sum(w > v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_rank_bootstrap_is_that_of_numpy(spark):
    r = random.Random(4)
    table = [[r.choice((0.1, 0.2, 0.2, 0.4)) for _ in range(5)] for _ in range(60)]
    seen = [0.4, 0.2, 0.2, 0.1, 0.3]
    rates = spark.createDataFrame([(k, m, v) for k, row in enumerate(table) for m, v in enumerate(row)], "rep int, model int, estimate double")
    own = spark.createDataFrame(list(enumerate(seen)), "model int, score double")
    each, scores = np.array([ranks(row) for row in table]), np.array(table)
    for x in R.bootstrap_scores(rates, own, "model").collect():
        m = x.model
        want = [seen[m], ranks(seen)[m], *np.quantile(scores[:, m], [0.025, 0.975]), *np.quantile(each[:, m], [0.5, 0.025, 0.975]), (each[:, m] <= 3).mean(), (each[:, m] <= 5).mean()]
        assert np.allclose(want, [x.score, x.rank, x.score_low, x.score_high, x.rank_median, x.rank_low, x.rank_high, x.top3, x.top5])
    for x in R.rank_correlations(rates, own, "model").collect():
        if len(set(table[x.rep])) == 1:
            assert x.estimate is None
        else:
            assert math.isclose(x.estimate, np.corrcoef(ranks(table[x.rep]), ranks(seen))[0, 1], abs_tol=1e-12)


def test_summary_of_a_fit(spark):
    r = random.Random(2)
    rows = [(float(r.randrange(4)), float(r.randrange(3)), r.randrange(0, 9)) for _ in range(40)]
    df = spark.createDataFrame([(x, z, min(s, 8), 8) for x, z, s in rows], "x double, z double, s int, n int")
    terms = {"x": F.col("x"), "z": F.col("z")}
    fit = M.logit(df, F.col("s"), F.col("n"), terms)
    got = M.fit_summary(df, fit, terms, F.col("s"), F.col("n")).first()
    singles = [(round(float(fit.beta @ [1, x, z]), 12), k < min(s, 8)) for x, z, s in rows for k in range(8)]
    ups, downs = [e for e, hit in singles if hit], [e for e, hit in singles if not hit]
    area = sum((u > d) + (u == d) / 2 for u in ups for d in downs) / len(ups) / len(downs)
    p = 1 / (1 + np.exp(-np.array([e for e, _ in singles])))
    y = np.array([hit for _, hit in singles])
    ll, share = np.where(y, np.log(p), np.log(1 - p)).sum(), y.mean()
    null = len(y) * (share * math.log(share) + (1 - share) * math.log(1 - share))
    assert np.allclose([got.n, got.positive_rate, got.log_likelihood, got.null_log_likelihood, got.mcfadden, got.auc], [len(y), share, ll, null, 1 - ll / null, area])
    same = df.withColumn("s", F.col("n"))
    assert M.fit_summary(same, fit, terms, F.col("s"), F.col("n")).first().auc == 0.5


def test_dense_matrix_has_every_cell_once(spark):
    models, prompts = spark.createDataFrame([(2,), (1,)], "model int"), spark.createDataFrame([("p",), ("q",)], "prompt_id string")
    cells = [(1, "p", True), (2, "p", False), (1, "q", True), (2, "q", True), (3, "p", None), (1, "z", True)]
    df = lambda rows: spark.createDataFrame(rows, "model int, prompt_id string, signature boolean")
    assert sorted((r.prompt_id, r.row) for r in V.dense(df(cells), models, prompts, "signature").collect()) == [("p", [1, 0]), ("q", [1, 1])]
    for bad, said in ((cells[1:], "no signature"), ([(1, "p", None), *cells[1:]], "no signature"), ([*cells, cells[0]], "cells twice")):
        with pytest.raises(ValueError, match=said):
            V.dense(df(bad), models, prompts, "signature")


def test_reports_of_unknown_folders_are_skipped(spark, tmp_path):
    for name in ("run_a", "run_b", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "report.json").write_text(json.dumps({"records": [{"prompt_id": "p1"}, {"prompt_id": "p2"}]}, indent=1))
    named = readers.reports(spark, str(tmp_path), {"run_a": "A", "run_b": "B", "run_c": "C"})
    assert sorted((r.model, r.prompt_id) for r in named.collect()) == [("A", "p1"), ("A", "p2"), ("B", "p1"), ("B", "p2")]
    assert {r.model for r in readers.reports(spark, str(tmp_path)).collect()} == {"run_a", "run_b", "other"}
    assert readers.reports(spark, str(tmp_path), {}).isEmpty()


def test_tokens_of_the_declared_sets(spark):
    row = spark.createDataFrame([(" qx ", None, 17, {"h": 9, "cx": None}, "QC = h(q, 3.5)")], "source string, mode string, lines int, gates map<string,bigint>, code string")
    fields = {"source": F.col("source"), "retrieval_mode": F.col("mode"), "code_lines": F.col("lines")}
    tokens = lambda base, name: row.select(T.set_tokens(T.FEATURE_SETS[base][name], fields, F.col("gates"), F.col("code")).alias("t")).first().t
    assert tokens("readiness", "primitive_metadata") == [f"{n}=<missing>" for n in T.PRIMITIVE] + ["code_lines_bin=10_24", "gate_count_bin=<missing>"]
    assert tokens("stress", "source_proxy_metadata") == ["source=qx", *[f"{n}=<missing>" for n in T.STRESS_SOURCE[1:]]]
    assert tokens("stress", "code_tokens") == ["code=qc", "code=h", "code=3.5"]
    assert tokens("stress", "structure_plus_code") == tokens("stress", "structural_metadata") + ["code=qc", "code=h", "code=3.5"]
    assert tokens("stress", "structural_metadata")[-6:] == ["gate=cx"] + ["gate=h"] * 5
    assert {n: len(c.categorical) + len(c.numeric) for n, c in T.FEATURE_SETS["readiness"].items()} == {"source_proxy_metadata": 12, "primitive_metadata": 9, "broad_metadata": 24}
