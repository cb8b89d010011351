import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.functions import exprs as X
from gridlens.functions.python_forms import ast_hash, sequence_ratio, tree_digest
from gridlens.operators import agreement, cells, classify, construct, models, resample, retrieval, validate
from gridlens.sources import readers, sinks
from gridlens.streaming import attempts

CELLS = "model string, prompt_id string, report_executable boolean, report_assembly_admissible boolean, report_signature_match boolean, ordered_wire_tape_match boolean, parameter_aware_tape_match boolean"


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expression.alias("x")).first().x


def test_cell_summary_with_missing_endpoints(spark):
    raw = spark.createDataFrame([("a", "p1", True, True, True, True, False), ("a", "p2", True, True, False, False, False), ("b", "p1", False, False, False, None, None)], CELLS)
    s = cells.summarize(validate.resolve(raw)).first()
    assert (s.cells, s.models, s.prompts, s.execution, s.assembly, s.signature, s.ordered, s.parameter) == (3, 2, 2, 2, 2, 1, 1, 0)
    assert (s.es_gap, s.attrition, s.as_gap, s.assembly_without_signature, s.signature_without_assembly) == (1, 0, 1, 1, 0)
    assert s.as_gap_share == 1.0 and s.disagreement_rate == 0.5


def test_absent_layers_are_null_not_zero(spark):
    raw = spark.createDataFrame([("a", "p", 1, 0)], "model string, prompt_id string, execution int, signature int")
    s = cells.summarize(validate.resolve(raw)).first()
    assert (s.execution, s.signature) == (1, 0) and [s.assembly, s.ordered, s.parameter, s.as_gap] == [None] * 4
    tidy = cells.tidy(cells.summarize(validate.resolve(raw)), cells.PRIMARY)
    assert "N/A" in sinks.render(tidy) and [r["metric"] for r in json.loads(sinks.render(tidy, "json"))][:4] == ["cells", "models", "prompts", "execution"]
    assert sinks.render(tidy, "csv").startswith("metric,count") and sinks.render(tidy, "markdown").count("\n") == 2 + len(cells.PRIMARY)


def test_render_rates(spark):
    tidy = spark.createDataFrame([("primary", "signature", True, 2, 4, 0.5)], "section string, metric string, available boolean, count long, denominator long, rate double")
    assert sinks.render(tidy).splitlines()[1].split() == ["signature", "2", "4", "50.00%"]


def test_validation_finds_what_must_not_be(spark):
    rows = spark.createDataFrame([("a", "p", False, True, True), ("a", "q", True, False, True), ("a", "q", True, True, True)], "model string, prompt_id string, execution boolean, assembly boolean, signature boolean")
    rows = rows.withColumns({"ordered": F.lit(None).cast("boolean"), "parameter": F.lit(None).cast("boolean")})
    assert sorted(r.rule for r in validate.implication_violations(rows).collect()) == ["assembly without execution", "signature without execution"]
    assert validate.duplicates(rows, "model", "prompt_id").count() == 1
    alias = spark.createDataFrame([("true", "0"), ("1", "true"), ("maybe", None)], "execution string, execution_success string")
    assert validate.conflicts(alias).count() == 2
    with pytest.raises(ValueError, match="twice"):
        validate.require_empty(validate.duplicates(rows, "model", "prompt_id"), "twice")
    a, b = spark.range(3), spark.range(1, 4)
    assert {(r.id, r.only) for r in validate.key_mismatches(a, b, "id").collect()} == {(0, "left"), (3, "right")}


def test_report_cells(spark, tmp_path):
    record = lambda p, ok, qasm, match: {"prompt_id": p, "execution": {"execution_success": ok, "circuit_found": ok, "qasm3_export": {"success": qasm}}, "structural_checks": {"all_match": match, "ordered_match": match, "parameter_match": match}}
    (tmp_path / "model-a").mkdir()
    (tmp_path / "model-a/report.json").write_text(json.dumps({"summary": {}, "records": [record("prompt-1", True, True, True), record("prompt-2", True, False, False)]}, indent=1))
    s = cells.summarize(readers.report_cells(readers.reports(spark, str(tmp_path)))).first()
    assert (s.cells, s.models, s.execution, s.assembly, s.signature, s.es_gap) == (2, 1, 2, 1, 1, 1)


def test_json_lines_and_manifest(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert [tuple(r) for r in readers.json_lines(spark, str(tmp_path / "ok.jsonl"), "a long, b string").collect()] == [(1, None), (2, "x")]
    for bad in ('{"a": 1', "[1]", "7"):
        (tmp_path / "bad.jsonl").write_text(bad + "\n")
        with pytest.raises(ValueError, match="bad.jsonl"):
            readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "a long")
    folder = tmp_path / "files"
    (folder / "sub").mkdir(parents=True)
    (folder / "x.txt").write_text("x")
    (folder / "sub/y.txt").write_text("y")
    found = readers.digests(spark, str(folder))
    assert {r.path for r in found.collect()} == {"x.txt", "sub/y.txt"}
    lines = ["path\tbytes\tsha256"] + [f"{r.path}\t{r.bytes}\t{r.sha256}" for r in found.collect()]
    (tmp_path / "m.tsv").write_text("\n".join([*lines, "gone.txt\t1\t" + "0" * 64]))
    (folder / "x.txt").write_text("longer")
    (folder / "sub/y.txt").write_text("z")
    faults = readers.verify(readers.manifest(spark, str(tmp_path / "m.tsv")), readers.digests(spark, str(folder)))
    assert {r.path: r.fault for r in faults.collect()} == {"gone.txt": "missing", "x.txt": "size", "sub/y.txt": "content"}
    (tmp_path / "m.tsv").write_text("path\tbytes\tsha256\n../up\t1\t" + "0" * 64)
    with pytest.raises(ValueError, match="unsafe"):
        readers.manifest(spark, str(tmp_path / "m.tsv"))


def test_batch_responses(spark, tmp_path):
    lines = [
        {"custom_id": "x::p1", "response": {"status_code": 200, "body": {"model": "m", "status": "completed", "output": [{"content": [{"type": "t", "text": "a"}, {"type": "t", "text": "b"}]}], "usage": {"prompt_tokens": 3}}}},
        {"custom_id": "x::p2", "error": {"message": "boom"}, "response": {"status_code": 500, "body": {"model": "m"}}},
    ]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, lines)))
    requests = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "prompt_id string")
    rows = {r.prompt_id: r for r in readers.batch_responses(readers.json_lines(spark, str(tmp_path / "b.jsonl"), readers.BATCH), requests).collect()}
    assert (rows["p1"].text, rows["p1"].error, rows["p1"].tokens_in) == ("ab", None, 3)
    assert rows["p2"].error == "boom" and rows["p3"].error == "no response"


def test_text_forms(spark):
    code = "```python\r\nx = 1  \r\n\r\n\r\n\r\nprint(x)\r\n```"
    assert one(spark, X.normal_lines(F.lit(code))) == "x = 1\n\nprint(x)"
    assert tree_digest("x = 1\nprint(x)") == tree_digest("x=1\nprint(x)  # comment") != tree_digest("x = 2")
    assert tree_digest("def (") == "" == tree_digest(None)
    assert one(spark, X.strip_fence(F.lit("say ```py\nx\n``` and ```y```"))) == "x"
    assert one(spark, X.tokens(F.lit("applyCNOT_gate the θ x 3.5 q"))) == ["apply", "cnot", "gate", "theta", "x", "3.5"]
    assert one(spark, X.word_ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a", "b", "c", "a__b", "b__c"]
    assert one(spark, X.char_ngrams(F.lit("ab"))) == [" ab", "ab ", " ab "]
    assert one(spark, X.slug(F.lit("--A b/C!"))) == "a-b-c" and one(spark, X.short(F.lit("abcdefgh"), 6)) == "abc..."
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(sequence_ratio("a", "b").alias("x")).collect()] == [0.8, 1.0]
    assert spark.createDataFrame([("x=1",), ("x = 1",)], "c string").select(ast_hash("c").alias("h")).distinct().count() == 1


@pytest.mark.parametrize("raw, want", [(None, "<missing>"), (" ", "<non_numeric>"), ("nan", "<missing>"), ("x", "<non_numeric>"), ("-1", "negative"), ("0", "0"), ("0.5", "3_4"), ("1", "1"), ("24", "10_24"), ("3", "3_4"), ("1000", "1000_plus")])
def test_numeric_bins(spark, raw, want):
    assert one(spark, X.numeric_bin(F.lit(raw).cast("string"))) == want


def test_maps_and_signatures(spark):
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    assert one(spark, X.entropy(m(a=1, b=1))) == pytest.approx(math.log(2)) and one(spark, X.entropy(m(a=5))) == 0
    sig = lambda c: one(spark, X.signature(F.lit(1), F.lit(0), F.lit(2), c))
    assert sig(m(a=1, b=2)) == sig(m(b=2, a=1)) != sig(m(a=2, b=1))
    assert one(spark, X.map_total(m(h=2, barrier=5), without="barrier")) == 2
    w = one(spark, X.wilson(F.lit(8), F.lit(10)))
    assert (round(w.low, 4), round(w.high, 4)) == (0.4902, 0.9433)


def test_agreement_by_hand(spark):
    items = spark.createDataFrame([(1, 1, 1, 1, 1), (1, 2, 0, 0, 0), (1, 3, 1, 1, 0), (1, 4, 1, 0, 0)], "model int, prompt_id int, a int, b int, c int")
    r = agreement.agreement(items).first()
    assert (r.unanimous, r.pairwise, r.positive) == (0.5, pytest.approx(2 / 3), pytest.approx(0.5)) and r.ac1 == pytest.approx(1 / 3)
    tests = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "t string, p double")
    assert {r.t: round(r.p_holm, 6) for r in agreement.holm(tests, "p", tie=["t"]).collect()} == {"x": 0.03, "y": 0.06, "z": 0.06}
    pairs = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (0, 0)], "x int, y int")
    assert agreement.mcnemar(pairs, "x", "y").first().p == pytest.approx(0.5)
    same = items.select("model", "prompt_id", "a", F.col("a").alias("b"), F.col("a").alias("c"))
    q = agreement.cochran_q(same).first()
    assert (q.q, q.p) == (0.0, 1.0)
    assert sum(r.n for r in agreement.patterns(items).collect()) == 4 and agreement.patterns(items).count() == 8


def test_binomial_tail_far_out(spark):
    assert one(spark, agreement.binomial_tail(F.lit(900), F.lit(2000))) == pytest.approx(sum(math.comb(2000, i) for i in range(901)) / 2**2000)


def test_bm25_and_ranks(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"]), (4, ["e"])], "id long, t array<string>")
    index = retrieval.postings(docs, "id", F.col("t"))
    queries = spark.createDataFrame([(10, "a", 1), (11, "d", 2), (12, "zz", 1)], "query long, term string, qtf long")
    n = spark.createDataFrame([(4, 7 / 4)], "n long, avgdl double")
    scores = retrieval.bm25(queries, index, n)
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (7 / 4)))
    assert {(r.query, r.doc): r.score for r in scores.collect()}[10, 2] == pytest.approx(want)
    targets = spark.createDataFrame([(10, 4), (11, 3), (12, 3)], "query long, target long")
    ranks = {r.query: r["rank"] for r in retrieval.target_ranks(scores, targets, docs.select(F.col("id").alias("doc"))).collect()}
    assert ranks == {10: 4, 11: 1, 12: 3}
    m = retrieval.rank_metrics(spark.createDataFrame([(1,), (2,), (20,)], "rank long")).first()
    assert (round(m.recall_1, 4), round(m.recall_5, 4), round(m.mrr, 4), m.median_rank) == (0.3333, 0.6667, 0.5167, 2.0)
    copy = retrieval.tfidf(index.where("doc = 2").select(F.lit(9).alias("query"), "term", F.col("tf").alias("qtf")), index, F.lit(4))
    assert max(r.score for r in copy.collect()) == pytest.approx(1.0)


def test_split_keeps_groups_whole(spark):
    rows = spark.range(500).selectExpr("concat('g', id % 50) as g", "if(id % 7 < 4, 'x', 'y') as label")
    split = construct.group_split(rows, "g", "label")
    assert split.count() == split.select("g").distinct().count() == 50
    assert construct.overlap(rows.join(split.select("g", "split"), "g"), "g").count() == 0
    assert construct.common_keys(rows, rows.limit(0), "g").count() == 0


def test_allocation_and_quotas(spark):
    have = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("a", "z", 10), ("b", "x", 30), ("b", "z", 30)], "s string, b string, n long")
    got = {(r.s, r.b): r.quota for r in construct.joint_allocation(have, "s", "b", "n", {"a": 8, "b": 6}, {"x": 6, "y": 3, "z": 5}).collect()}
    tables = [(x, y, 8 - x - y) for x in range(7) for y in range(4) if 0 <= 8 - x - y <= 5]
    far = lambda t: round(sum((v - e) ** 2 + (n - v - f) ** 2 for v, n, e, f in zip(t, (6, 3, 5), (2, 4, 2), (3, 0, 3), strict=True)), 9)
    best = min((far(t), t) for t in tables)[1]
    assert [got["a", k] for k in "xyz"] == list(best) and [got["b", k] for k in "xyz"] == [n - v for n, v in zip((6, 3, 5), best, strict=True)]
    free = spark.createDataFrame([("1-2", "pilot", 11), ("1-2", "extension", 17), ("3-4", "pilot", 25), ("3-4", "extension", 37), ("5+", "pilot", 5), ("5+", "extension", 9)], "bin string, cohort string, free long")
    rows = construct.quota_search(free, "bin", "cohort", "free", 12).collect()
    assert sum(r.pilot + r.extension for r in rows) == 36 and sum(r.pilot for r in rows) == 18
    assert {r.bin: r.pilot for r in rows}["5+"] == 5


def test_resampling(spark):
    sums = spark.createDataFrame([(f"c{k}", k % 2, 1) for k in range(40)], "cluster string, x long, n long")
    w = resample.weights(resample.replicates(spark, 5), 40).groupBy("rep").agg(F.sum("w").alias("s")).collect()
    assert [r.s for r in w] == [40] * 5
    ci = resample.interval(resample.cluster_bootstrap(sums, 300)).first()
    assert ci.low < 0.5 < ci.high and ci.mean == pytest.approx(0.5, abs=0.03) and ci.high - ci.low == pytest.approx(0.31, abs=0.06)
    same = spark.createDataFrame([(k, 0) for k in range(10)], "cluster long, d long")
    assert resample.sign_flip(same, 50).first().p == 1.0
    assert resample.sign_flip(same.withColumn("d", F.lit(1)), 200).first().p < 0.05


def test_regressions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    fit = models.ols(df, F.col("y"), {"a": F.col("a"), "b": F.col("b")})
    assert np.allclose(fit.beta, [1, 2, -1], atol=1e-6) and fit.r2 == pytest.approx(1)
    s = rng.binomial(30, 1 / (1 + np.exp(-(0.3 + x[:, 0]))))
    df = spark.createDataFrame([(float(a), int(k), 30) for (a, _), k in zip(x, s, strict=True)], "a double, s long, n long")
    fit = models.logit(df, F.col("s"), F.col("n"), {"a": F.col("a")}, ridge=0.0)
    beta = np.zeros(2)
    z = np.column_stack([np.ones(200), x[:, 0]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z * (30 * p * (1 - p))[:, None]).T @ z, z.T @ (s - 30 * p))
    assert np.allclose(fit.beta, beta, atol=1e-6)
    ame = models.marginal_effects(df, fit, {"a": F.col("a")}, F.col("n")).first().ame
    p = 1 / (1 + np.exp(-z @ beta))
    assert ame == pytest.approx(float((beta[1] * p * (1 - p)).mean()), abs=1e-6)


def test_linkage_and_effects(spark):
    d = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.5), (2, 3, 0.7)], "a long, b long, distance double")
    assert [(r.left, r.right, round(r.height, 6), r.size) for r in models.average_linkage(d).orderBy("step").collect()] == [(1, 2, 0.1, 2), (3, 4, 0.6, 3)]
    runs = spark.createDataFrame([(m, p, r, r > 1) for m in range(5) for p in range(4) for r in (1, 2, 3)], "model long, prompt_id long, run long, signature boolean")
    assert [(r.run, r.effect, r.se) for r in models.two_way_effects(runs).orderBy("run").collect()] == [(2, 1.0, 0.0), (3, 1.0, 0.0)]


def test_naive_bayes_and_metrics(spark):
    rows = spark.createDataFrame([(1, "x", ["a", "b"]), (2, "x", ["a"]), (3, "y", ["c"])], "id long, y string, t array<string>")
    model = classify.fit_nb(rows, "y", F.col("t"))
    test = spark.createDataFrame([(9, ["a", "new"])], "id long, t array<string>")
    got = {r.y: r.score for r in classify.score_nb(test, "id", "y", F.col("t"), model).collect()}
    assert got["x"] == pytest.approx(math.log(2 / 3) + math.log(3 / 6) + math.log(1 / 6)) and got["y"] == pytest.approx(math.log(1 / 3) + 2 * math.log(1 / 4))
    auc = classify.auroc(spark.createDataFrame([(1, 1), (1, 0), (2, 1), (0, 0)], "s int, y int"), "s", F.col("y") == 1).first().auroc
    assert auc == pytest.approx(3.5 / 4)


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, True), (1, "2024-01-01 01:00:00", 2, False), (1, "2024-01-01 02:00:00", 3, False), (2, "2024-01-03 00:00:00", 4, True)]
    log = spark.createDataFrame(rows, "prompt_id long, created_at string, idx long, is_error boolean").withColumn("created_at", F.to_timestamp("created_at"))
    log.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = attempts.canonical(stream()).writeStream.format("memory").queryName("canonical").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.prompt_id, r.idx, r.attempts) for r in spark.sql("select * from canonical").collect()} == {(1, 2, 3), (2, 4, 1)}
    attempts.append_log(attempts.first_per_prompt(stream()), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert [r.prompt_id for r in attempts.unfinished(log.select("prompt_id").distinct(), log).collect()] == [2]
    days = {r.n: r.errors for r in attempts.error_rates(log).collect()}
    assert days == {3: 1, 1: 1}


def test_records(spark):
    from gridlens.operators import records

    rows = spark.createDataFrame([("gold", " a ", "1"), ("gold", "b", None), ("gold", "c", ""), ("other", "d", "2"), ("gold", "  ", "3")], "role string, text string, id string")
    assert {(r.id, r.text) for r in records.clean_rows(rows, "role", "text", "id", ("gold",)).collect()} == {("1", "a"), ("clean_0001", "b"), ("clean_0002", "c")}
    assert one(spark, records.missing_name(F.lit("NameError: name 'qc' is not defined"))) == "qc"
    log = spark.createDataFrame([("m", 1, False), ("m", 2, True), ("m", 2, True), ("k", 1, False), ("k", 2, False)], "model string, p int, bad boolean")
    audit = {r.model: (r.answered, r.missing, r.repeated, r.errors_only, r.status) for r in records.run_audit(spark.createDataFrame([(1,), (2,)], "p int"), log, "p", "bad").collect()}
    assert audit == {"m": (2, 0, 1, 1, "complete_with_errors"), "k": (2, 0, 0, 0, "complete")}
    picks = records.select_prompts(spark.range(9).toDF("p"), "p", "p", exclude=[0, 2], limit=3)
    assert [r.p for r in picks.collect()] == [1, 3, 4]
