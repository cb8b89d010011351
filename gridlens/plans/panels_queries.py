"""Requests, harness counts, layers, tapes, feature sets and baselines of a panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.python_forms import presentation_stripped
from ..operators import cells as C
from ..operators import classify as N
from ..operators import features as T
from ..operators import order_stats as O
from ..operators import panels as P
from ..operators import records as R
from ..staging import settle
from . import fixtures as D
from .cells_queries import r6
from .classify_queries import _BIN, _CODE
from .registry import query

# --------------------------------------------------------------------------------------------------------------- harness

_FLAGS = {
    "empty_generation": "empty", "python_execution_success": "executed", "execution_success": "executed AND circuit", "circuit_found": "circuit", "structural_all_match": "whole_ok", "num_qubits_match": "qubits_ok",
    "num_clbits_match": "clbits_ok", "gate_count_match": "count_ok", "gate_types_match": "types_ok", "qasm3_export_success": "exported", "target_context_python_execution_success": "executed OR lines > 30",
    "target_context_execution_success": "(executed OR lines > 30) AND circuit", "target_context_structural_all_match": "whole_ok AND lines > 5",
}


@query("harness_counts", f"SELECT label, count(*) AS rows, {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}, round(count(*) FILTER (WHERE {c}) / count(*), 6) AS {n}_rate' for n, c in _FLAGS.items())} FROM harness GROUP BY label")
def _(spark, sf):
    return r6(P.harness_counts(D.harness(spark, sf), {n: F.expr(c) for n, c in _FLAGS.items()}, "label"), *[f"{n}_rate" for n in _FLAGS])


@query("error_histogram", """SELECT CASE WHEN NOT coalesce(executed, false) THEN coalesce(nullif(error, ''), 'ExecutionFailure') ELSE 'NoCircuitReturned' END AS error, count(*) AS n FROM harness
 WHERE NOT (coalesce(executed, false) AND coalesce(circuit, false)) GROUP BY 1""")
def _(spark, sf):
    return P.error_histogram(D.harness(spark, sf), F.col("executed"), F.col("circuit"), F.col("error"))


_CHECKS = {"num_qubits_match": "qubits_ok", "num_clbits_match": "clbits_ok", "gate_count_match": "count_ok", "gate_types_match": "types_ok"}


@query("mismatch_histogram", " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) AS n FROM harness WHERE circuit AND NOT coalesce(whole_ok, false) AND NOT {c} HAVING count(*) > 0" for n, c in _CHECKS.items()))
def _(spark, sf):
    return P.mismatch_histogram(D.harness(spark, sf), F.col("circuit"), F.col("whole_ok"), {n: F.col(c) for n, c in _CHECKS.items()})


# -------------------------------------------------------------------------------------------------------------- requests


@query("panel_requests", "SELECT item_id, pos, 2 AS run FROM benchmark JOIN (VALUES (7, 0), (3, 1), (39, 2), (11, 3)) AS v(id, pos) ON item_id = id")
def _(spark, sf):
    return P.filter_requests(D.table(spark, sf, "benchmark").select("item_id"), [7, 3, 39, 11, 100_000], "item_id", 2)


_REQ = """SELECT m.model || '::' || item_id AS custom_id, item_id, model, CASE WHEN family = 'chat' THEN '{"max_tokens":' || max_tokens || ',"messages":[{"content":"' || t || '","role":"user"}],"model":"' || model || '"}' ELSE '{"input":"' || t || '","max_output_tokens":' || max_tokens || ',"model":"' || model || '"}' END AS body, sha256(t) AS prompt_sha256
 FROM (SELECT item_id, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS t FROM benchmark), (VALUES ('a1', 'chat', 512), ('b-2', 'plain', 64)) AS m(model, family, max_tokens)"""


@query("request_rows", f"SELECT *, sha256(custom_id || chr(10) || prompt_sha256 || chr(10) || body_sha256) AS request_sha256 FROM (SELECT *, sha256(body) AS body_sha256 FROM ({_REQ}))")
def _(spark, sf):
    models = spark.createDataFrame([("a1", "chat", 512), ("b-2", "plain", 64)], "model string, family string, max_tokens int")
    prompts = D.table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "[^A-Za-z0-9 ]", "").alias("t"))
    return P.request_rows(prompts, "item_id", "t", models)


@query("external_results", """WITH l AS (SELECT * FROM (SELECT user_id % 6 AS model, user_id, event_type AS finish, 'v' || event_id % 3 AS resolved, value < 20 AS err, row_number() OVER (PARTITION BY user_id % 6, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1),
 f AS (SELECT model, string_agg(finish || ':' || n, ',' ORDER BY finish) AS finishes FROM (SELECT model, coalesce(finish, 'unknown') AS finish, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1)
 SELECT model, count(*) AS prompts, count(*) FILTER (WHERE err) AS errors, string_agg(DISTINCT resolved, ',' ORDER BY resolved) AS resolved, any_value(finishes) AS finishes FROM l JOIN f USING (model) GROUP BY model""")
def _(spark, sf):
    log = D.table(spark, sf, "events").select((F.col("user_id") % 6).alias("model"), "user_id", "ts", "event_id", "event_type", F.concat(F.lit("v"), F.col("event_id") % 3).alias("resolved"), (F.col("value") < 20).alias("err"))
    return P.results_summary(log, "model", "user_id", [F.col("ts"), F.col("event_id")], "event_type", "resolved", F.col("err"))


# ---------------------------------------------------------------------------------------------------------------- layers

_HIT = "(model * 7 + prompt_id * 3 + run) % 11 = 0"
_I = ", ".join(f"max(CASE WHEN run = {r} THEN CAST({e} AS INT) END) AS {e}{r}" for e in ("execution", "signature") for r in (1, 2, 3))


def _layer_columns(e):
    low, high = (f"round({f}({', '.join(f'avg({e}{r}) FILTER (WHERE NOT hit)' for r in (1, 2, 3))}), 6)" for f in ("least", "greatest"))
    runs = ", ".join(f"round(avg({e}{r}), 6) AS {e}_run{r}" for r in (1, 2, 3))
    same = f"round(avg((CAST({e}1 = {e}2 AS INT) + CAST({e}1 = {e}3 AS INT) + CAST({e}2 = {e}3 AS INT)) / 3) FILTER (WHERE NOT hit), 6)"
    return f"{runs}, {low} AS common_{e}_low, {high} AS common_{e}_high, {same} AS common_{e}_agreement"


@query("sequential_layers", f"""WITH i AS (SELECT model, prompt_id, bool_or({_HIT}) AS hit, {_I} FROM runs GROUP BY 1, 2), d AS (SELECT prompt_id, CASE WHEN prompt_id % 2 = 0 THEN 'original' ELSE 'confirmatory' END AS layer FROM (SELECT DISTINCT prompt_id FROM runs)),
 l AS (SELECT layer, i.* FROM i JOIN d USING (prompt_id) UNION ALL SELECT 'pooled', * FROM i) SELECT layer, count(DISTINCT prompt_id) AS prompts, count(*) AS cells, count(*) FILTER (WHERE NOT hit) AS common_cells, {_layer_columns('execution')}, {_layer_columns('signature')} FROM l GROUP BY layer""")
def _(spark, sf):
    dimension = spark.range(154).select(F.when(F.col("id") % 2 == 0, "original").otherwise("confirmatory").alias("layer"), F.col("id").alias("prompt_id"))
    out = P.layers(D.runs(spark, sf), dimension, F.expr(_HIT))
    return r6(out, *[c for c in out.columns if c.split("_")[0] in ("execution", "signature") or c.startswith(("common_execution", "common_signature"))])


# ----------------------------------------------------------------------------------------------------------------- tapes

# A tape of an order's lines, against the same lines in another order, with every twelfth order's phase turned round once.
_TP = """o AS (SELECT l_orderkey AS k, list(l_linenumber % 3 ORDER BY l_linenumber, l_partkey) AS na, list(l_linenumber % 3 ORDER BY l_partkey, l_linenumber) AS nb, list(l_linenumber % 2 ORDER BY l_linenumber, l_partkey) AS qa, list(l_linenumber % 2 ORDER BY l_partkey, l_linenumber) AS qb,
 list(round(l_tax, 1) ORDER BY l_linenumber, l_partkey) AS pa, list(round(l_tax, 1) ORDER BY l_partkey, l_linenumber) AS pb, list(l_linenumber % 2 ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_linenumber % 3 = 0) AS ma, list(l_linenumber % 2 ORDER BY l_partkey, l_linenumber) FILTER (WHERE l_linenumber % 3 = 0) AS mb FROM lineitem GROUP BY 1),
 t AS (SELECT k, na = nb AS gate_order_match, qa = qb AS quantum_operand_sequence_match, true AS classical_operand_sequence_match, k % 5 <> 0 AS circuit_shape_match, na = nb AND qa = qb AS operation_wire_tape_match, k % 5 <> 0 AND na = nb AND qa = qb AS ordered_wire_tape_match, ma IS NOT DISTINCT FROM mb AS measurement_map_match,
 pa = pb AS parameter_token_sequence_match, k % 5 <> 0 AND na = nb AND qa = qb AND pa = pb AS parameter_aware_tape_match, k % 7 <> 0 AS global_phase_match, k % 5 <> 0 AND na = nb AND qa = qb AND pa = pb AND k % 7 <> 0 AS full_literal_circuit_match, ma IS NOT NULL AS measured FROM o)"""
_EQUAL = ("gate_order_match", "quantum_operand_sequence_match", "classical_operand_sequence_match", "circuit_shape_match", "operation_wire_tape_match", "ordered_wire_tape_match", "measurement_map_match", "parameter_token_sequence_match", "parameter_aware_tape_match", "global_phase_match", "full_literal_circuit_match")


def _tapes(spark, sf):
    n = F.col("l_linenumber")
    name = F.when(n % 3 == 0, "measure").otherwise((n % 3).cast("string"))
    op = F.struct(name.alias("name"), F.array(n % 2).alias("qubits"), F.array().cast("array<int>").alias("clbits"), F.array(X.parameter_token(F.round("l_tax", 1).cast("string"))).alias("params")).alias("op")
    tape = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, op))), lambda x: x["op"])
    o = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(tape("l_linenumber", "l_partkey").alias("a"), tape("l_partkey", "l_linenumber").alias("b"))
    turned = F.when(F.col("k") % 7 == 0, "0.5").when(F.col("k") % 12 == 0, "6.533185307179586").otherwise("0.25")
    phases = X.parameter_token(F.lit("0.25")), X.parameter_token(turned)
    same = X.compare_tapes(F.col("a"), F.col("b"), *phases, F.struct(F.lit(2).alias("q"), F.lit(0).alias("c")), F.struct(F.when(F.col("k") % 5 == 0, 3).otherwise(2).alias("q"), F.lit(0).alias("c")))
    return o.select("k", *[c.alias(x) for x, c in same.items()], F.exists("a", lambda x: x["name"] == "measure").alias("measured"))


@query("tape_compare", f"WITH {_TP} SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {c}) AS {c}' for c in _EQUAL)} FROM t")
def _(spark, sf):
    return _tapes(spark, sf).agg(F.count("*").alias("n"), *[X.ones(F.col(c)).alias(c) for c in _EQUAL])


_AG = P.AGREEMENTS
_PASSED = "replayed AND signature"


@query("tape_summary", f"""WITH {_TP}, c AS (SELECT *, k % 3 AS model, k % 4 <> 0 AS executable, CASE WHEN k % 8 = 1 THEN NULL ELSE k % 4 <> 0 END AS replayed, k % 2 = 0 OR k % 4 = 1 AS signature, k % 9 <> 0 AS consistent FROM t)
 SELECT model, count(*) AS cells, count(*) FILTER (WHERE executable) AS executable, count(*) FILTER (WHERE replayed) AS replayed, count(*) FILTER (WHERE executable) - count(*) FILTER (WHERE replayed) AS replay_failures, count(*) FILTER (WHERE signature) AS signatures, count(*) FILTER (WHERE {_PASSED}) AS denominator,
 count(*) FILTER (WHERE replayed AND NOT consistent) AS disagreements, count(*) FILTER (WHERE {_PASSED} AND measured) AS measured, count(*) FILTER (WHERE {_PASSED} AND measured AND measurement_map_match) AS measurement_map, {', '.join(f'count(*) FILTER (WHERE {_PASSED} AND {c}) AS {n}' for n, c in _AG.items())},
 count(*) FILTER (WHERE replayed AND ordered_wire_tape_match AND NOT signature) AS wire_outside_signature, {', '.join(f'round(count(*) FILTER (WHERE {_PASSED} AND {c}) / nullif(count(*) FILTER (WHERE {_PASSED}), 0), 6) AS {n}_rate' for n, c in _AG.items())},
 round(count(*) FILTER (WHERE {_PASSED} AND measured AND measurement_map_match) / nullif(count(*) FILTER (WHERE {_PASSED} AND measured), 0), 6) AS measurement_map_rate FROM c GROUP BY model""")
def _(spark, sf):
    k = F.col("k")
    cells = _tapes(spark, sf).withColumns({"model": k % 3, "executable": k % 4 != 0, "replayed": F.when(k % 8 != 1, k % 4 != 0), "signature": (k % 2 == 0) | (k % 4 == 1), "consistent": k % 9 != 0})
    out = P.tape_summary(cells, "model")
    return r6(out, *[c for c in out.columns if c.endswith("_rate")])


# -------------------------------------------------------------------------------------------------------------- features

_META = {"repo_owner": "strategy", "source": "bucket", "num_qubits": "qubits", "gate_count": "gates", "has_measurement": "demo"}
_GATES = "[{'g': 'barrier', 'n': n_barrier}, {'g': 'cx', 'n': n_cx}, {'g': 'h', 'n': n_h}]"


def _gates():
    return F.create_map(F.lit("h"), F.col("n_h"), F.lit("cx"), F.col("n_cx"), F.lit("barrier"), F.col("n_barrier"))


@query("metadata_texts", f"""SELECT sha256(t) AS digest, count(*) AS n FROM (SELECT concat_ws(' ', strategy, bucket, 'num_qubits_' || qubits, 'gate_count_' || gates, 'has_measurement_' || CASE WHEN demo THEN 'True' WHEN NOT demo THEN 'False' END,
 array_to_string(flatten(list_transform({_GATES}, lambda x: list_concat(['gate_' || x.g], list_transform(range(CAST(least(coalesce(nullif(x.n, 0), 1), 3) AS BIGINT)), lambda i: x.g)))), ' ')) AS t FROM harness) GROUP BY 1""")
def _(spark, sf):
    text = T.metadata_text({n: F.col(c) for n, c in _META.items()}, _gates())
    return D.harness(spark, sf).groupBy(F.sha2(text, 256).alias("digest")).agg(F.count("*").alias("n"))


_SETS = {"source_proxy": (("strategy", "bucket"), (), False), "structural": (("status", "demo"), ("lines", "gates"), True), "broad": (("status", "confidence", "strategy", "bucket", "mutation"), ("lines", "gates", "qubits"), True)}


def _tokens_sql(name):
    cats, nums, gates = _SETS[name]
    norm = lambda c: f"'{c}=' || CASE WHEN {c} IS NULL THEN '<missing>' WHEN trim(CAST({c} AS VARCHAR)) = '' THEN '<empty>' ELSE trim(CAST({c} AS VARCHAR)) END"
    binned = lambda c: f"'{c}_bin=' || CASE WHEN {c} IS NULL THEN '<missing>' ELSE (SELECT {_BIN} FROM (SELECT CAST({c} AS DOUBLE) AS x)) END"
    out = "[" + ", ".join([*map(norm, cats), *map(binned, nums)]) + "]"
    rep = f"flatten(list_transform({_GATES}, lambda x: list_transform(range(CAST(least(coalesce(nullif(x.n, 0), 1), 5) AS BIGINT)), lambda i: 'gate=' || x.g)))"
    return f"list_concat({out}, {rep})" if gates else out


@query("feature_sets", " UNION ALL ".join(f"SELECT '{n}' AS feature_set, term, count(*) AS n FROM (SELECT unnest({_tokens_sql(n)}) AS term FROM harness) GROUP BY term" for n in _SETS))
def _(spark, sf):
    out, rows = None, D.harness(spark, sf)
    for name, (cats, nums, gates) in _SETS.items():
        tokens = T.feature_tokens({c: F.col(c) for c in cats}, {c: F.col(c) for c in nums}, _gates() if gates else None)
        part = X.each_of(rows, tokens, "term", F.lit(name).alias("feature_set")).groupBy("feature_set", "term").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# Fields of the declared sets that documents have; a document's characters stand for gates, its text for code.
_FIELDS = {"source": "source", "language": "lang", "prompt_length_chars": "n_chars", "code_lines": "n_lines", "has_measurement": "n_chars > 500"}
_DOC_GATES = "[{'g': 'cx', 'n': n_chars % 9}, {'g': 'h', 'n': doc_id % 4}]"


def _set_sql(chosen):
    norm = lambda n: f"'{n}=' || " + (f"CASE WHEN {_FIELDS[n]} IS NULL THEN '<missing>' WHEN trim(CAST({_FIELDS[n]} AS VARCHAR)) = '' THEN '<empty>' ELSE trim(CAST({_FIELDS[n]} AS VARCHAR)) END" if n in _FIELDS else "'<missing>'")
    binned = lambda n: f"'{n}_bin=' || " + (f"CASE WHEN {_FIELDS[n]} IS NULL THEN '<missing>' ELSE (SELECT {_BIN} FROM (SELECT CAST({_FIELDS[n]} AS DOUBLE) AS x)) END" if n in _FIELDS else "'<missing>'")
    parts = ["[" + ", ".join([*map(norm, chosen.categorical), *map(binned, chosen.numeric)]) + "]"] if chosen.categorical or chosen.numeric else []
    if chosen.gates:
        parts.append(f"flatten(list_transform({_DOC_GATES}, lambda x: list_transform(range(CAST(least(coalesce(nullif(x.n, 0), 1), 5) AS BIGINT)), lambda i: 'gate=' || x.g)))")
    return " || ".join([*parts, _CODE] if chosen.code else parts)


_DECLARED = {f"{base}/{name}": chosen for base, sets in T.FEATURE_SETS.items() for name, chosen in sets.items()}


@query("declared_feature_sets", "WITH d AS (SELECT *, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS feature_set, term, count(*) AS n FROM (SELECT unnest({_set_sql(c)}) AS term FROM d) GROUP BY term" for n, c in _DECLARED.items()))
def _(spark, sf):
    docs = D.table(spark, sf, "documents").withColumn("n_lines", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    gates = F.create_map(F.lit("cx"), F.col("n_chars") % 9, F.lit("h"), F.col("doc_id") % 4)
    fields = {n: F.expr(e) for n, e in _FIELDS.items()}
    each = [F.struct(F.lit(n).alias("feature_set"), T.set_tokens(c, fields, gates, F.col("text")).alias("terms")) for n, c in _DECLARED.items()]
    return X.each_of(docs.select(F.inline(F.array(*each))), F.col("terms"), "term", "feature_set").groupBy("feature_set", "term").agg(F.count("*").alias("n"))


_CODES = ["for i in range(n * 2): pass", "x = [0] * (n+1)", "2*n gates", "qc = f(n)"]


@query("problem_size", f"""WITH c AS (SELECT greatest(coalesce(qubits, 1), 1) AS q, greatest(coalesce(n_barrier, 0), 0) AS c, replace({_CODES!r}[CAST(row_id % 4 + 1 AS BIGINT)], ' ', '') AS t FROM harness)
 SELECT size, count(*) AS n FROM (SELECT CAST(CASE WHEN contains(t, 'n*2') OR contains(t, '2*n') THEN greatest(q // 2, 1) WHEN contains(t, 'n+1') OR contains(t, '1+n') THEN CASE WHEN c > 0 THEN c ELSE greatest(q - 1, 1) END WHEN c > 0 AND c <= q THEN c ELSE q END AS BIGINT) AS size FROM c) GROUP BY size""")
def _(spark, sf):
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("row_id") % 4 + 1).cast("int"))
    return D.harness(spark, sf).groupBy(T.problem_size(F.col("qubits"), F.col("n_barrier"), code, F.lit("n")).alias("size")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------------------------- baselines

_SPLIT = "part = 0"
_STRESS = "CASE WHEN coalesce(mutation, false) THEN 'mutation_stress' ELSE 'clean_control' END"


@query("majority_baseline", f"""WITH h AS (SELECT *, {_STRESS} AS y FROM harness), m AS (SELECT y FROM h WHERE NOT ({_SPLIT}) GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)
 SELECT count(*) AS n, round(avg(CAST(h.y = m.y AS INT)), 6) AS accuracy FROM h, m WHERE {_SPLIT}""")
def _(spark, sf):
    rows = D.harness(spark, sf).select((F.col("part") == 0).alias("test"), F.expr(_STRESS).alias("y"))
    major = rows.where("not test").groupBy("y").agg(F.count("*").alias("n")).agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("major"))
    return r6(rows.where("test").crossJoin(F.broadcast(major)).agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("major")).cast("int")).alias("accuracy")), "accuracy")


@query("direct_flag_baseline", f"""WITH h AS (SELECT {_STRESS} AS t, CASE WHEN strategy = 'search' THEN 'mutation_stress' ELSE 'clean_control' END AS p FROM harness WHERE {_SPLIT})
 SELECT count(*) AS n, round(avg(CAST(t = p AS INT)), 6) AS accuracy, round(avg(CAST(p = 'clean_control' AS INT)) FILTER (WHERE t = 'mutation_stress'), 6) AS missed, round(avg(CAST(p = 'mutation_stress' AS INT)) FILTER (WHERE t <> 'mutation_stress'), 6) AS called,
 round((count(*) FILTER (WHERE t = 'mutation_stress' AND p = 'mutation_stress') / count(*) FILTER (WHERE t = 'mutation_stress') + count(*) FILTER (WHERE t <> 'mutation_stress' AND p <> 'mutation_stress') / count(*) FILTER (WHERE t <> 'mutation_stress')) / 2, 6) AS auroc FROM h""")
def _(spark, sf):
    flag = F.coalesce(F.col("strategy") == "search", F.lit(False))
    rows = D.harness(spark, sf).where("part = 0").withColumn("t", F.expr(_STRESS))
    return r6(N.baseline_metrics(rows, "t", F.when(flag, "mutation_stress").otherwise("clean_control"), flag.cast("int"), "mutation_stress"), "accuracy", "missed", "called", "auroc")


_NBH = f"""tk AS (SELECT row_id, label, {_STRESS} AS y, {_SPLIT} AS test, {_tokens_sql('structural')} AS tokens FROM harness), pr AS (SELECT y, ln((count(*) + 1) / (sum(count(*)) OVER () + count(*) OVER ())) AS smoothed, -ln(count(*) OVER ()) AS uniform FROM tk WHERE NOT test GROUP BY y),
 ct AS (SELECT y, term, count(*) AS c FROM (SELECT y, unnest(tokens) AS term FROM tk WHERE NOT test) GROUP BY 1, 2), sm AS (SELECT y, sum(c) AS t, (SELECT count(DISTINCT term) FROM ct) AS v FROM ct GROUP BY y), te AS (SELECT row_id, unnest(tokens) AS term FROM tk WHERE test),
 sc AS (SELECT te.row_id, pr.y, any_value(smoothed) AS smoothed, any_value(uniform) AS uniform, sum(ln((coalesce(c, 0) + 1) / (t + v))) AS s FROM te CROSS JOIN pr JOIN sm ON sm.y = pr.y LEFT JOIN ct ON ct.y = pr.y AND ct.term = te.term GROUP BY 1, 2),
 pd AS (SELECT row_id, max(s + smoothed) FILTER (WHERE y = 'mutation_stress') - max(s + smoothed) FILTER (WHERE y = 'clean_control') AS m, max(s + uniform) FILTER (WHERE y = 'mutation_stress') - max(s + uniform) FILTER (WHERE y = 'clean_control') AS u FROM sc GROUP BY 1)"""


def _stress(spark, sf):
    """(label, truth, n, smoothed, uniform): margins of the two-label classifier on structural tokens with smoothed and with uniform
    priors, whole, for the n rows that have the same tokens, label and truth; ties go to stress. Each bag of tokens is scored once."""
    cats, nums, _ = _SETS["structural"]
    tokens = T.feature_tokens({c: F.col(c) for c in cats}, {c: F.col(c) for c in nums}, _gates())
    rows = D.harness(spark, sf).select("label", F.expr(_STRESS).alias("y"), (F.col("part") == 0).alias("test"), F.array_sort(tokens).alias("tokens"))
    counts = settle(rows.groupBy("label", "y", "test", "tokens").agg(F.count("*").alias("n")), "bags")
    tests = counts.where("test")
    out = tests.select("label", F.col("y").alias("truth"), "tokens", "n")
    bags = tests.groupBy("tokens").agg(F.first("y").alias("y"))
    at = lambda y: F.max(F.when(F.col("y") == y, F.col("score")))
    for name in ("smoothed", "uniform"):
        scores = N.score_nb(bags, "tokens", "y", F.col("tokens"), N.fit_nb(counts.where("not test"), "y", F.col("tokens"), prior=name, n="n"), digits=None)
        out = out.join(scores.groupBy("tokens").agg((at("mutation_stress") - at("clean_control")).alias(name)), "tokens")
    return out


def _called(margin):
    """How many rows go to stress."""
    return F.coalesce(F.sum(F.when(F.round(margin, 6) >= 0, F.col("n"))), F.lit(0))


@query("stress_margins", f"WITH {_NBH} SELECT count(*) AS n, round(sum(m), 2) AS smoothed, round(sum(u), 2) AS uniform, count(*) FILTER (WHERE round(m, 6) >= 0) AS stress, count(*) FILTER (WHERE round(u, 6) >= 0) AS stress_uniform FROM pd")
def _(spark, sf):
    s = _stress(spark, sf)
    total = lambda c: F.round(F.sum(F.col(c) * F.col("n")), 2).alias(c)
    return s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), total("smoothed"), total("uniform"), _called("smoothed").alias("stress"), _called("uniform").alias("stress_uniform"))


@query("false_positive_by_slice", f"WITH {_NBH} SELECT label AS slice, count(*) AS support, count(*) FILTER (WHERE round(m, 6) >= 0) AS false_stress, round(count(*) FILTER (WHERE round(m, 6) >= 0) / count(*), 6) AS rate FROM pd JOIN tk USING (row_id) WHERE y = 'clean_control' GROUP BY label")
def _(spark, sf):
    clean = _stress(spark, sf).where("truth = 'clean_control'").groupBy(F.col("label").alias("slice"))
    wrong = _called("smoothed")
    return r6(clean.agg(F.sum("n").alias("support"), wrong.alias("false_stress"), X.rate(wrong, F.sum("n")).alias("rate")), "rate")


# -------------------------------------------------------------------------------------------------------------- families

_FAM = "CASE WHEN prompt_id % 10 = 0 THEN ['a' || prompt_id % 4, 'b'] WHEN prompt_id > 151 THEN ['tiny'] ELSE ['c' || prompt_id % 3] END"


@query("family_macro_forms", f"""WITH f AS (SELECT prompt_id, {_FAM} AS l FROM features), ml AS (SELECT prompt_id, unnest(l) AS family FROM f), p AS (SELECT prompt_id, l[1] AS family FROM f), z AS (SELECT family, count(*) AS n FROM p GROUP BY 1),
 rp AS (SELECT prompt_id, CASE WHEN n < 3 THEN 'rare' ELSE family END AS family FROM p JOIN z USING (family)), r AS (SELECT 'multi_label' AS form, family, avg(CAST(signature AS INT)) AS rate FROM cells JOIN ml USING (prompt_id) GROUP BY family
 UNION ALL SELECT 'primary', family, avg(CAST(signature AS INT)) FROM cells JOIN p USING (prompt_id) GROUP BY family UNION ALL SELECT 'rare_pooled', family, avg(CAST(signature AS INT)) FROM cells JOIN rp USING (prompt_id) GROUP BY family)
 SELECT form, count(*) AS families, round(avg(rate), 6) AS rate FROM r GROUP BY form UNION ALL SELECT 'micro', 1, round(avg(CAST(signature AS INT)), 6) FROM cells""")
def _(spark, sf):
    p = F.col("prompt_id")
    labels = F.when(p % 10 == 0, F.array(F.concat(F.lit("a"), p % 4), F.lit("b"))).when(p > 151, F.array(F.lit("tiny"))).otherwise(F.array(F.concat(F.lit("c"), p % 3)))
    f = D.features(spark, sf).select("prompt_id", labels.alias("l"))
    return r6(C.macro_rates(D.cells(spark, sf), f.select("prompt_id", F.explode("l").alias("family")), f.select("prompt_id", F.col("l")[0].alias("family"))), "rate")


@query("tier_upgrades", """SELECT b.b AS before, b.a AS after, m AS metric, round(CASE m WHEN 'rate' THEN x.rate ELSE x.exec_rate END, 6) AS low, round(CASE m WHEN 'rate' THEN y.rate ELSE y.exec_rate END, 6) AS high, round(CASE m WHEN 'rate' THEN y.rate - x.rate ELSE y.exec_rate - x.exec_rate END, 6) AS delta
 FROM (VALUES ('1', '2'), ('4', '8')) AS b(b, a) JOIN model_rates x ON CAST(x.model AS VARCHAR) = b.b JOIN model_rates y ON CAST(y.model AS VARCHAR) = b.a, (VALUES ('rate'), ('execution_rate')) AS k(m)""")
def _(spark, sf):
    rates = C.group_rates(D.cells(spark, sf), "model").select("model", F.col("signature_rate").alias("rate"), "execution_rate")
    return r6(C.upgrades(rates, [("1", "2"), ("4", "8")], ["rate", "execution_rate"]), "low", "high", "delta")


# Four programs and what is left of them; the row's number picks one and its name.
_PROGRAMS = ["qc{k} = f({k})\nprint(qc{k})\nqc{k}.draw()", "fig = qc.draw()\nx = {k}", "fig = qc.draw()\nfig.show({k})", "def broken({k}"]
_LEFT = ["qc{k} = f({k})\n", "x = {k}\n", "fig = qc.draw()\nfig.show({k})\n", None]


@query("presentation_stripped", "SELECT n_nationkey AS k, CASE n_nationkey % 4 " + " ".join("WHEN " + str(i) + " THEN " + ("NULL" if c is None else "replace(replace('" + c.replace("\n", "|") + "', '{k}', CAST(n_nationkey AS VARCHAR)), '|', chr(10))") for i, c in enumerate(_LEFT)) + " END AS code FROM nation")
def _(spark, sf):
    k = F.col("n_nationkey")
    code = F.replace(F.element_at(F.array(*map(F.lit, _PROGRAMS)), k % 4 + 1), F.lit("{k}"), k.cast("string"))
    return D.table(spark, sf, "nation").select(k.alias("k"), presentation_stripped(code).alias("code"))


# --------------------------------------------------------------------------------------------------- prompts and attempts


@query("prompt_rates", "SELECT prompt_id, count(*) AS models, round(avg(CAST(execution AS INT)), 6) AS execution_rate, round(avg(CAST(signature AS INT)), 6) AS signature_rate FROM cells GROUP BY 1")
def _(spark, sf):
    mean = lambda c: F.avg(F.col(c).cast("int"))
    return r6(D.cells(spark, sf).groupBy("prompt_id").agg(F.count("*").alias("models"), mean("execution").alias("execution_rate"), mean("signature").alias("signature_rate")), "execution_rate", "signature_rate")


@query("rate_quantiles", "WITH p AS (SELECT avg(CAST(signature AS INT)) AS x FROM cells GROUP BY prompt_id) SELECT q, round(v, 6) AS value FROM (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q, unnest((SELECT quantile_cont(x, [0.1, 0.25, 0.5, 0.75, 0.9]) FROM p)) AS v)")
def _(spark, sf):
    p = D.cells(spark, sf).groupBy("prompt_id").agg(F.avg(F.col("signature").cast("int")).alias("x"))
    return r6(O.quantiles(settle(p, "rates"), F.col("x"), [0.1, 0.25, 0.5, 0.75, 0.9]), "value")


@query("price_quantiles", "SELECT q, round(v, 6) AS value FROM (SELECT unnest([0.01, 0.5, 0.999]) AS q, unnest((SELECT quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.01, 0.5, 0.999]) FROM lineitem)) AS v)")
def _(spark, sf):
    return r6(O.quantiles(D.table(spark, sf, "lineitem"), F.col("l_extendedprice"), [0.01, 0.5, 0.999]), "value")


_NAMED = "[CASE WHEN n_h > 0 THEN 'h' END, CASE WHEN n_cx > 0 THEN 'cx' END, CASE WHEN n_barrier > 0 THEN 'barrier' END, CASE WHEN qubits = 3 THEN 'rz' END, CASE WHEN qubits = 2 THEN 'measure' END]"
_FLAGGED = {
    "has_measure": "list_contains(g, 'measure')", "has_barrier": "list_contains(g, 'barrier')", "has_controlled_or_entangling": "list_contains(g, 'cx')", "has_rotation": "list_contains(g, 'rz')",
    "high_gate_diversity": "len(g) >= 5", "high_gate_count": "coalesce(lines, 0) >= 13",
}


@query("set_flags", f"SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}' for n, c in _FLAGGED.items())} FROM (SELECT lines, list_filter({_NAMED}, lambda x: x IS NOT NULL) AS g FROM harness)")
def _(spark, sf):
    each = [("h", F.col("n_h") > 0), ("cx", F.col("n_cx") > 0), ("barrier", F.col("n_barrier") > 0), ("rz", F.col("qubits") == 3), ("measure", F.col("qubits") == 2)]
    counts = F.map_from_entries(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("key"), F.lit(1).alias("value"))) for n, c in each])))
    flags = X.set_flags(counts, F.col("lines"))
    return D.harness(spark, sf).agg(F.count("*").alias("n"), *[X.ones(c).alias(n) for n, c in flags.items()])


@query("context_recovery", """SELECT error AS symbol, count(*) AS n, count(*) FILTER (WHERE executed) AS before, count(*) FILTER (WHERE executed OR gates = 3) AS after, count(*) FILTER (WHERE NOT executed AND gates = 3) AS recovered,
 round(count(*) FILTER (WHERE NOT executed AND gates = 3) / nullif(count(*) FILTER (WHERE NOT executed), 0), 6) AS recovery_rate FROM harness GROUP BY error""")
def _(spark, sf):
    after = F.col("executed") | F.coalesce(F.col("gates") == 3, F.lit(False))
    return r6(R.recovery_summary(D.harness(spark, sf), F.col("executed"), after, F.col("error")), "recovery_rate")


@query("interrupted_attempts", """WITH l AS (SELECT user_id, arg_max(value < 20, ts * 1 + 0) AS open FROM (SELECT user_id, value, epoch_us(ts)::HUGEINT * 100000000 + event_id AS ts FROM events) GROUP BY 1)
 SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'acknowledged' ELSE 'uncertain_interrupted' END AS status FROM l WHERE open""")
def _(spark, sf):
    log = D.table(spark, sf, "events")
    return R.interrupted(log, "user_id", [F.col("ts"), F.col("event_id")], F.col("value") < 20, F.col("user_id") % 5 == 0)
