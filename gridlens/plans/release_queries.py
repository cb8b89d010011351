"""What a comparison with a frozen release must pass: denominators, manifests, counts, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cells as C
from ..operators import release as G
from . import fixtures as D
from .cells_queries import _RATES, _SUMS, r6
from .registry import query

_CAND = "cand AS (SELECT * FROM cells WHERE model >= 19 AND prompt_id < 100 AND NOT (model = 19 AND prompt_id IN (4, 8))), froz AS (SELECT * FROM cells WHERE model < 19 AND prompt_id >= 2)"


def _sides(spark, sf):
    cells = D.cells(spark, sf)
    return cells.where("model >= 19 and prompt_id < 100 and not (model = 19 and prompt_id in (4, 8))"), cells.where("model < 19 and prompt_id >= 2")


@query("denominator_alignment", f"""WITH {_CAND} SELECT prompt_id, 'not shared' AS fault FROM cand GROUP BY 1 HAVING count(DISTINCT model) < (SELECT count(DISTINCT model) FROM cand)
 UNION ALL SELECT DISTINCT prompt_id, 'unknown' FROM cand WHERE prompt_id NOT IN (SELECT prompt_id FROM froz) UNION ALL SELECT DISTINCT prompt_id, 'missing' FROM froz WHERE prompt_id NOT IN (SELECT prompt_id FROM cand)""")
def _(spark, sf):
    return G.denominators(*_sides(spark, sf))


@query("comparison_scope", """WITH c AS (SELECT DISTINCT prompt_id FROM cells WHERE model = 5 AND prompt_id < 100) SELECT CASE WHEN (SELECT count(DISTINCT prompt_id) FROM cells WHERE model <> 5) > (SELECT count(*) FROM c) THEN 'matched_subset' ELSE 'full_test_set' END AS mode,
 (SELECT count(*) FROM c) AS prompts, (SELECT sha256(string_agg(CAST(prompt_id AS VARCHAR), chr(10) ORDER BY CAST(prompt_id AS VARCHAR)) || chr(10)) FROM c) AS ids_sha256, (SELECT count(*) FROM cells WHERE model = 5 AND prompt_id < 100) AS candidate_cells,
 (SELECT count(*) FROM cells WHERE model <> 5 AND prompt_id IN (SELECT prompt_id FROM c)) AS frozen_cells""")
def _(spark, sf):
    cells = D.cells(spark, sf)
    scope = G.align(cells.where("model = 5 and prompt_id < 100"), cells.where("model <> 5"), allow_partial=True)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(scope.candidate, "candidate_cells").crossJoin(count(scope.frozen, "frozen_cells")).select(F.lit(scope.mode).alias("mode"), F.lit(scope.prompts).cast("long").alias("prompts"), F.lit(scope.ids_sha256).alias("ids_sha256"), "*")


_OUT = "prompt_id NOT IN (3, 50, 77, 120)"


@query("identifiable_summary", f"""SELECT s.*, k.cells AS identifiable_cells, k.execution AS identifiable_execution, k.signature AS identifiable_signature, k.execution - k.signature AS identifiable_disagreement,
 round((k.execution - k.signature) / nullif(k.execution, 0), 6) AS identifiable_disagreement_rate FROM (SELECT {_RATES} FROM (SELECT model, {_SUMS} FROM cells GROUP BY model)) s
 JOIN (SELECT model, {_SUMS} FROM cells WHERE {_OUT} GROUP BY model) k USING (model)""")
def _(spark, sf):
    out = G.with_identifiable(D.cells(spark, sf), [3, 50, 77, 120], "model")
    return r6(out, *[c for c in out.columns if c.endswith(("_rate", "_share"))])


_KEYS = "[" + ", ".join(f"struct_pack(key := '{k}', expected := CAST({v} AS BIGINT), observed := CAST({k} AS BIGINT))" for k, v in G.CANONICAL_COUNTS.items()) + "]"
_HAS = "count(*) FILTER (WHERE {})"
_WHOLE = f"SELECT count(*) AS cells, count(DISTINCT model) AS models, count(DISTINCT prompt_id) AS prompts, {', '.join(_HAS.format(c) + ' AS ' + c for c in ('execution', 'assembly', 'signature', 'ordered', 'parameter'))}, {_HAS.format('execution')} - {_HAS.format('assembly')} AS attrition, {_HAS.format('assembly')} - {_HAS.format('signature')} AS as_gap, {_HAS.format('assembly AND NOT signature')} AS assembly_without_signature, {_HAS.format('signature AND NOT assembly')} AS signature_without_assembly FROM cells"
_PART = f"SELECT count(*) AS identifiable_cells, {_HAS.format('execution')} AS identifiable_execution, {_HAS.format('signature')} AS identifiable_signature, {_HAS.format('execution')} - {_HAS.format('signature')} AS identifiable_disagreement FROM cells WHERE {_OUT}"


@query("count_parity", f"SELECT e.key, e.expected, e.observed FROM (SELECT unnest({_KEYS}) AS e FROM ({_WHOLE}), ({_PART})) WHERE e.expected <> e.observed")
def _(spark, sf):
    """The panel at hand against the release's frozen counts: what differs."""
    return G.canonical_faults(D.cells(spark, sf), [3, 50, 77, 120])


@query("repeat_parity", "SELECT e.key, e.expected, e.observed FROM (SELECT unnest([{'key': 'cells', 'expected': 4536, 'observed': count(*)}, {'key': 'models', 'expected': 21, 'observed': count(DISTINCT model)}, {'key': 'prompts', 'expected': 72, 'observed': count(DISTINCT prompt_id)}, {'key': 'runs', 'expected': 3, 'observed': count(DISTINCT run)}]) AS e FROM runs) WHERE e.expected <> e.observed")
def _(spark, sf):
    return G.repeat_faults(D.runs(spark, sf))


@query("identifiable_tidy", f"""WITH k AS (SELECT count(*) AS c, {_HAS.format('execution')} AS e, {_HAS.format('signature')} AS m FROM cells WHERE {_OUT})
 SELECT 'identifiable' AS section, metric, true AS available, CAST(n AS BIGINT) AS count, CAST(d AS BIGINT) AS denominator, round(n / nullif(d, 0), 6) AS rate FROM (SELECT unnest(['identifiable_cells', 'identifiable_execution', 'identifiable_signature', 'identifiable_disagreement']) AS metric, unnest([c, e, m, e - m]) AS n, unnest([c, c, c, e]) AS d FROM k)""")
def _(spark, sf):
    return r6(C.tidy(G.with_identifiable(D.cells(spark, sf), [3, 50, 77, 120]), C.IDENTIFIABLE), "rate")


@query("model_places", f"""WITH own AS (SELECT * FROM cells WHERE model IN (SELECT model FROM runs)), r AS (SELECT model, round(avg(CAST(signature AS INT)), 6) AS repeat_rate FROM runs GROUP BY 1),
 m AS (SELECT model, {_HAS.format('execution')} AS execution, {_HAS.format('signature')} AS signature, {_HAS.format('ordered')} AS ordered_count, {_HAS.format('parameter')} AS parameter_count, count(*) AS cells FROM own GROUP BY 1)
 SELECT model, execution, signature, ordered_count, parameter_count, repeat_rate, CAST(row_number() OVER (ORDER BY signature / cells DESC, execution / cells DESC, CAST(model AS VARCHAR)) AS INT) AS place FROM m JOIN r USING (model)""")
def _(spark, sf):
    runs = D.runs(spark, sf)
    own = D.cells(spark, sf).join(runs.select("model").distinct(), "model", "left_semi")
    reports = C.summarize(own, "model").drop("ordered", "parameter")
    ordered = own.groupBy("model").agg(X.ones(F.col("ordered")).alias("ordered_count"), X.ones(F.col("parameter")).alias("parameter_count"))
    repeats = runs.groupBy("model").agg(F.round(F.avg(F.col("signature").cast("int")), 6).alias("repeat_rate"))
    out = G.model_rows(reports, ordered, repeats, C.summarize(own))
    return out.select("model", "execution", "signature", "ordered_count", "parameter_count", "repeat_rate", "place")


_RELEASE = {"benchmark_release": "1", "evaluator_version": "2", "predicate_version": "3", "schema_version": "4"}


@query("manifest_gate", """SELECT n_nationkey % 6 AS kind, count(*) AS n, any_value(CASE n_nationkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'missing schema_version,missing run_type' WHEN 2 THEN 'run_type other' WHEN 3 THEN 'evaluator_version: expected 2, observed 9' WHEN 4 THEN 'not an object'
 ELSE 'missing package_version' END) AS faults FROM nation GROUP BY 1""")
def _(spark, sf):
    k = F.col("n_nationkey") % 6
    keep = {"ignoreNullFields": "true"}
    fields = {n: F.lit(v) for n, v in _RELEASE.items()} | {"package_version": F.when(k == 5, "").otherwise("7"), "artifact_manifest_version": F.lit("1"), "run_type": F.when(k == 2, "other").when(k != 1, "live_replication")}
    fields |= {"schema_version": F.when(k != 1, "4"), "evaluator_version": F.when(k == 3, "9").otherwise("2")}
    rows = D.table(spark, sf, "nation").select(k.alias("kind"), F.when(k == 4, "[1").otherwise(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), keep)).alias("manifest"))
    return G.manifest_faults(rows, _RELEASE).groupBy("kind").agg(F.count("*").alias("n"), F.max(F.array_join("faults", ",")).alias("faults")).select(F.col("kind"), "n", "faults")


@query("sensitive_keys", """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k FROM orders)
 SELECT id, unnest(CASE k WHEN 0 THEN ['headers.Authorization', 'headers.list[1].my_api-key', 'x-token'] WHEN 1 THEN ['secret', 'secret.password'] WHEN 2 THEN ['a.b[0].c.d.e[1][0].f.g.h.i.j.k.token'] ELSE [] END) AS path FROM r""")
def _(spark, sf):
    q = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    k, own = F.col("o_orderkey") % 4, q("o_orderpriority")
    shapes = (
        ('{"headers": {"Authorization": ', ', "list": [{"b": 1}, {"my_api-key": 2}]}, "x-token": [1], "tokens": 5}'), ('{"secret": {"password": ', '}, "secretary": "{\\"token\\": 1}"}'),
        ('{"a": {"b": [{"c": {"d": {"e": [0, [{"f": {"g": {"h": {"i": {"j": {"k": {"token": ', ', "n": 1}}}}}}}]]}}}]}}'),
    )
    body = F.concat(F.lit('{"plain": {"deep": [[['), own, F.lit("]]]}}"))
    for n, (before, after) in enumerate(shapes):
        body = F.when(k == n, F.concat(F.lit(before), own, F.lit(after))).otherwise(body)
    return G.sensitive_keys(D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), body.alias("body")), "id", F.col("body"))
