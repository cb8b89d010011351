"""Failure taxonomies, readiness labels and the predicates of an audit of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cells as C
from ..operators import failures as W
from . import fixtures as D
from .cells_queries import r6
from .registry import query
from .text_queries import tok

_SHARE = "SELECT failure, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT {} AS failure, count(*) AS n FROM harness GROUP BY 1)"
_PRIMARY = """CASE WHEN coalesce(empty, false) THEN 'empty_generation' WHEN NOT coalesce(executed, false) THEN 'execution_failure:' || CASE WHEN coalesce(error, '') = '' THEN 'unknown' ELSE error END
 WHEN NOT coalesce(circuit, false) THEN 'no_circuit_found' WHEN coalesce(whole_ok, false) THEN 'structural_match' WHEN NOT coalesce(types_ok, false) THEN 'gate_types_mismatch'
 WHEN NOT coalesce(clbits_ok, false) THEN 'num_clbits_mismatch' WHEN NOT coalesce(qubits_ok, false) THEN 'num_qubits_mismatch' WHEN NOT coalesce(count_ok, false) THEN 'gate_count_mismatch'
 WHEN NOT coalesce(exported, false) THEN 'qasm3_export_failure' ELSE 'structural_other' END"""


@query("primary_failure_taxonomy", _SHARE.format(_PRIMARY))
def _(spark, sf):
    kind = W.primary_failure(*[F.col(c) for c in ("empty", "executed", "error", "circuit", "types_ok", "clbits_ok", "qubits_ok", "count_ok", "whole_ok", "exported")])
    return r6(C.with_share(D.harness(spark, sf).groupBy(kind.alias("failure")).agg(F.count("*").alias("n"))), "share")


_GENERATION = """CASE WHEN NOT coalesce(executed, false) THEN 'execution_failed' WHEN NOT coalesce(circuit, false) THEN 'no_circuit_found' WHEN coalesce(whole_ok, false) THEN 'structural_match'
 WHEN NOT coalesce(qubits_ok, false) THEN 'width_mismatch' WHEN NOT coalesce(types_ok, false) THEN 'gate_type_mismatch' WHEN NOT coalesce(count_ok, false) THEN 'gate_count_mismatch'
 WHEN NOT coalesce(clbits_ok, false) THEN 'classical_width_mismatch' ELSE 'other_structural_mismatch' END"""


@query("generation_failure_taxonomy", f"""SELECT failure, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) FILTER (WHERE label = 'strict_n8') AS strict_n8, count(*) FILTER (WHERE label = 'extended_n8') AS extended_n8
 FROM (SELECT label, {_GENERATION} AS failure FROM harness WHERE NOT coalesce(whole_ok, false)) GROUP BY failure""")
def _(spark, sf):
    kind = W.generation_failure(*[F.col(c) for c in ("executed", "circuit", "qubits_ok", "types_ok", "count_ok", "clbits_ok", "whole_ok")])
    failed = D.harness(spark, sf).where(~W.yes(F.col("whole_ok"))).groupBy(kind.alias("failure"))
    return r6(C.with_share(failed.agg(F.count("*").alias("n"), *[X.ones(F.col("label") == x).alias(x) for x in ("strict_n8", "extended_n8")])), "share")


_READY = """CASE WHEN core AND coalesce(mutation, false) THEN 'mutation_stress_n8' WHEN core AND strategy IS DISTINCT FROM 'empirical_promoted_repo' THEN 'strict_n8' WHEN core THEN 'extended_n8'
 WHEN valid AND coalesce(gates, 0) = 0 THEN 'validated_master_only' WHEN valid THEN 'validated_broad_n8' ELSE 'tier2_unvalidated' END"""
_READY_ROWS = f"""SELECT *, {_READY} AS ready FROM (SELECT *, coalesce(status = 'validated', false) AS valid, coalesce(status = 'validated' AND confidence = 'high', false) AND NOT coalesce(demo, false) AND NOT coalesce(cleanup, false)
 AND coalesce(lines, 0) >= 5 AND coalesce(gates, 0) >= 2 AS core FROM harness)"""


def _ready():
    return W.readiness(*[F.col(c) for c in ("status", "confidence", "demo", "cleanup", "lines", "gates", "strategy", "mutation")])


@query("readiness_cascade", f"SELECT ready AS label, count(*) AS n FROM ({_READY_ROWS}) GROUP BY ready")
def _(spark, sf):
    return D.harness(spark, sf).groupBy(_ready().alias("label")).agg(F.count("*").alias("n"))


@query("release_buckets", f"SELECT ready AS label, coalesce(CASE WHEN ready IN ('strict_n8', 'extended_n8') THEN 'public_open' ELSE bucket END, '<missing>') AS released, count(*) AS n FROM ({_READY_ROWS}) GROUP BY 1, 2")
def _(spark, sf):
    rows = D.harness(spark, sf).select("bucket", _ready().alias("label"))
    return rows.groupBy("label", F.coalesce(W.release_bucket(F.col("label"), F.col("bucket"), True), F.lit("<missing>")).alias("released")).agg(F.count("*").alias("n"))


@query("record_predicates", """SELECT label, count(*) FILTER (WHERE bucket = 'public_open' AND rights LIKE 'redistributable%') AS redistributable, count(*) FILTER (WHERE qubits IS NOT NULL AND gates IS NOT NULL) AS complete,
 count(*) FILTER (WHERE n_h + n_cx = gates) AS consistent, count(*) FILTER (WHERE executed AND circuit AND whole_ok AND exported) AS replayed FROM harness GROUP BY label""")
def _(spark, sf):
    gates = F.create_map(F.lit("h"), "n_h", F.lit("cx"), "n_cx", F.lit("Barrier"), "n_barrier")
    flags = {
        "redistributable": W.redistributable(F.col("bucket"), F.col("rights")), "complete": W.signature_complete(F.col("qubits"), F.lit(0), F.col("gates"), gates),
        "consistent": W.count_consistent(F.col("gates"), gates), "replayed": W.replay_passes(F.col("executed"), F.col("circuit"), F.col("whole_ok"), F.col("exported")),
    }
    return D.harness(spark, sf).groupBy("label").agg(*[X.ones(c).alias(n) for n, c in flags.items()])


# Of each prompt, what is expected and what another prompt in its place would give.
_SAID = ["Grover search over marked items", "quantum key distribution run", "a half-adder from gates", "teleport a state between parties", "random walk on a line", "QFT of a register"]
_PATH = "'src/' || ['Alg', 'demo', 'lib_one'][CAST(prompt_id % 3 + 1 AS BIGINT)] || '/' || ['grover', 'walk', 'swap_test', 'phase'][CAST(prompt_id % 4 + 1 AS BIGINT)] || CASE WHEN prompt_id % 10 < 3 THEN '' ELSE '_' || prompt_id END || '.py'"
_SIDE = f"SELECT prompt_id, gates AS n_gates, qubits, {_PATH} AS path, {_SAID!r}[CAST(prompt_id % 6 + 1 AS BIGINT)] AS said, CASE WHEN types = 0 THEN [] ELSE list_sort(string_split(replace(replace(lower(entries), '\"', ''), ':', '='), ',')) END AS ents FROM features"
_NAMES = "list_transform({}, lambda e: split_part(e, '=', 1))"
_ALG = "list_distinct(list_concat(list_filter({0}, lambda w: list_contains(" + repr(list(W.ALGORITHMS)) + ", w)), list_filter([" + ", ".join(f"CASE WHEN contains(lower({{1}}), '{p}') THEN '{w}' END" for p, w in W.PHRASES) + "], lambda w: w IS NOT NULL)))"


def _apart(times):
    one = lambda c: f"(greatest(abs(a.{c}), abs(b.{c}), 1.0) / greatest(least(abs(a.{c}), abs(b.{c})), 1.0) >= {times})"
    return f"({one('qubits')} OR {one('n_gates')})"


_RETRIEVED = f"""WITH side AS ({_SIDE}), j AS (SELECT a.prompt_id, len(a.ents) > 0 AND a.ents = b.ents AS exact, lower(a.path) AS x, lower(b.path) AS y, {_apart(1.75)} AS off, {_apart('3.0')} AS far,
 CASE WHEN len(list_distinct(list_concat({_NAMES.format('a.ents')}, {_NAMES.format('b.ents')}))) = 0 THEN 0 ELSE len(list_intersect({_NAMES.format('a.ents')}, {_NAMES.format('b.ents')})) / len(list_distinct(list_concat({_NAMES.format('a.ents')}, {_NAMES.format('b.ents')}))) END AS near,
 list_distinct({tok("replace(lower(a.path), '/', ' ')")}) AS u, list_distinct({tok("replace(lower(b.path), '/', ' ')")}) AS v, a.said || ' ' || a.path || ' ' || a.said AS ta, b.path || ' ' || b.said AS tb FROM side a JOIN side b ON b.prompt_id = (a.prompt_id * 7 + 3) % 154),
 k AS (SELECT *, x = y OR ends_with(x, y) OR ends_with(y, x) OR split_part(x, '/', -1) = split_part(y, '/', -1) OR coalesce(len(list_intersect(u, v)) / nullif(least(len(u), len(v)), 0) >= 0.75, false) AS context,
 list_has_any({_ALG.format(tok('ta'), 'ta')}, {_ALG.format(tok('tb'), 'tb')}) AS shared FROM j)
 SELECT failure, count(*) AS n FROM (SELECT CASE WHEN context AND exact THEN 'same_source_register_or_subcircuit' WHEN context THEN 'same_source_lineage_neighbor' WHEN exact THEN 'exact_gate_signature_ambiguity'
 WHEN shared AND (off OR near >= 0.55) THEN 'scaled_family_variant' WHEN shared THEN 'algorithm_family_confusion' WHEN far AND near >= 0.25 THEN 'size_or_complexity_distractor' WHEN near >= 0.40 THEN 'gate_vocabulary_distractor' ELSE 'lexical_metadata_distractor' END AS failure FROM k) GROUP BY failure"""


@query("retrieval_failure_taxonomy", _RETRIEVED)
def _(spark, sf):
    p = F.col("prompt_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (p % n + 1).cast("int"))
    suffix = F.when(p % 10 < 3, "").otherwise(F.concat(F.lit("_"), p))
    path = F.concat(F.lit("src/"), pick(["Alg", "demo", "lib_one"], 3), F.lit("/"), pick(["grover", "walk", "swap_test", "phase"], 4), suffix, F.lit(".py"))
    side = D.features(spark, sf).select("prompt_id", F.struct(F.col("counts").alias("gates"), path.alias("path"), F.col("qubits").alias("qubits"), F.col("gates").alias("count"), pick(_SAID, 6).alias("said")).alias("s"))
    other = side.select(p.alias("other"), F.col("s").alias("o"))
    own = lambda s: {"gates": F.col(f"{s}.gates"), "path": F.col(f"{s}.path"), "qubits": F.col(f"{s}.qubits"), "count": F.col(f"{s}.count"), "code": F.col(f"{s}.said"), "query": F.col(f"{s}.said")}
    return side.join(other, F.col("other") == (p * 7 + 3) % 154).groupBy(W.retrieval_failure(own("s"), own("o")).alias("failure")).agg(F.count("*").alias("n"))
