"""Every branch of the cascades on records made by hand, the gates of a comparison, and the writers."""

import json

import pytest
from pyspark.sql import functions as F

from gridlens.operators import cells as C
from gridlens.operators import failures as W
from gridlens.operators import features as T
from gridlens.operators import release as G
from gridlens.sources import sinks as K


def one(spark, expression, schema, *rows):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema).orderBy("k").select(expression).collect()]


def test_primary_failure(spark):
    names = ("empty", "executed", "error", "circuit", "types", "clbits", "qubits", "count", "whole", "exported")
    schema = ", ".join(f"{n} {'string' if n == 'error' else 'boolean'}" for n in names)
    t, f, _ = True, False, None
    rows = [
        (t, t, _, t, t, t, t, t, t, t), (f, f, "KeyError", t, t, t, t, t, t, t), (_, _, "", t, t, t, t, t, t, t), (f, t, _, _, t, t, t, t, t, t), (f, t, _, t, f, f, f, f, t, f),
        (f, t, _, t, _, f, f, f, f, f), (f, t, _, t, t, f, f, f, f, f), (f, t, _, t, t, t, _, f, f, f), (f, t, _, t, t, t, t, f, f, f), (f, t, _, t, t, t, t, t, _, f), (f, t, _, t, t, t, t, t, f, t),
    ]
    assert one(spark, W.primary_failure(*map(F.col, names)), schema, *rows) == [
        "empty_generation", "execution_failure:KeyError", "execution_failure:unknown", "no_circuit_found", "structural_match",
        "gate_types_mismatch", "num_clbits_mismatch", "num_qubits_mismatch", "gate_count_mismatch", "qasm3_export_failure", "structural_other",
    ]


def test_generation_failure(spark):
    names = ("executed", "circuit", "qubits", "types", "count", "clbits", "whole")
    t, f, _ = True, False, None
    rows = [(_, t, t, t, t, t, t), (t, f, t, t, t, t, t), (t, t, f, f, f, f, t), (t, t, f, f, f, f, f), (t, t, t, f, f, f, f), (t, t, t, t, _, f, f), (t, t, t, t, t, f, _), (t, t, t, t, t, t, f)]
    assert one(spark, W.generation_failure(*map(F.col, names)), ", ".join(f"{n} boolean" for n in names), *rows) == [
        "execution_failed", "no_circuit_found", "structural_match", "width_mismatch", "gate_type_mismatch", "gate_count_mismatch", "classical_width_mismatch", "other_structural_mismatch",
    ]


def test_readiness_and_buckets(spark):
    names = ("status", "confidence", "demo", "cleanup", "lines", "gates", "strategy", "mutation")
    schema = "status string, confidence string, demo boolean, cleanup boolean, lines int, gates int, strategy string, mutation boolean"
    core = ("validated", "high", None, False, 5, 2)
    rows = [(*core, None, None), (*core, "empirical_promoted_repo", False), (*core, "empirical_promoted_repo", True), ("validated", "low", None, None, 9, None, None, None), ("validated", "high", True, False, 9, 3, None, None), ("validated", "high", None, None, 4, 3, None, None), (None, "high", None, None, 9, 9, None, True)]
    labels = one(spark, W.readiness(*map(F.col, names)), schema, *rows)
    assert labels == ["strict_n8", "extended_n8", "mutation_stress_n8", "validated_master_only", "validated_broad_n8", "validated_broad_n8", "tier2_unvalidated"]
    bucket = lambda cleared: one(spark, W.release_bucket(F.col("label"), F.col("raw"), cleared), "label string, raw string", *[(x, "closed") for x in labels[:3]])
    assert bucket(True) == ["public_open", "public_open", "closed"] and bucket(False) == ["closed"] * 3


def test_record_predicates(spark):
    assert one(spark, W.redistributable(F.col("b"), F.col("r")), "b string, r string", ("public_open", "redistributable_mit"), ("public_open", None), ("closed", "redistributable"), (None, "redistributable")) == [True, False, False, False]
    gates = "c int, g map<string,int>"
    assert one(spark, W.count_consistent(F.col("c"), F.col("g")), gates, (3, {"h": 2, "cx": 1, "BARRIER": 9}), (3, {"h": None, "cx": 3}), (2, {"h": 3}), (None, {"h": 1}), (1, None)) == [True, True, False, False, False]


def test_retrieval_failure(spark):
    side = "struct<gates map<string,int>, path string, qubits int, count int, code string>"
    e = ({"h": 1, "cx": 2}, "a/b/grover.py", 2, 3, "")
    cases = [
        (e, "x", ({"H": 1, "cx": 2}, "z/grover.py", 2, 3, "")), (e, "x", ({"h": 9}, "c/a/b/grover.py", 2, 3, "")), (e, "x", ({"cx": 2, "h": 1}, "other.py", 2, 3, "")),
        (e, "bell pair", ({"h": 1, "cx": 9}, "other_thing.py", 2, 11, "bell state")), (e, "bell pair", ({"t": 1}, "other_thing.py", 2, 3, "a bell")), (e, "teleport it", ({"t": 1}, "other_thing.py", 2, 3, "teleportation")),
        (e, "x", ({"h": 1, "z": 1, "y": 1}, "other_thing.py", 9, 3, "")), (e, "x", ({"h": 1, "cx": 3, "z": 1}, "other_thing.py", 2, 4, "")), (e, "x", ({"z": 1}, None, None, None, None)), (({}, None, None, None, None), None, ({}, None, None, None, None)),
    ]
    parts = lambda s: {n: F.col(f"{s}.{n}") for n in ("gates", "path", "qubits", "count", "code")}
    got = one(spark, W.retrieval_failure(parts("e") | {"query": F.col("q")}, parts("g")), f"e {side}, q string, g {side}", *cases)
    assert got == [
        "same_source_register_or_subcircuit", "same_source_lineage_neighbor", "exact_gate_signature_ambiguity", "scaled_family_variant", "algorithm_family_confusion", "algorithm_family_confusion",
        "size_or_complexity_distractor", "gate_vocabulary_distractor", "lexical_metadata_distractor", "lexical_metadata_distractor",
    ]


def test_problem_size(spark):
    schema = "q int, c int, code string"
    rows = [(4, 0, "range( n * 2 )"), (4, 3, "n+1"), (4, 0, "1 + n"), (4, 3, "n"), (4, 9, "n"), (None, None, "2*n")]
    assert one(spark, T.problem_size(F.col("q"), F.col("c"), F.col("code"), F.lit("n")), schema, *rows) == [2, 3, 3, 3, 4, 1]


CELLS = "model string, prompt_id string, execution boolean, assembly boolean, signature boolean, ordered boolean, parameter boolean"


def panel(spark, model, n, start=0):
    return spark.createDataFrame([(model, f"p{k}", True, True, k % 2 == 0, None, None) for k in range(start, start + n)], CELLS)


def test_comparison_needs_aligned_denominators(spark):
    frozen = panel(spark, "a", 10).unionByName(panel(spark, "b", 10))
    whole = G.align(panel(spark, "new", 10), frozen)
    assert (whole.mode, whole.prompts, whole.frozen.count()) == ("full_test_set", 10, 20)
    with pytest.raises(ValueError, match="missing"):
        G.align(panel(spark, "new", 9), frozen)
    part = G.align(panel(spark, "new", 9), frozen, allow_partial=True)
    assert (part.mode, part.prompts, part.frozen.count()) == ("matched_subset", 9, 18)
    with pytest.raises(ValueError, match="outside"):
        G.align(panel(spark, "new", 11), frozen, allow_partial=True)
    with pytest.raises(ValueError, match="share"):
        G.align(panel(spark, "new", 10).unionByName(panel(spark, "newer", 9)), frozen, allow_partial=True)
    with pytest.raises(ValueError, match="no prompts"):
        G.align(panel(spark, "new", 10).limit(0), frozen, allow_partial=True)


def test_partial_assembly_is_listed(spark):
    some = panel(spark, "a", 3).withColumn("assembly", F.when(F.col("prompt_id") != "p1", F.col("assembly")))
    assert C.partial_assembly(some).count() == 1 and C.partial_assembly(panel(spark, "a", 3)).count() == 0
    assert C.partial_assembly(some.withColumn("assembly", F.lit(None).cast("boolean"))).count() == 0


def test_identifiable_and_parity(spark):
    out = G.with_identifiable(panel(spark, "a", 4), ["p0", "p1"]).first()
    assert (out.cells, out.identifiable_cells, out.identifiable_signature, out.identifiable_disagreement) == (4, 2, 1, 1)
    assert [tuple(r) for r in G.count_mismatches(C.summarize(panel(spark, "a", 4)), {"cells": 4, "signature": 3}).collect()] == [("signature", 3, 2)]


def test_manifests(spark):
    fine = {"package_version": "1", "benchmark_release": "r", "evaluator_version": "e", "predicate_version": "p", "schema_version": "s", "artifact_manifest_version": "1", "run_type": "live_replication"}
    release = {k: fine[k] for k in G.EQUAL}
    rows = [fine, fine | {"run_type": ""}, fine | {"run_type": "x"}, fine | {"schema_version": "t"}]
    frame = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("[]",), ("no",)], "manifest string")
    assert [r.faults for r in G.manifest_faults(frame, release).collect()] == [[], ["missing run_type"], ["run_type x"], ["schema_version: expected s, observed t"], ["not an object"], ["not an object"]]
    assert G.schema("cells")["type"] == "struct"
    with pytest.raises(KeyError):
        G.schema("nothing")


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, b string, a string")
    K.write_canonical_json(rows, str(tmp_path / "j"))
    lines = sorted(line for f in (tmp_path / "j").glob("part*") for line in f.read_text().splitlines())
    assert lines == ['{"a":"x","b":"b","k":2}', '{"a":null,"b":"a","k":1}'] or sorted(map(json.loads, lines), key=lambda r: r["k"]) == [{"a": None, "b": "a", "k": 1}, {"a": "x", "b": "b", "k": 2}]
    assert all(list(json.loads(x)) == ["a", "b", "k"] for x in lines)
    K.write_delimited(rows.orderBy("k"), str(tmp_path / "t"), ["b", "k"], sep="\t", files=1)
    assert next((tmp_path / "t").glob("part*")).read_text() == "b\tk\na\t1\nb\t2\n"
    split = spark.createDataFrame([(1, "train"), (2, "test")], "k int, split string")
    K.write_splits(rows, split, "k", str(tmp_path / "s"))
    assert K.splits_differ(spark, rows, split, "k", str(tmp_path / "s")).count() == 0
    other = split.withColumn("split", F.lit("train"))
    assert {(r.k, r.side) for r in K.splits_differ(spark, rows, other, "k", str(tmp_path / "s")).collect()} == {(2, "missing"), (2, "extra")}
