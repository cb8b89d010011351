"""Cascades that name what went wrong with a record, and the readiness of a record: column expressions in order of priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import tokens

#: Words that name an algorithm.
ALGORITHMS = ("adder", "bell", "deutsch", "des", "e91", "grover", "iris", "permutation", "qft", "qkd", "siamese", "teleportation", "vqc")
#: Phrases that stand for one of these words.
PHRASES = (("teleport", "teleportation"), ("quantum key distribution", "qkd"), ("half-adder", "adder"), ("half adder", "adder"))
#: Labels whose records a repository-wide clearance makes public.
CLEARED = ("strict_n8", "extended_n8")


def yes(c: Column) -> Column:
    """A flag where absent counts as false."""
    return F.coalesce(c, F.lit(False))


def primary_failure(empty: Column, executed: Column, error: Column, circuit: Column, types: Column, clbits: Column, qubits: Column, count: Column, whole: Column, exported: Column) -> Column:
    """Of an evaluated generation; whole says that all structural checks pass."""
    return (
        F.when(yes(empty), "empty_generation")
        .when(~yes(executed), F.concat(F.lit("execution_failure:"), F.coalesce(F.nullif(error, F.lit("")), F.lit("unknown"))))
        .when(~yes(circuit), "no_circuit_found")
        .when(yes(whole), "structural_match")
        .when(~yes(types), "gate_types_mismatch")
        .when(~yes(clbits), "num_clbits_mismatch")
        .when(~yes(qubits), "num_qubits_mismatch")
        .when(~yes(count), "gate_count_mismatch")
        .when(~yes(exported), "qasm3_export_failure")
        .otherwise("structural_other")
    )


def generation_failure(executed: Column, circuit: Column, qubits: Column, types: Column, count: Column, clbits: Column, whole: Column) -> Column:
    """Of a copied generation: width goes before types, classical width last."""
    return (
        F.when(~yes(executed), "execution_failed")
        .when(~yes(circuit), "no_circuit_found")
        .when(yes(whole), "structural_match")
        .when(~yes(qubits), "width_mismatch")
        .when(~yes(types), "gate_type_mismatch")
        .when(~yes(count), "gate_count_mismatch")
        .when(~yes(clbits), "classical_width_mismatch")
        .otherwise("other_structural_mismatch")
    )


# ------------------------------------------------------------------------------------------------------------- retrieval


def apart(a: Column, b: Column, times: float) -> Column:
    """Whether sizes differ by a factor; below one they count as one, and unknown ones don't differ."""
    ratio = F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) / F.greatest(F.least(F.abs(a), F.abs(b)), F.lit(1.0))
    return yes(F.when(a.isNotNull() & b.isNotNull(), ratio >= times))


def lowered(gates: Column) -> Column:
    """Gate counts with names in lower case, those of equal names being one with the last one's count, absent counts zero."""
    entries = F.transform(F.map_entries(gates), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.coalesce(e["value"], F.lit(0)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.coalesce(F.array_sort(last), F.array().cast("array<struct<key:string,value:bigint>>"))


def gate_overlap(a: Column, b: Column) -> Column:
    """Shared gate names of all gate names; zero where there are none."""
    names = lambda g: F.transform(g, lambda e: e["key"])
    every = F.size(F.array_union(names(a), names(b)))
    return F.when(every == 0, 0.0).otherwise(F.size(F.array_intersect(names(a), names(b))) / every)


def same_context(a: Column, b: Column) -> Column:
    """Whether paths are of one source: equal, one the end of the other, of one file name, or of mostly the same words."""
    plain = lambda p: F.lower(F.replace(p, F.lit("\\"), F.lit("/")))
    x, y = plain(a), plain(b)
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    words = lambda p: F.array_distinct(tokens(F.replace(p, F.lit("/"), F.lit(" "))))
    u, v = words(x), words(y)
    least = F.least(F.size(u), F.size(v))
    mostly = F.when(least > 0, F.size(F.array_intersect(u, v)) / least >= 0.75)
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return yes(known & ((x == y) | x.endswith(y) | y.endswith(x) | ((name(x) != "") & (name(x) == name(y))) | yes(mostly)))


def algorithms(*texts: Column) -> Column:
    """The algorithms that texts name, in words or in phrases."""
    own = F.concat(*[F.coalesce(tokens(t), F.array().cast("array<string>")) for t in texts])
    named = F.array_intersect(own, F.array(*map(F.lit, ALGORITHMS)))
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    said = F.array_compact(F.array(*[F.when(whole.contains(phrase), F.lit(word)) for phrase, word in PHRASES]))
    return F.array_distinct(F.concat(named, said))


def retrieval_failure(expected: dict[str, Column], got: dict[str, Column]) -> Column:
    """Why something else came first. Both sides have gates, path, qubits, count and code; expected has the query too."""
    a, b = lowered(expected["gates"]), lowered(got["gates"])
    exact = (F.size(a) > 0) & (a == b)
    near = gate_overlap(a, b)
    context = same_context(expected["path"], got["path"])
    off = lambda times: apart(expected["qubits"], got["qubits"], times) | apart(expected["count"], got["count"], times)
    shared = F.arrays_overlap(algorithms(expected["query"], expected["path"], expected["code"]), algorithms(got["path"], got["code"]))
    return (
        F.when(context & exact, "same_source_register_or_subcircuit")
        .when(context, "same_source_lineage_neighbor")
        .when(exact, "exact_gate_signature_ambiguity")
        .when(yes(shared) & (off(1.75) | (near >= 0.55)), "scaled_family_variant")
        .when(yes(shared), "algorithm_family_confusion")
        .when(off(3.0) & (near >= 0.25), "size_or_complexity_distractor")
        .when(near >= 0.40, "gate_vocabulary_distractor")
        .otherwise("lexical_metadata_distractor")
    )


# ------------------------------------------------------------------------------------------------------------- readiness


def readiness(status: Column, confidence: Column, demo: Column, cleanup: Column, lines: Column, gates: Column, strategy: Column, mutation: Column) -> Column:
    """The readiness label of a record; flags and counts that are absent count as false and zero."""
    validated = yes(status == "validated")
    n_gates = F.coalesce(gates, F.lit(0))
    core = validated & yes(confidence == "high") & ~yes(demo) & ~yes(cleanup) & (F.coalesce(lines, F.lit(0)) >= 5) & (n_gates >= 2)
    return (
        F.when(core & yes(mutation), "mutation_stress_n8")
        .when(core & ~strategy.eqNullSafe("empirical_promoted_repo"), "strict_n8")
        .when(core, "extended_n8")
        .when(validated & (n_gates == 0), "validated_master_only")
        .when(validated, "validated_broad_n8")
        .otherwise("tier2_unvalidated")
    )


def release_bucket(label: Column, raw: Column, cleared: bool) -> Column:
    """The bucket a record is released in: a clearance of the repository opens its clean labels."""
    return F.when(label.isin(*CLEARED), "public_open").otherwise(raw) if cleared else raw


def redistributable(bucket: Column, rights: Column) -> Column:
    return yes(bucket == "public_open") & F.coalesce(rights, F.lit("")).startswith("redistributable")


def signature_complete(qubits: Column, clbits: Column, count: Column, gates: Column) -> Column:
    return qubits.isNotNull() & clbits.isNotNull() & count.isNotNull() & gates.isNotNull()


def count_consistent(count: Column, gates: Column) -> Column:
    """Whether gates but barriers add up to the count."""
    kept = F.map_values(F.map_filter(gates, lambda k, _: F.lower(k) != "barrier"))
    return yes(F.aggregate(kept, F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v.cast("long"), F.lit(0))) == count)


def replay_passes(executed: Column, circuit: Column, signature: Column, exported: Column) -> Column:
    return yes(executed) & yes(circuit) & yes(signature) & yes(exported)
