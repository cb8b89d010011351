"""Feature tokens and texts from a record's metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import code_tokens, normal_value, numeric_bin

#: Fields of metadata that enter a text as they are where they say something, and as name_value where they are there.
PLAIN_FIELDS = ("repo_owner", "repo_name", "file_path", "source", "retrieval_strategy", "benchmark_difficulty", "circuit_expressiveness", "size_class")
NAMED_FIELDS = (
    "num_qubits", "num_clbits", "gate_count", "circuit_depth", "measurement_count",
    "has_measurement", "has_entangling_gates", "has_rotation_gates", "has_clifford_only", "is_parameterized",
)


#: Fields of the feature sets of the readiness baseline.
PRIMITIVE = ("validation_status", "extraction_confidence", "contains_demo_scaffolding", "cleanup_candidate", "retrieval_strategy", "retrieval_mode", "mutation_suite_candidate")
SOURCE_PROXY = ("source", "language", "retrieval_mode", "qiskit_version", "circuit_stats_available", "validation_error_type", "openqasm3_export_successful", "api_deprecated_usage")
BROAD_ADDED = (
    "circuit_stats_available", "context_sufficiency_class", "repairability_band", "domain_slice", "shift_axis", "source", "language",
    "validation_error_type", "openqasm3_export_successful", "api_deprecated_usage",
)
TEXT_SIZES = ("prompt_length_chars", "prompt_word_count", "prompt_token_count_cl100k", "output_token_count_cl100k")
CODE_SIZES = ("code_lines", "gate_count")
#: Fields of the feature sets of the stress baseline.
STRESS_SOURCE = ("source", "retrieval_strategy", "retrieval_mode", "language", "qiskit_version", "source_snapshot_granularity")
STRUCTURE = (
    "validation_status", "extraction_confidence", "materialized_circuit", "openqasm3_export_successful", "api_deprecated_usage", "contains_demo_scaffolding",
    "cleanup_candidate", "circuit_stats_available", "has_measurement", "has_entangling_gates", "has_rotation_gates", "has_clifford_only", "has_barriers",
    "is_parameterized", "size_class", "benchmark_difficulty", "circuit_expressiveness",
)
STRUCTURE_SIZES = (
    "code_lines", "gate_count", "num_qubits", "num_clbits", "circuit_depth", "circuit_width", "num_gate_types", "two_qubit_gate_count", "measurement_count",
    "output_token_count_cl100k",
)


@dataclass(frozen=True)
class FeatureSet:
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    gates: bool = False
    code: bool = False


#: The feature sets by baseline and name.
FEATURE_SETS = {
    "readiness": {
        "source_proxy_metadata": FeatureSet(SOURCE_PROXY, TEXT_SIZES),
        "primitive_metadata": FeatureSet(PRIMITIVE, CODE_SIZES),
        "broad_metadata": FeatureSet(PRIMITIVE + BROAD_ADDED, (*CODE_SIZES, "repairability_score", *TEXT_SIZES)),
    },
    "stress": {
        "source_proxy_metadata": FeatureSet(STRESS_SOURCE),
        "structural_metadata": FeatureSet(STRUCTURE, STRUCTURE_SIZES, gates=True),
        "code_tokens": FeatureSet(code=True),
        "structure_plus_code": FeatureSet(STRUCTURE, STRUCTURE_SIZES, gates=True, code=True),
    },
}


def set_tokens(chosen: FeatureSet, fields: dict[str, Column], gates: Column, code: Column) -> Column:
    """Tokens of a feature set; a field that a source doesn't have counts as missing in every row."""
    own = lambda names: {n: fields.get(n, F.lit(None).cast("string")) for n in names}
    return feature_tokens(own(chosen.categorical), own(chosen.numeric), gates if chosen.gates else None, code if chosen.code else None)


def entries(gates: Column) -> Column:
    return F.array_sort(F.map_entries(F.coalesce(gates, F.create_map().cast("map<string,bigint>"))))


def repeated(gates: Column, most: int, name: Column | None = None) -> Column:
    """Each gate's name, in order, as often as it is counted, at most so often; an absent or zero count is one."""
    times = lambda e: F.least(F.when(F.coalesce(e["value"], F.lit(0)) == 0, 1).otherwise(e["value"]), F.lit(most)).cast("int")
    return F.flatten(F.transform(entries(gates), lambda e: F.array_repeat(e["key"], times(e))))


def metadata_text(fields: dict[str, Column], gates: Column) -> Column:
    """Metadata as a text for retrieval; fields that a source doesn't have are left out."""
    text = lambda v: F.when(v.cast("string") == "true", "True").when(v.cast("string") == "false", "False").otherwise(v.cast("string"))
    plain = [F.nullif(fields[n].cast("string"), F.lit("")) for n in PLAIN_FIELDS if n in fields]
    named = [F.concat(F.lit(f"{n}_"), text(fields[n])) for n in NAMED_FIELDS if n in fields]
    times = lambda e: F.least(F.when(F.coalesce(e["value"], F.lit(0)) == 0, 1).otherwise(e["value"]), F.lit(3)).cast("int")
    each = F.flatten(F.transform(entries(gates), lambda e: F.concat(F.array(F.concat(F.lit("gate_"), e["key"])), F.array_repeat(e["key"], times(e)))))
    return F.array_join(F.concat(F.array_compact(F.array(*plain, *named)), each), " ")


def document_text(mode: str, code: Column, metadata: Column, query: Column) -> Column:
    """What of a record is searched."""
    modes = {"code_only": code, "metadata_only": metadata, "code_plus_metadata": F.concat(code, F.lit("\n"), metadata), "instruction_upper_bound": query}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode}")
    return modes[mode]


def feature_tokens(categorical: dict[str, Column], numeric: dict[str, Column], gates: Column | None = None, code: Column | None = None) -> Column:
    """Tokens of a record for a classifier: field=value, field_bin=bin, gates up to five times each, words of code."""
    own = [F.concat(F.lit(f"{n}="), normal_value(c)) for n, c in categorical.items()] + [F.concat(F.lit(f"{n}_bin="), numeric_bin(c.cast("string"))) for n, c in numeric.items()]
    out = F.array(*own) if own else F.array().cast("array<string>")
    if gates is not None:
        out = F.concat(out, F.transform(repeated(gates, 5), lambda g: F.concat(F.lit("gate="), g)))
    if code is not None:
        out = F.concat(out, F.transform(code_tokens(code), lambda t: F.concat(F.lit("code="), t)))
    return out


def problem_size(qubits: Column, clbits: Column, code: Column, symbol: Column) -> Column:
    """How large the problem is whose size a missing symbol held: from the circuit's width and how code uses the symbol."""
    q, c = F.greatest(F.coalesce(qubits, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(clbits, F.lit(0)), F.lit(0))
    line = F.regexp_replace(code, r"\s+", "")
    has = lambda *parts: F.contains(line, F.concat(*parts))
    twice = has(symbol, F.lit("*2")) | has(F.lit("2*"), symbol)
    more = has(symbol, F.lit("+1")) | has(F.lit("1+"), symbol)
    return F.when(twice, F.greatest(F.floor(q / 2), F.lit(1))).when(more & (c > 0), c).when(more, F.greatest(q - 1, F.lit(1))).when((c > 0) & (c <= q), c).otherwise(q).cast("long")
