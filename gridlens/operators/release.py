"""Gates between a candidate's results and a frozen release: manifest, denominators, expected counts, sensitive keys."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import settle
from .cells import partial_assembly, summarize
from .validate import require_empty

#: Fields a run's manifest must have, those that must equal the release's, and kinds of run.
REQUIRED = ("package_version", "benchmark_release", "evaluator_version", "predicate_version", "schema_version", "artifact_manifest_version", "run_type")
EQUAL = ("benchmark_release", "evaluator_version", "predicate_version", "schema_version")
RUN_TYPES = ("canonical_reproduction", "archived_replay", "supplied_evaluation", "live_replication")
#: Fixed value: names under which credentials are kept.
SENSITIVE_KEY = r"(?i)(^|[_-])(api[_-]?key|authorization|bearer|password|secret|token)($|[_-])"


def manifest_faults(manifests: DataFrame, release: dict[str, str], raw: str = "manifest") -> DataFrame:
    """Adds faults to rows of a JSON manifest: what is no object, lacks fields, has another kind of run, or another release's values."""
    fields = F.from_json(raw, "map<string,string>")
    get = lambda name: F.nullif(F.try_element_at(F.col("m"), F.lit(name)), F.lit(""))
    missing = F.array_compact(F.array(*[F.when(get(n).isNull(), F.lit(f"missing {n}")) for n in REQUIRED]))
    kind = F.when(~get("run_type").isin(*RUN_TYPES), F.concat(F.lit("run_type "), get("run_type")))
    other = [F.when(~get(n).eqNullSafe(F.lit(release[n])), F.concat(F.lit(f"{n}: expected {release[n]}, observed "), F.coalesce(get(n), F.lit("nothing")))) for n in EQUAL]
    found = F.when(F.col("m").isNull(), F.array(F.lit("not an object"))).when(F.size(missing) > 0, missing).when(kind.isNotNull(), F.array(kind)).otherwise(F.array_compact(F.array(*other)))
    return manifests.withColumn("m", fields).withColumn("faults", found).drop("m")


@dataclass
class Scope:
    """What a comparison covers: the whole frozen set or a named part of it."""

    mode: str
    prompts: int
    ids_sha256: str
    candidate: DataFrame
    frozen: DataFrame


def denominators(candidate: DataFrame, frozen: DataFrame) -> DataFrame:
    """(prompt_id, fault): prompts that not all candidate models have ("not shared"), that the frozen set hasn't ("unknown"), and
    that the candidate hasn't ("missing"). Models and prompts are few; cells are counted for each prompt."""
    models = candidate.select(F.countDistinct("model").alias("models"))
    own = candidate.groupBy("prompt_id").agg(F.countDistinct("model").alias("n"))
    shared = own.crossJoin(F.broadcast(models)).where("n < models").select("prompt_id", F.lit("not shared").alias("fault"))
    known = frozen.select("prompt_id").distinct()
    unknown = own.join(known, "prompt_id", "left_anti").select("prompt_id", F.lit("unknown").alias("fault"))
    missing = known.join(own, "prompt_id", "left_anti").select("prompt_id", F.lit("missing").alias("fault"))
    return shared.unionByName(unknown).unionByName(missing)


def align(candidate: DataFrame, frozen: DataFrame, allow_partial: bool = False) -> Scope:
    """The candidate and the frozen cells on the candidate's prompts; an error unless all models share them, the release knows
    them, and, but for a part that is allowed, none is missing."""
    faults = denominators(candidate, frozen)
    require_empty(faults.where("fault = 'not shared'"), "models do not share one set of prompts")
    require_empty(faults.where("fault = 'unknown'"), "prompts outside the frozen set")
    missing = faults.where("fault = 'missing'")
    if not allow_partial:
        require_empty(missing, "prompts of the frozen set are missing")
    ids = candidate.select(F.col("prompt_id").cast("string").alias("id")).distinct()
    got = ids.agg(F.count("*").alias("n"), F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("id")), "\n"), F.lit("\n")), 256).alias("digest")).first()
    if not got.n:
        raise ValueError("the candidate has no prompts")
    own = frozen.join(candidate.select("prompt_id").distinct(), "prompt_id", "left_semi")
    return Scope("full_test_set" if missing.isEmpty() else "matched_subset", got.n, got.digest, candidate, own)


def with_identifiable(cells: DataFrame, excluded: list, *keys: str) -> DataFrame:
    """summarize(), and of the cells outside the excluded prompts: how many, executed, matched, in disagreement, and of executed
    ones the share that doesn't match."""
    kept = summarize(cells.where(~F.col("prompt_id").isin(*excluded)) if excluded else cells, *keys)
    own = kept.select(*keys, *[F.col(a).alias(f"identifiable_{b}") for a, b in (("cells", "cells"), ("execution", "execution"), ("signature", "signature"), ("es_gap", "disagreement"), ("disagreement_rate", "disagreement_rate"))])
    whole = summarize(cells, *keys)
    return whole.join(own, list(keys), "left") if keys else whole.crossJoin(own)


def model_rows(reports: DataFrame, ordered: DataFrame, repeats: DataFrame, summary: DataFrame) -> DataFrame:
    """Models' reports with their counts of ordered and parameter-aware matches and their repeat rates, best first (place from 1).

    A model that either side lacks is an error, not a gap, and so are reports whose models or whose counts of execution, assembly
    and signature don't add up to the summary's. Tables of models are small.
    """
    rows = reports.join(ordered.withColumn("has_ordered", F.lit(True)), "model", "left").join(repeats.withColumn("has_repeats", F.lit(True)), "model", "left")
    require_empty(rows.where("has_ordered is null or has_repeats is null").select("model"), "inputs of a model are incomplete")
    counts = ("execution", "assembly", "signature")
    own = reports.agg(F.count("*").alias("models"), *[F.sum(c).alias(c) for c in counts]).select(F.struct("*").alias("own"))
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).cast("long").alias("expected"), F.col(f"own.{k}").cast("long").alias("observed")) for k in ("models", *counts)]
    off = summary.select("models", *counts).crossJoin(own).select(F.inline(F.array(*pairs))).where(~F.col("expected").eqNullSafe(F.col("observed")))
    require_empty(off, "models' counts do not add up to the summary's")
    best = Window.orderBy(F.desc("signature_rate"), F.desc("execution_rate"), F.lower(F.col("model").cast("string")))
    return rows.drop("has_ordered", "has_repeats").withColumn("place", F.row_number().over(best))


#: What the release's summary counts, in its own order.
CANONICAL_COUNTS = {
    "cells": 3234, "models": 21, "prompts": 154, "execution": 2950, "assembly": 2944, "signature": 1703, "ordered": 1576, "parameter": 1545, "attrition": 6, "as_gap": 1241,
    "assembly_without_signature": 1241, "signature_without_assembly": 0, "identifiable_cells": 3150, "identifiable_execution": 2890, "identifiable_signature": 1703, "identifiable_disagreement": 1187,
}
CANONICAL_REPEATS = {"cells": 4536, "models": 21, "prompts": 72, "runs": 3}


def canonical_faults(cells: DataFrame, excluded: list) -> DataFrame:
    """(key, expected, observed) where a release's cells don't count what they must. Cells of which only some have the assembly
    endpoint are an error, not a null."""
    require_empty(partial_assembly(cells), "only some cells have the assembly endpoint")
    return count_mismatches(with_identifiable(cells, excluded), CANONICAL_COUNTS)


def repeat_faults(runs: DataFrame) -> DataFrame:
    """The same for the panel of repeated runs(model, prompt_id, run)."""
    counts = runs.agg(F.count("*").alias("cells"), *[F.countDistinct(c).alias(n) for c, n in (("model", "models"), ("prompt_id", "prompts"), ("run", "runs"))])
    return count_mismatches(counts, CANONICAL_REPEATS)


def count_mismatches(summary: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(key, expected, observed) where a summary's count isn't the expected one."""
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("long").alias("expected"), F.col(k).cast("long").alias("observed")) for k, v in expected.items()]))
    return summary.select(rows).where(~F.col("expected").eqNullSafe(F.col("observed")))


def sensitive_keys(rows: DataFrame, key: str, body: Column) -> DataFrame:
    """(key, path) of each name in a JSON body, at any depth, that credentials go by; entries of lists are numbered.

    Bodies are variants, walked a level at a time: objects and lists of a level are taken apart in the task that has them, and what
    holds no more names falls away, so a round reads only what lies deeper; it ends when nothing is left. A string that
    looks like JSON is a string. A null body, and one that isn't JSON, has no names.
    """
    spark, found = rows.sparkSession, None
    here = rows.select(F.col(key).alias("own"), F.lit("").alias("at"), F.try_parse_json(body.cast("string")).alias("whole"))
    while True:
        entries = here.lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        dot = F.when(F.col("at") == "", F.col("key")).otherwise(F.concat("at", F.lit("."), "key"))
        at = F.when(F.col("key").isNull(), F.concat("at", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(dot)
        bad = F.coalesce(F.col("key").rlike(SENSITIVE_KEY), F.lit(False))
        deeper = F.substring(F.schema_of_variant("value"), 1, 5).isin("OBJEC", "ARRAY")
        level = entries.select("own", at.alias("at"), bad.alias("bad"), F.when(deeper, F.col("value")).alias("whole")).where("bad or whole is not null")
        level = settle(level, "level")
        names = level.where("bad").select(F.col("own").alias(key), F.col("at").alias("path"))
        found = names if found is None else found.unionByName(names)
        here = level.where("whole is not null").select("own", "at", "whole")
        if here.isEmpty():
            return found


#: Of a record that comes from elsewhere, the types that its fields must have: Spark's schema as JSON, by name.
SCHEMAS: dict[str, str] = {
    "cells": "model string, prompt_id string, execution boolean, assembly boolean, signature boolean, ordered boolean, parameter boolean",
    "responses": "prompt_id string, row_id string, model string, created_at string, text string, error string, finish_reason string",
    "requests": "prompt_id string, row_id string, model string, prompt_sha256 string, body_sha256 string",
    "attempts": "prompt_id string, created_at timestamp, idx long, is_error boolean",
    "manifest": "path string, bytes long, sha256 string",
}


def schema(name: str) -> dict[str, Any]:
    """A schema by name; an unknown name is an error."""
    from pyspark.sql.types import _parse_datatype_string

    if name not in SCHEMAS:
        raise KeyError(f"no schema {name}; there are {', '.join(sorted(SCHEMAS))}")
    return json.loads(_parse_datatype_string(SCHEMAS[name]).json())
