"""Panels of runs: requests for them, filters, summaries of what came back, layers of a sequential replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ones, rate


def filter_requests(requests: DataFrame, ids: list, key: str, run: int) -> DataFrame:
    """Requests of the listed prompts with the run's number; pos is their place in the list, which is their order."""
    listed = requests.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{key} {requests.schema[key].dataType.simpleString()}, pos int")
    return requests.join(F.broadcast(listed), key).withColumn("run", F.lit(run))


def request_rows(prompts: DataFrame, key: str, text: str, models: DataFrame) -> DataFrame:
    """A request for each prompt and model (model, family, max_tokens): its body by family, keys in order, and digests of the
    prompt, the body and both. Models are a few rows."""
    both = prompts.crossJoin(F.broadcast(models))
    said = F.array(F.struct(F.col(text).alias("content"), F.lit("user").alias("role")))
    chat = F.to_json(F.struct(F.col("max_tokens").alias("max_tokens"), said.alias("messages"), F.col("model").alias("model")))
    plain = F.to_json(F.struct(F.col(text).alias("input"), F.col("max_tokens").alias("max_output_tokens"), F.col("model").alias("model")))
    body = F.when(F.col("family") == "chat", chat).otherwise(plain)
    out = both.select(F.concat_ws("::", "model", key).alias("custom_id"), key, "model", body.alias("body"), F.sha2(text, 256).alias("prompt_sha256"))
    return out.withColumn("body_sha256", F.sha2("body", 256)).withColumn("request_sha256", F.sha2(F.concat_ws("\n", "custom_id", "prompt_sha256", "body_sha256"), 256))


def results_summary(log: DataFrame, model: str, key: str, order: list[Column], finish: str, resolved: str, error: Column) -> DataFrame:
    """Of each model, the last row of each prompt counting: prompts, errors, finishes as "name:count", and the resolved models."""
    last = log.groupBy(model, key).agg(F.max_by(F.struct(F.col(finish).alias("f"), F.col(resolved).alias("r"), error.alias("e")), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])).alias("x"))
    finishes = last.groupBy(model, F.coalesce("x.f", F.lit("unknown")).alias("f")).agg(F.count("*").alias("n"))
    listed = finishes.groupBy(model).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "n"))), lambda s: F.concat_ws(":", s["f"], s["n"])), ",").alias("finishes"))
    sums = last.groupBy(model).agg(F.count("*").alias("prompts"), ones(F.col("x.e")).alias("errors"), F.array_join(F.array_sort(F.collect_set("x.r")), ",").alias("resolved"))
    return sums.join(listed, model)


def harness_counts(records: DataFrame, flags: dict[str, Column], *keys: str) -> DataFrame:
    """Rows, how many have each flag, and the rates; absent flags count as false."""
    out = records.groupBy(*keys).agg(F.count("*").alias("rows"), *[ones(c).alias(n) for n, c in flags.items()])
    return out.withColumns({f"{n}_rate": rate(F.col(n), F.col("rows")) for n in flags})


def error_histogram(records: DataFrame, executed: Column, circuit: Column, error: Column) -> DataFrame:
    """(error, n) of records that didn't execute or gave no circuit."""
    ran, found = F.coalesce(executed, F.lit(False)), F.coalesce(circuit, F.lit(False))
    kind = F.when(~ran, F.coalesce(F.nullif(error, F.lit("")), F.lit("ExecutionFailure"))).otherwise("NoCircuitReturned")
    return records.where(~(ran & found)).groupBy(kind.alias("error")).agg(F.count("*").alias("n"))


def mismatch_histogram(records: DataFrame, circuit: Column, whole: Column, checks: dict[str, Column]) -> DataFrame:
    """(check, n) of checks that fail where there is a circuit whose structure isn't all right."""
    bad = records.where(F.coalesce(circuit, F.lit(False)) & ~F.coalesce(whole, F.lit(False)))
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return bad.select(F.explode(failed).alias("check")).groupBy("check").agg(F.count("*").alias("n"))


def layers(runs: DataFrame, dimension: DataFrame, affected: Column) -> DataFrame:
    """Of each layer of a sequential replication, dimension(layer, prompt_id), and of all pooled: prompts, cells a run, rates of
    each run, and on items that no transport fault affected in any run the ranges of rates and the mean pairwise agreement."""
    pooled = dimension.unionByName(dimension.select(F.lit("pooled").alias("layer"), "prompt_id").distinct())
    items = runs.withColumn("hit", F.coalesce(affected, F.lit(False))).groupBy("model", "prompt_id").agg(
        F.bool_or("hit").alias("hit"), *[F.max(F.when(F.col("run") == r, F.col(e).cast("int"))).alias(f"{e}{r}") for e in ("execution", "signature") for r in (1, 2, 3)]
    )
    own = items.join(F.broadcast(pooled), "prompt_id")
    fine = ~F.col("hit")
    mean = lambda c, where=F.lit(True): F.avg(F.when(where, c))
    out = {"prompts": F.countDistinct("prompt_id"), "cells": F.count("*"), "common_cells": F.count_if(fine)}
    for e in ("execution", "signature"):
        a, b, c = (F.col(f"{e}{r}") for r in (1, 2, 3))
        out |= {f"{e}_run{r}": mean(F.col(f"{e}{r}")) for r in (1, 2, 3)}
        common = [mean(x, fine) for x in (a, b, c)]
        out |= {f"common_{e}_low": F.least(*common), f"common_{e}_high": F.greatest(*common)}
        out[f"common_{e}_agreement"] = mean(((a == b).cast("int") + (a == c).cast("int") + (b == c).cast("int")) / 3, fine)
    return own.groupBy("layer").agg(*[v.alias(k) for k, v in out.items()])


AGREEMENTS = {
    "gate_order": "gate_order_match", "quantum_operands": "quantum_operand_sequence_match", "classical_operands": "classical_operand_sequence_match", "ordered_wire_tape": "ordered_wire_tape_match",
    "parameter_tokens": "parameter_token_sequence_match", "parameter_aware_tape": "parameter_aware_tape_match", "global_phase": "global_phase_match", "full_literal": "full_literal_circuit_match",
}


def tape_summary(cells: DataFrame, *keys: str) -> DataFrame:
    """Of replayed tapes (columns of compare_tapes, executable, replayed, signature, measured, consistent): counts, and of each
    agreement how many of those with a signature have it; of the measurement map, of those that measure too."""
    played = F.coalesce("replayed", F.lit(False))
    passed = played & F.col("signature")
    measured = passed & F.col("measured")
    out = [
        F.count("*").alias("cells"), ones(F.col("executable")).alias("executable"), ones(played).alias("replayed"), (ones(F.col("executable")) - ones(played)).alias("replay_failures"), ones(F.col("signature")).alias("signatures"),
        ones(passed).alias("denominator"), ones(played & ~F.coalesce("consistent", F.lit(False))).alias("disagreements"), ones(measured).alias("measured"), ones(measured & F.col("measurement_map_match")).alias("measurement_map"),
        *[ones(passed & F.col(c)).alias(n) for n, c in AGREEMENTS.items()], ones(played & F.col("ordered_wire_tape_match") & ~F.col("signature")).alias("wire_outside_signature"),
    ]
    sums = cells.groupBy(*keys).agg(*out)
    return sums.withColumns({f"{n}_rate": rate(F.col(n), F.col("denominator")) for n in AGREEMENTS} | {"measurement_map_rate": rate(F.col("measurement_map"), F.col("measured"))})
