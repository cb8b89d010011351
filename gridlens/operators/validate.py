"""Checks as DataFrames of violations; require_empty() turns one into an error with examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endpoint names that sources use, first found wins. Fixed values.
ALIASES = {
    "execution": ("report_executable", "execution", "execution_success"),
    "assembly": ("report_assembly_admissible", "assembly", "assembly_admissible", "qasm3_export_success"),
    "signature": ("report_signature_match", "signature", "signature_match"),
    "ordered": ("ordered_wire_tape_match", "ordered_match"),
    "parameter": ("parameter_aware_tape_match", "parameter_match"),
}
IMPLIES = (("assembly", "execution"), ("signature", "execution"), ("ordered", "signature"), ("parameter", "ordered"))


def require_empty(bad: DataFrame, what: str, examples: int = 10) -> None:
    rows = bad.limit(examples).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def boolean(raw: Column) -> Column:
    """true/false/0/1 as a flag; NULL stays; anything else is NULL here and is listed by conflicts()."""
    text = F.lower(raw.cast("string"))
    return F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False)


def resolve(df: DataFrame, names: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Endpoint columns from their aliases; an endpoint without any alias in df is NULL throughout (unavailable)."""
    found = {k: [a for a in aliases if a in df.columns] for k, aliases in names.items()}
    return df.withColumns({k: F.coalesce(*[boolean(F.col(a)) for a in have]) if have else F.lit(None).cast("boolean") for k, have in found.items()})


def conflicts(df: DataFrame, names: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Rows where present aliases of an endpoint disagree or hold what is no flag, with the endpoint's name."""
    out = []
    for k, aliases in names.items():
        have = [F.col(a) for a in aliases if a in df.columns]
        if have:
            values = F.array_distinct(F.filter(F.array(*map(boolean, have)), lambda x: x.isNotNull()))
            odd = reduce(lambda a, b: a | b, [c.isNotNull() & boolean(c).isNull() for c in have])
            out.append(F.when((F.size(values) > 1) | odd, F.lit(k)))
    return df.withColumn("endpoint", F.explode(F.filter(F.array(*out), lambda x: x.isNotNull()))) if out else df.withColumn("endpoint", F.lit("")).limit(0)


def implication_violations(df: DataFrame, rules: tuple[tuple[str, str], ...] = IMPLIES) -> DataFrame:
    """One row for each record and rule a => b that it breaks."""
    broken = [F.when(F.coalesce(F.col(a), F.lit(False)) & ~F.coalesce(F.col(b), F.lit(False)), F.lit(f"{a} without {b}")) for a, b in rules]
    return df.withColumn("rule", F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def missing_cells(df: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of the expected grid left x right (two small dimension tables) that df lacks; keys are their columns."""
    grid = left.crossJoin(F.broadcast(right))
    return grid.join(df, [*left.columns, *right.columns], "left_anti")


def key_mismatches(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys on one side only, for an exact one-to-one join."""
    both = a.select(*keys, F.lit(True).alias("in_left")).join(b.select(*keys, F.lit(True).alias("in_right")), list(keys), "full_outer")
    return both.where("in_left is null or in_right is null").select(*keys, F.when(F.col("in_left").isNull(), "right").otherwise("left").alias("only"))


def dense(df: DataFrame, models: DataFrame, prompts: DataFrame, endpoint: str) -> DataFrame:
    """(prompt_id, row): of each prompt, an endpoint of every model as 0/1 in the order of models. Raises with ten examples where a
    cell is missing, is there twice or has no value; models(model) and prompts(prompt_id) are what is expected."""
    own = df.join(F.broadcast(models), "model", "left_semi").join(prompts, "prompt_id", "left_semi").select("model", "prompt_id", F.col(endpoint).cast("int").alias("v"))
    require_empty(missing_cells(own.where("v is not null"), prompts, models), f"no {endpoint}")
    require_empty(duplicates(own, "model", "prompt_id"), "cells twice")
    return own.groupBy("prompt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("model", "v"))), lambda x: x["v"]).alias("row"))
