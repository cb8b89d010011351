"""Summaries of a matrix of nested endpoints: counts, gaps, rates, comparisons, failure classes, strata, items, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, ones, rate


def summarize(cells: DataFrame, *keys: str) -> DataFrame:
    """Counts, gaps and rates of all cells or of each key; what a source doesn't offer is NULL, never zero.

    Assembly is available if all rows have it, and partial_assembly() lists sources where only some do; ordered and parameter
    are available if no executable row lacks them and one has them.
    """
    e, a, m = F.col("execution"), F.col("assembly"), F.col("signature")

    def tape(c: str) -> Column:
        lacking = ones(F.coalesce(e, F.lit(False)) & F.col(c).isNull())
        return F.when((lacking == 0) & (F.count(c) > 0), ones(F.col(c)))

    both = F.count("assembly") == F.count("*")
    out = cells.groupBy(*keys).agg(
        F.count("*").alias("cells"),
        F.countDistinct("model").alias("models"),
        F.countDistinct("prompt_id").alias("prompts"),
        ones(e).alias("execution"),
        F.when(both, ones(a)).alias("assembly"),
        ones(m).alias("signature"),
        tape("ordered").alias("ordered"),
        tape("parameter").alias("parameter"),
        F.when(both, ones(a & ~m)).alias("assembly_without_signature"),
        F.when(both, ones(m & ~a)).alias("signature_without_assembly"),
    )
    gap = lambda x, y: F.col(x) - F.col(y)
    return out.withColumns(
        {"es_gap": gap("execution", "signature"), "attrition": gap("execution", "assembly"), "as_gap": gap("assembly", "signature")}
    ).withColumns(
        {f"{c}_rate": rate(F.col(c), F.col("cells")) for c in ("execution", "assembly", "signature", "ordered", "parameter", "es_gap", "as_gap")}
        | {"disagreement_rate": rate(F.col("es_gap"), F.col("execution")), "as_gap_share": rate(F.col("as_gap"), F.col("es_gap"))}
    )


def partial_assembly(cells: DataFrame) -> DataFrame:
    """(cells, with_assembly) if some cells have the assembly endpoint and others don't, which is an error of the source."""
    return cells.agg(F.count("*").alias("cells"), F.count("assembly").alias("with_assembly")).where("with_assembly between 1 and cells - 1")


def tidy(summary: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per metric: section, metric, available, count, denominator, rate. metrics: name -> (section, denominator column)."""
    summary = summary.withColumns({"disagreement": F.col("es_gap"), "as_gap_of_es_gap": F.col("as_gap")})
    rows = [
        F.struct(F.lit(section).alias("section"), F.lit(name).alias("metric"), F.col(name).isNotNull().alias("available"), F.col(name).cast("long").alias("count"), F.col(of).cast("long").alias("denominator"))
        for name, (section, of) in metrics.items()
    ]
    return summary.select(F.inline(F.array(*rows))).withColumn("rate", rate(F.col("count"), F.col("denominator")))


PRIMARY = {
    "cells": ("scope", "cells"), "models": ("scope", "models"), "prompts": ("scope", "prompts"),
    "execution": ("primary", "cells"), "assembly": ("primary", "cells"), "signature": ("primary", "cells"), "ordered": ("primary", "cells"),
    "parameter": ("primary", "cells"), "es_gap": ("diagnostic", "cells"), "attrition": ("diagnostic", "cells"), "as_gap": ("diagnostic", "cells"),
    "assembly_without_signature": ("diagnostic", "assembly"), "signature_without_assembly": ("diagnostic", "signature"),
    "disagreement": ("diagnostic", "execution"), "as_gap_of_es_gap": ("diagnostic", "es_gap"),
}
#: Further rows where the summary is with_identifiable()'s.
IDENTIFIABLE = {
    "identifiable_cells": ("identifiable", "identifiable_cells"), "identifiable_execution": ("identifiable", "identifiable_cells"),
    "identifiable_signature": ("identifiable", "identifiable_cells"), "identifiable_disagreement": ("identifiable", "identifiable_execution"),
}


def compare(candidate: DataFrame, frozen: DataFrame, metrics: tuple[str, ...] = ("execution_rate", "assembly_rate", "signature_rate", "ordered_rate", "parameter_rate")) -> DataFrame:
    """Candidate and frozen rates and their difference, on the prompts that the candidate has."""
    own = frozen.join(candidate.select("prompt_id").distinct(), "prompt_id", "left_semi")
    long = lambda df, name: summarize(df).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics])))
    return long(candidate, "candidate").join(long(own, "frozen"), "metric", "full_outer").withColumn("delta", F.col("candidate") - F.col("frozen"))


def transitions(before: DataFrame, after: DataFrame, endpoint: str) -> DataFrame:
    """Cells gained and lost between two policies over the same cells."""
    a, b = before.select("model", "prompt_id", F.col(endpoint).alias("a")), after.select("model", "prompt_id", F.col(endpoint).alias("b"))
    return a.join(b, ["model", "prompt_id"]).agg(
        F.lit(endpoint).alias("endpoint"), F.count("*").alias("cells"), ones(~F.col("a") & F.col("b")).alias("gained"), ones(F.col("a") & ~F.col("b")).alias("lost"),
        ones(F.col("a") != F.col("b")).alias("changed"),
    )


def group_rates(cells: DataFrame, *keys: str) -> DataFrame:
    """Rates, and signature given execution, runnable but wrong, of each group."""
    e, m = F.col("execution"), F.col("signature")
    wrong = ones(e & ~m)
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n"), F.countDistinct("prompt_id").alias("prompts"), F.countDistinct("model").alias("models"),
        rate(ones(e), F.count("*")).alias("execution_rate"), rate(ones(m), F.count("*")).alias("signature_rate"), rate(ones(m & e), ones(e)).alias("signature_given_execution"),
        wrong.alias("runnable_wrong"), rate(wrong, F.count("*")).alias("runnable_wrong_rate"), rate(wrong, ones(e)).alias("runnable_wrong_given_execution"),
    )


def with_share(counts: DataFrame, count: str = "n") -> DataFrame:
    """Adds each row's share of the total of a small table of counts."""
    return counts.withColumn("share", F.col(count) / F.sum(count).over(Window.partitionBy()))


def item_difficulty(cells: DataFrame, endpoint: str = "signature", frontier: Column | None = None) -> DataFrame:
    """Of each prompt: models that solve it, difficulty, and overlapping buckets."""
    f = frontier if frontier is not None else F.lit(False)
    s = F.col(endpoint)
    out = cells.groupBy("prompt_id").agg(
        F.count("*").alias("models"), ones(s).alias("solved"), ones(s & f).alias("frontier_solved"), ones(s & ~f).alias("other_solved")
    )
    none, all_ = F.col("solved") == 0, F.col("solved") == F.col("models")
    return out.withColumn("difficulty", 1 - rate(F.col("solved"), F.col("models"))).withColumns({
        "universal_easy": all_, "universal_hard": none, "frontier_only": (F.col("frontier_solved") > 0) & (F.col("other_solved") == 0),
        "other_only": (F.col("other_solved") > 0) & (F.col("frontier_solved") == 0), "mixed": ~all_ & ~none,
    })


def model_distribution(cells: DataFrame, endpoint: str = "signature") -> DataFrame:
    """Of each model: rate, conditional rate, rank and z-score among models (sample deviation; one without spread gets zero)."""
    own = group_rates(cells, "model").select("model", "n", "execution_rate", F.col("signature_rate").alias("rate"), "signature_given_execution")
    every = Window.partitionBy()
    sd = F.coalesce(F.stddev_samp("rate").over(every), F.lit(0.0))
    return own.withColumns({
        "rank": F.row_number().over(every.orderBy(F.desc("rate"), "model")).cast("long"),
        "z": (F.col("rate") - F.avg("rate").over(every)) / F.when(sd > 0, sd).otherwise(1.0),
        "average_rank": average_rank(F.col("rate"), descending=True),
    })


def spread(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, median, extremes and sample deviation (zero for one row)."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd")
    )


def collapse(cells: DataFrame, signatures: DataFrame, endpoint: str = "signature") -> DataFrame:
    """Mean of each model over signatures of the mean within a signature, beside the plain mean."""
    x = F.col(endpoint).cast("int")
    joined = cells.join(signatures, "prompt_id")
    within = joined.groupBy("model", "sig").agg(F.avg(x).alias("m"))
    return within.groupBy("model").agg(F.count("*").alias("signatures"), F.avg("m").alias("collapsed")).join(cells.groupBy("model").agg(F.avg(x).alias("plain")), "model")


def family_macro(cells: DataFrame, families: DataFrame, rare: int = 3, endpoint: str = "signature") -> DataFrame:
    """Per family of a multi-label membership (prompt_id, family): prompts, rate, and the pool that families of few prompts join."""
    sizes = families.groupBy("family").agg(F.countDistinct("prompt_id").alias("prompts"))
    named = families.join(sizes, "family").withColumn("pool", F.when(F.col("prompts") < rare, "rare").otherwise(F.col("family")))
    return cells.join(named, "prompt_id").groupBy("pool").agg(
        F.countDistinct("prompt_id").alias("prompts"), F.count("*").alias("n"), F.avg(F.col(endpoint).cast("int")).alias("rate")
    )


def macro_rates(cells: DataFrame, families: DataFrame, primary: DataFrame, rare: int = 3, endpoint: str = "signature") -> DataFrame:
    """(form, families, rate): the rate of all cells, and means over families of the family's rate: of every label that a prompt
    has, of its primary family, and of primary families with those of fewer than rare prompts pooled. Families are few."""
    x = F.col(endpoint).cast("int")

    def macro(form: str, of: DataFrame) -> DataFrame:
        each = cells.join(F.broadcast(of), "prompt_id").groupBy("family").agg(F.avg(x).alias("rate"))
        return each.agg(F.lit(form).alias("form"), F.count("*").alias("families"), F.avg("rate").alias("rate"))

    sizes = primary.groupBy("family").agg(F.countDistinct("prompt_id").alias("prompts"))
    pooled = primary.join(sizes, "family").select("prompt_id", F.when(F.col("prompts") < rare, "other_rare_primary_families").otherwise(F.col("family")).alias("family"))
    micro = cells.agg(F.lit("micro").alias("form"), F.lit(1).cast("long").alias("families"), F.avg(x).alias("rate"))
    return micro.unionByName(macro("multi_label", families)).unionByName(macro("primary", primary)).unionByName(macro("rare_pooled", pooled))


def upgrades(rates: DataFrame, pairs: list[tuple[str, str]], metrics: list[str]) -> DataFrame:
    """(before, after, metric, low, high, delta) of named pairs of models; rates(model, metrics): a few rows."""
    listed = rates.sparkSession.createDataFrame(pairs, "before string, after string")
    long = rates.select(F.col("model").cast("string").alias("model"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    a, b = long.select(F.col("model").alias("before"), "metric", F.col("v").alias("low")), long.select(F.col("model").alias("after"), "metric", F.col("v").alias("high"))
    return listed.join(a, "before").join(b, ["after", "metric"]).select("before", "after", "metric", "low", "high", (F.col("high") - F.col("low")).alias("delta"))


def leave_one_out(cells: DataFrame, key: Column, endpoint: str = "signature") -> DataFrame:
    """The rate without each value of a key, and its difference to the rate of all: from sums per value, not by rescanning."""
    each = cells.groupBy(key.alias("omitted")).agg(F.count("*").alias("n"), ones(F.col(endpoint)).alias("s"))
    every = Window.partitionBy()
    rest_n, rest_s = F.sum("n").over(every) - F.col("n"), F.sum("s").over(every) - F.col("s")
    full = rate(F.sum("s").over(every), F.sum("n").over(every))
    return each.select("omitted", rest_n.alias("n"), rate(rest_s, rest_n).alias("rate"), (rate(rest_s, rest_n) - full).alias("delta"))


def unpivot_rates(df: DataFrame, names: list[str], *keys: str, endpoint: str = "signature") -> DataFrame:
    """Rates for each value of each of several flags: feature, value, keys."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("string").alias("value")) for n in names])).alias("f")
    return df.select(*keys, endpoint, "prompt_id", rows).groupBy(F.col("f.feature").alias("feature"), F.col("f.value").alias("value"), *keys).agg(
        F.count("*").alias("n"), F.avg(F.col(endpoint).cast("int")).alias("rate")
    )
