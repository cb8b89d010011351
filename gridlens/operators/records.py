"""Record-level steps: selection, ids, joins with fallbacks and checks, run audits, histograms of what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ones, rate
from .cells import with_share


def clean_rows(rows: DataFrame, role: str, text: str, identity: str, roles: tuple[str, ...]) -> DataFrame:
    """Rows of the given roles with a trimmed text; a missing id becomes clean_<number> in order of the others."""
    kept = rows.where(F.col(role).isin(*roles)).withColumn(text, F.trim(text)).where(F.col(text) != "")
    named = F.coalesce(F.nullif(F.col(identity), F.lit("")).isNotNull(), F.lit(False))
    # only rows without an id, which are few, meet in the numbering
    number = F.row_number().over(Window.partitionBy().orderBy(text))
    return kept.where(named).unionByName(kept.where(~named).withColumn(identity, F.format_string("clean_%04d", number)))


def group_id(owner: Column, repo: Column, path: Column, row: Column) -> Column:
    """owner|repo|path; what is null or empty has a stand-in, the row's own id for the path."""
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    return F.concat_ws("|", filled(owner, F.lit("<owner>")), filled(repo, F.lit("<repo>")), filled(path, row))


def select_prompts(prompts: DataFrame, key: str, order: str, include: list | None = None, exclude: list | None = None, limit: int | None = None) -> DataFrame:
    """Prompts to run, in order: those included, without those excluded, the first `limit`."""
    out = prompts.where(F.col(key).isin(*include)) if include is not None else prompts
    out = out.where(~F.col(key).isin(*exclude)) if exclude else out
    return out.orderBy(order).limit(limit) if limit is not None else out


def join_with_fallback(responses: DataFrame, prompts: DataFrame, key: str, other: str) -> DataFrame:
    """Each prompt with the response under its key, or else under its other id: columns r_* of the response, and by which."""
    cols = [c for c in responses.columns if c != "ref"]
    first = responses.select(F.col("ref").alias("k1"), *[F.col(c).alias(f"a_{c}") for c in cols])
    second = responses.select(F.col("ref").alias("k2"), *[F.col(c).alias(f"b_{c}") for c in cols])
    out = prompts.join(first, F.col(key) == F.col("k1"), "left").join(second, F.col(other) == F.col("k2"), "left")
    by = F.when(F.col("k1").isNotNull(), key).when(F.col("k2").isNotNull(), other)
    return out.select(*prompts.columns, *[F.when(F.col("k1").isNotNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"r_{c}") for c in cols], by.alias("matched_by"))


def hash_mismatches(requests: DataFrame, responses: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """(key, fault): responses without a request, or whose hashes differ from the request's, with the names of those."""
    want = requests.select(key, F.lit(True).alias("known"), *[F.col(h).alias(f"w_{h}") for h in hashes])
    wrong = F.array_join(F.filter(F.array(*[F.when(~F.col(h).eqNullSafe(F.col(f"w_{h}")), F.lit(h)) for h in hashes]), lambda x: x.isNotNull()), ",")
    fault = F.when(F.col("known").isNull(), "unknown").otherwise(F.nullif(wrong, F.lit("")))
    return responses.join(want, key, "left").select(key, fault.alias("fault")).where("fault is not null")


def combinations(rows: DataFrame, checks: list[str]) -> DataFrame:
    """How often each combination of failed checks occurs, named "a + b"."""
    name = F.array_join(F.filter(F.array(*[F.when(~F.col(c), F.lit(c)) for c in checks]), lambda x: x.isNotNull()), " + ")
    return with_share(rows.groupBy(F.coalesce(F.nullif(name, F.lit("")), F.lit("none")).alias("failed")).agg(F.count("*").alias("n")))


def missing_name(message: Column) -> Column:
    """The name that a NameError says isn't defined."""
    return F.nullif(F.regexp_extract(message, "name '([^']+)' is not defined", 1), F.lit(""))


def run_audit(prompts: DataFrame, log: DataFrame, key: str, error: str) -> DataFrame:
    """Of each model: prompts answered, missing, answered more than once, with errors only, and whether the run is complete."""
    total = prompts.select(F.countDistinct(key).alias("total"))
    each = log.groupBy("model", key).agg(F.count("*").alias("rows"), F.min(F.col(error).cast("int")).alias("failed"))
    known = each.join(prompts.select(key).distinct(), key, "left_semi")
    out = known.groupBy("model").agg(F.count("*").alias("answered"), ones(F.col("rows") > 1).alias("repeated"), ones(F.col("failed") == 1).alias("errors_only"))
    out = out.crossJoin(F.broadcast(total)).withColumn("missing", F.col("total") - F.col("answered"))
    return out.withColumn("status", F.when((F.col("missing") == 0) & (F.col("errors_only") == 0), "complete").when(F.col("missing") == 0, "complete_with_errors").otherwise("incomplete"))


def choose(candidates: DataFrame, key: str, name: str, weights: dict[str, float]) -> DataFrame:
    """Of each key's candidates, the one of least weighted absolute differences, then of least name."""
    score = sum((F.lit(w) * F.abs(F.col(c)) for c, w in weights.items()), F.lit(0.0))
    return candidates.groupBy(key).agg(F.min(F.struct(score.alias("score"), F.col(name).alias("name"))).alias("m")).select(key, "m.name", "m.score")


def templates(cases: DataFrame, template: Column, label: Column, value: Column) -> DataFrame:
    """Cases rolled up to templates: cases, sum of a value, and the distinct labels in order."""
    return cases.groupBy(template.alias("template")).agg(F.count("*").alias("cases"), F.sum(value).alias("total"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))


def harness_summary(cells: DataFrame, error: Column, *keys: str) -> DataFrame:
    """Counts and rates of a harness run with the most frequent error."""
    e, m = F.col("execution"), F.col("signature")
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n"), ones(e).alias("executed"), ones(m).alias("matched"), rate(ones(m), F.count("*")).alias("match_rate"), rate(ones(m), ones(e)).alias("match_given_execution"), ones(error.isNotNull()).alias("with_error"), F.countDistinct(error).alias("kinds_of_error"),
    )


def recovery_summary(rows: DataFrame, before: Column, after: Column, symbol: Column) -> DataFrame:
    """Of each missing symbol: records, how many worked before and after their context was given back, and what share was recovered."""
    gained = ones(~before & after)
    return rows.groupBy(symbol.alias("symbol")).agg(F.count("*").alias("n"), ones(before).alias("before"), ones(after).alias("after"), gained.alias("recovered"), rate(gained, ones(~before)).alias("recovery_rate"))


def interrupted(log: DataFrame, key: str, order: list[Column], started: Column, acknowledged: Column) -> DataFrame:
    """(key, status) of keys whose last record is a start without an end: uncertain, unless someone has acknowledged it."""
    at = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    last = log.groupBy(key).agg(F.max_by(started, at).alias("open"), F.bool_or(acknowledged).alias("seen"))
    return last.where("open").select(key, F.when(F.col("seen"), "acknowledged").otherwise("uncertain_interrupted").alias("status"))
