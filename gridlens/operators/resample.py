"""Bootstraps and permutation tests as replicate grids: draws come from a hash, weights meet sums that are already aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, draw


def replicates(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select((F.col("id") + 1).alias("rep"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds pos from 0 in order: for tables of units (clusters, models), which are small."""
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy().orderBy(*order)) - 1).cast("long"))


def weights(reps: DataFrame, size: int, salt: str = "") -> DataFrame:
    """(rep, pos, w): how often each of size units is drawn in each replicate of as many draws."""
    key = F.concat(F.lit(salt), F.col("rep").cast("string"))
    drawn = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")).select("rep", draw(key, F.col("i"), size).alias("pos"))
    return drawn.groupBy("rep", "pos").agg(F.count("*").alias("w"))


def cluster_bootstrap(sums: DataFrame, reps: int, salt: str = "") -> DataFrame:
    """(rep, estimate): sums(cluster, x, n) holds each cluster's total and size; an estimate is sum(w x) / sum(w n)."""
    units = numbered(sums, "cluster")
    size = units.count()
    w = weights(replicates(sums.sparkSession, reps), size, salt)
    return w.join(F.broadcast(units), "pos").groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("x")).cast("double"), F.sum(F.col("w") * F.col("n")).cast("double")).alias("estimate"))


def crossed_bootstrap(sums: DataFrame, reps: int) -> DataFrame:
    """(rep, estimate): both sides of sums(left, right, x, n) are drawn independently; weights multiply."""
    spark = sums.sparkSession
    left, right = numbered(sums.select("left").distinct(), "left"), numbered(sums.select("right").distinct(), "right")
    wl = weights(replicates(spark, reps), left.count(), "l").join(F.broadcast(left), "pos").select("rep", "left", F.col("w").alias("wl"))
    wr = weights(replicates(spark, reps), right.count(), "r").join(F.broadcast(right), "pos").select("rep", "right", F.col("w").alias("wr"))
    both = wl.join(sums, "left").join(wr, ["rep", "right"])
    w = F.col("wl") * F.col("wr")
    return both.groupBy("rep").agg(F.try_divide(F.sum(w * F.col("x")).cast("double"), F.sum(w * F.col("n")).cast("double")).alias("estimate"))


def interval(estimates: DataFrame, *keys: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of the finite estimates."""
    e = F.when(~F.isnan("estimate"), F.col("estimate"))
    tail = (1 - level) / 2
    return estimates.groupBy(*keys).agg(F.count(e).alias("reps"), F.avg(e).alias("mean"), F.percentile(e, F.lit(tail)).alias("low"), F.percentile(e, F.lit(1 - tail)).alias("high"))


def sign_flip(diffs: DataFrame, reps: int) -> DataFrame:
    """p of the summed differences of clusters (cluster, d) under random signs, (hits + 1) / (reps + 1), ties counted as hits."""
    units = numbered(diffs, "cluster")
    sign = F.when(draw(F.col("rep").cast("string"), F.col("pos"), 2) == 0, 1).otherwise(-1)
    flips = replicates(diffs.sparkSession, reps).crossJoin(F.broadcast(units)).groupBy("rep").agg(F.abs(F.sum(sign * F.col("d"))).alias("s"))
    seen = units.agg(F.abs(F.sum("d")).alias("observed"))
    hits = F.sum((F.col("s") >= F.col("observed") - 1e-12).cast("long"))
    return flips.crossJoin(F.broadcast(seen)).agg(F.max("observed").alias("observed"), ((hits + 1) / F.lit(reps + 1.0)).alias("p"))


def permutation_correlation(df: DataFrame, key: str, x: str, y: str, reps: int) -> DataFrame:
    """p of the rank correlation of x and y (ranks already): y is dealt anew in each replicate in the order of a hash."""
    units = numbered(df.select(key, x, y), key)
    grid = replicates(df.sparkSession, reps).crossJoin(F.broadcast(units))
    order = F.sha2(F.concat_ws(":", "rep", "pos"), 256)
    dealt = grid.withColumn("to", (F.row_number().over(Window.partitionBy("rep").orderBy(order)) - 1).cast("long"))
    other = units.select(F.col("pos").alias("to"), F.col(y).alias("y2"))
    r = dealt.join(F.broadcast(other), "to").groupBy("rep").agg(F.round(F.abs(F.corr(x, "y2")), 9).alias("r"))
    seen = units.agg(F.round(F.abs(F.corr(x, y)), 9).alias("observed"))
    return r.crossJoin(F.broadcast(seen)).agg(F.max("observed").alias("observed"), ((F.sum((F.col("r") >= F.col("observed")).cast("long")) + 1) / F.lit(reps + 1.0)).alias("p"))


def bootstrap_ranks(rates: DataFrame, key: str, estimate: str, tops: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Of each unit over replicates (rep, key, estimate): median rank, its interval, and how often it is among the first few."""
    r = F.rank().over(Window.partitionBy("rep").orderBy(F.desc(estimate)))
    ranked = rates.withColumn("r", r.cast("double"))
    return ranked.groupBy(key).agg(
        F.percentile("r", F.lit(0.5)).alias("median_rank"), F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"), *[F.avg((F.col("r") <= t).cast("int")).alias(f"in_top{t}") for t in tops]
    )


def bootstrap_scores(rates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Of each unit of seen(key, score), over replicates (rep, key, estimate): the score with its interval, its rank (ties share the
    mean of their ranks) with median, interval and how often it is among the first three and five."""
    ranked = rates.withColumn("r", average_rank(F.col("estimate"), "rep", descending=True).cast("double"))
    q = lambda c, at: F.percentile(c, F.lit(at))
    out = ranked.groupBy(key).agg(
        q("estimate", 0.025).alias("score_low"), q("estimate", 0.975).alias("score_high"), q("r", 0.5).alias("rank_median"), q("r", 0.025).alias("rank_low"), q("r", 0.975).alias("rank_high"), *[F.avg((F.col("r") <= t).cast("int")).alias(f"top{t}") for t in (3, 5)]
    )
    return seen.select(key, "score", average_rank(F.col("score"), descending=True).cast("double").alias("rank")).join(out, key)


def rank_correlations(rates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(rep, estimate): correlation of each replicate's ranks with those of seen(key, score); null where either has no variation."""
    own = seen.select(key, average_rank(F.col("score")).alias("x"))
    both = rates.withColumn("y", average_rank(F.col("estimate"), "rep")).join(F.broadcast(own), key)
    return both.groupBy("rep").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("estimate"))


def poststratified(cells: DataFrame, bins: DataFrame, endpoint: Column, shares: dict[str, float], *keys: str) -> DataFrame:
    """Rates of bins put together by fixed shares; bins without cells fall away and the shares of others are scaled up."""
    w = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    each = cells.join(F.broadcast(bins), "prompt_id").groupBy(*keys, "bin").agg(F.avg(endpoint.cast("int")).alias("rate"))
    return each.withColumn("share", F.coalesce(w[F.col("bin")], F.lit(0.0))).groupBy(*keys).agg(F.try_divide(F.sum(F.col("rate") * F.col("share")), F.sum("share")).alias("rate"))


def poststratified_bootstrap(cells: DataFrame, bins: DataFrame, endpoint: Column, shares: dict[str, float], reps: int, *keys: str) -> DataFrame:
    """(rep, keys, estimate): models are drawn with replacement, and prompts within each bin; rates of bins are put together by
    their shares. A bin that has no cells is an error: a rate without it would be of another population."""
    spark = cells.sparkSession
    sums = cells.join(F.broadcast(bins), "prompt_id").groupBy("model", "prompt_id", "bin", *keys).agg(F.sum(endpoint.cast("double")).alias("x"), F.count("*").alias("n"))
    sizes = {r["bin"]: r["n"] for r in sums.select("bin", "prompt_id").distinct().groupBy("bin").agg(F.count("*").alias("n")).collect()}  # bins are few
    if lacking := sorted(set(shares) - set(sizes)):
        raise ValueError(f"no cells in bins {lacking}")
    models = numbered(sums.select("model").distinct(), "model")
    wm = weights(replicates(spark, reps), models.count(), "m").join(F.broadcast(models), "pos").select("rep", "model", F.col("w").alias("wm"))
    wp = None
    for name in sorted(shares):
        prompts = numbered(sums.where(F.col("bin") == name).select("prompt_id").distinct(), "prompt_id")
        own = weights(replicates(spark, reps), sizes[name], name).join(F.broadcast(prompts), "pos").select("rep", "prompt_id", F.col("w").alias("wp"))
        wp = own if wp is None else wp.unionByName(own)
    w, total = F.col("wm") * F.col("wp"), sum(shares.values())
    each = wm.join(sums, "model").join(wp, ["rep", "prompt_id"]).groupBy("rep", "bin", *keys).agg((F.sum(w * F.col("x")) / F.sum(w * F.col("n"))).alias("rate"))
    share = F.create_map(*[F.lit(v) for name, size in shares.items() for v in (name, size / total)])
    return each.groupBy("rep", *keys).agg(F.sum(F.col("rate") * share[F.col("bin")]).alias("estimate"))


def iid_difference(a: DataFrame, b: DataFrame, reps: int) -> DataFrame:
    """(rep, estimate): difference of the means of two independent resamples of the values x of a(unit, x) and b(unit, x)."""

    def means(df: DataFrame, salt: str, name: str) -> DataFrame:
        own = numbered(df, "unit")
        w = weights(replicates(df.sparkSession, reps), own.count(), salt)
        return w.join(F.broadcast(own), "pos").groupBy("rep").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias(name))

    return means(a, "a", "x").join(means(b, "b", "y"), "rep").select("rep", (F.col("x") - F.col("y")).alias("estimate"))


def permutation_means(rows: DataFrame, reps: int) -> DataFrame:
    """p of the difference of means between groups of rows(unit, observed, x): groups are dealt anew in the order of a hash."""
    units = numbered(rows, "unit")
    seen = units.agg(F.sum(F.col("observed").cast("int")).alias("n"), F.abs(F.avg(F.when(F.col("observed"), F.col("x"))) - F.avg(F.when(~F.col("observed"), F.col("x")))).alias("actual"))
    order = F.sha2(F.concat_ws(":", "rep", "pos"), 256)
    dealt = replicates(rows.sparkSession, reps).crossJoin(F.broadcast(units)).withColumn("to", F.row_number().over(Window.partitionBy("rep").orderBy(order)))
    first = F.col("to") <= F.col("n")
    d = dealt.crossJoin(F.broadcast(seen)).groupBy("rep").agg(F.abs(F.avg(F.when(first, F.col("x"))) - F.avg(F.when(~first, F.col("x")))).alias("delta"), F.max("actual").alias("actual"))
    return d.agg(F.max("actual").alias("difference"), ((F.sum((F.col("delta") >= F.col("actual") - 1e-9).cast("long")) + 1) / F.lit(reps + 1.0)).alias("p"))


def cohen_d(rows: DataFrame, group: Column, x: str, *keys: str) -> DataFrame:
    """Difference of the means of rows with and without a flag, in pooled sample deviations; zero for fewer than two or no spread."""
    a, b = F.when(group, F.col(x)), F.when(~group, F.col(x))
    sums = rows.groupBy(*keys).agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    d = F.when((F.col("na") > 1) & (F.col("nb") > 1) & (pooled > 0), (F.col("ma") - F.col("mb")) / pooled).otherwise(0.0)
    return sums.select(*keys, "na", "nb", d.alias("d"))


def phi(rows: DataFrame, a: Column, b: Column, *keys: str) -> DataFrame:
    """Correlation of two flags from their four counts; NULL where one doesn't vary."""
    n = lambda x, y: F.sum((x & y).cast("double"))
    c = rows.groupBy(*keys).agg(n(a, b).alias("n11"), n(a, ~b).alias("n10"), n(~a, b).alias("n01"), n(~a, ~b).alias("n00"))
    n11, n10, n01, n00 = (F.col(x) for x in ("n11", "n10", "n01", "n00"))
    below = F.sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00))
    return c.select(*keys, F.try_divide(n11 * n00 - n10 * n01, below).alias("phi"))


def line_prediction(rows: DataFrame, x: str, y: str, at: float) -> DataFrame:
    """Slope, intercept, the prediction at a place kept within 0 and 1, and the root mean square of residuals."""
    fit = rows.agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    fit = fit.select("slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))
    rest = F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)
    out = rows.crossJoin(F.broadcast(fit)).agg(F.max("slope").alias("slope"), F.max("intercept").alias("intercept"), F.sqrt(F.avg(rest * rest)).alias("rmse"))
    return out.withColumn("predicted", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.lit(float(at)))))
