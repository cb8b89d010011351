"""Repeatability over three runs: agreement, paired tests, patterns, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, rate


def triples(runs: DataFrame, endpoint: str, *more: str) -> DataFrame:
    """(model, prompt_id, a, b, c): an endpoint in runs 1, 2, 3 as 0/1."""
    at = lambda k: F.max(F.when(F.col("run") == k, F.col(endpoint).cast("int")))
    return runs.groupBy("model", "prompt_id", *more).agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))




def agreement(items: DataFrame, *keys: str) -> DataFrame:
    """Unanimous share, share with any flip, mean pairwise agreement, positive rate, and Gwet's AC1 (NaN where undefined)."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    same = (a == b).cast("int") + (a == c).cast("int") + (b == c).cast("int")
    out = items.groupBy(*keys).agg(
        F.count("*").alias("items"), F.avg((same == 3).cast("int")).alias("unanimous"), F.avg((same < 3).cast("int")).alias("any_flip"),
        F.avg(same / 3.0).alias("pairwise"), F.avg((a + b + c) / 3.0).alias("positive"),
    )
    chance = 2 * F.col("positive") * (1 - F.col("positive"))
    return out.withColumn("ac1", F.when(chance == 1, F.lit(float("nan"))).otherwise((F.col("pairwise") - chance) / (1 - chance)))


def cochran_q(items: DataFrame, *keys: str) -> DataFrame:
    """Cochran's Q of three runs and its chi-square tail with two degrees of freedom, exp(-q/2); no variation gives 0 and 1."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    row = a + b + c
    s = items.groupBy(*keys).agg(*[F.sum(x).alias(f"s{k}") for k, x in enumerate((a, b, c))], F.sum(row).alias("t"), F.sum(row * row).alias("t2"), F.count("*").alias("items"))
    squares = F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")
    q = F.coalesce(F.try_divide((2 * (3 * squares - F.col("t") * F.col("t"))).cast("double"), (3 * F.col("t") - F.col("t2")).cast("double")), F.lit(0.0))
    return s.select(*keys, "items", q.alias("q"), F.exp(-q / 2).alias("p"))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, 1/2), k at most n/2: terms relative to the largest, whose logarithm is summed apart, so
    that nothing over- or underflows."""

    def step(acc: Column, j: Column) -> Column:
        i = k - j + 1
        r = acc["r"] * i / (n - i + 1)
        return F.struct(r.alias("r"), (acc["s"] + r).alias("s"), (acc["l"] + F.log((n - i + 1) / i)).alias("l"))

    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("s"), F.lit(0.0).alias("l"))
    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), start, step, lambda acc: F.log(acc["s"]) + acc["l"])
    return F.exp(F.when(k >= 1, whole).otherwise(0.0) - n * F.log(F.lit(2.0)))


def mcnemar(pairs: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Discordant counts and the exact two-sided p of two paired 0/1 columns."""
    s = pairs.groupBy(*keys).agg(F.sum((F.col(x) > F.col(y)).cast("long")).alias("only_x"), F.sum((F.col(x) < F.col(y)).cast("long")).alias("only_y"))
    n, k = F.col("only_x") + F.col("only_y"), F.least("only_x", "only_y")
    return s.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(k, n))))


def run_pairs(items: DataFrame) -> DataFrame:
    """Each item once for each pair of runs: pair, x, y."""
    rows = [F.struct(F.lit(n).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y")) for n, x, y in (("1-2", "a", "b"), ("1-3", "a", "c"), ("2-3", "b", "c"))]
    return items.select("model", "prompt_id", F.inline(F.array(*rows)))


def holm(tests: DataFrame, p: str, *within: str, tie: list[str]) -> DataFrame:
    """Adds p_holm: step-down adjusted, capped at one."""
    w = Window.partitionBy(*within).orderBy(p, *tie)
    m = F.count("*").over(Window.partitionBy(*within))
    raw = F.least(F.lit(1.0), (m - F.col("__r") + 1) * F.col(p))
    numbered = tests.withColumn("__r", F.row_number().over(w)).withColumn("__raw", raw)
    return numbered.withColumn("p_holm", F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__r", "__raw")


def patterns(items: DataFrame) -> DataFrame:
    """How often each of 000 .. 111 occurs; those that don't are kept as zero."""
    spark = items.sparkSession
    every = spark.range(8).select(F.lpad(F.bin("id"), 3, "0").alias("pattern"))
    return every.join(items.groupBy(F.concat("a", "b", "c").alias("pattern")).agg(F.count("*").alias("n")), "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def majority(items: DataFrame, *keys: str) -> DataFrame:
    vote = ((F.col("a") + F.col("b") + F.col("c")) >= 2).cast("int")
    return items.groupBy(*keys).agg(F.count("*").alias("items"), F.avg(vote).alias("majority"), F.avg("a").alias("run1"), (F.avg(vote) - F.avg("a")).alias("change"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's and Spearman's correlation; NULL below two rows or without variation."""
    ranked = df.select(x, y, average_rank(F.col(x)).alias("rx"), average_rank(F.col(y)).alias("ry"))
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))  # noqa: E731  corr() fails without variation
    return ranked.agg(F.count("*").alias("n"), r(x, y).alias("pearson"), r("rx", "ry").alias("spearman"))


def kendall_tau_b(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of a small table (models): pairs compared one by one."""
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(F.broadcast(b), F.col(f"a.{key}") < F.col(f"b.{key}"))
    sx, sy = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")), F.signum(F.col(f"a.{y}") - F.col(f"b.{y}"))
    s = pairs.agg(F.sum(sx * sy).alias("s"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"))
    return s.select(F.try_divide(F.col("s"), F.sqrt(F.col("nx") * F.col("ny"))).alias("tau_b"))


def top_jaccard(df: DataFrame, x: str, y: str, key: str, k: int = 5) -> DataFrame:
    """Overlap of the two top-k sets, ties at the edge included."""
    every = Window.partitionBy()
    r = df.select(key, F.rank().over(every.orderBy(F.desc(x))).alias("rx"), F.rank().over(every.orderBy(F.desc(y))).alias("ry"))
    both, either = (F.col("rx") <= k) & (F.col("ry") <= k), (F.col("rx") <= k) | (F.col("ry") <= k)
    return r.agg(rate(F.sum(both.cast("int")), F.sum(either.cast("int"))).alias("jaccard"))


def stability(rates: DataFrame, key: str, first: str, second: str, frontier: Column, k: int = 5) -> DataFrame:
    """One row for two runs' rates of models (a small table): rank correlations, overlap of the first k with ties at the edge, and
    mean rates of frontier models and of the others in either run."""
    named = rates.select(key, F.col(first).alias("x"), F.col(second).alias("y"), frontier.alias("front"))
    mean = lambda c, own: F.avg(F.when(F.col("front") == own, F.col(c)))
    means = named.agg(*[mean(c, own).alias(f"{name}_{n}") for name, own in (("frontier", True), ("others", False)) for c, n in (("x", "first"), ("y", "second"))])
    return spearman(named, "x", "y").select("spearman").crossJoin(kendall_tau_b(named, key, "x", "y")).crossJoin(top_jaccard(named, "x", "y", key, k)).crossJoin(means)


def majority_summary(items: DataFrame, key: str) -> DataFrame:
    """One row: items(a, b, c by endpoint as arrays) whose majority of runs executed and matched, the difference from the first
    run in percentage points, and Spearman's correlation of models' rates by majority and in the first run."""
    vote = lambda e: F.when(F.aggregate(e, F.lit(0), lambda t, x: t + x) >= 2, 1).otherwise(0)
    each = items.select(key, vote("execution").alias("e"), vote("signature").alias("m"), F.col("execution")[0].alias("e1"), F.col("signature")[0].alias("m1"))
    wrong = F.size(F.filter(F.arrays_zip("execution", "signature"), lambda r: (r["execution"] == 1) & (r["signature"] == 0))) >= 2
    runwise = items.agg(F.sum(wrong.cast("long")).alias("runwise_wrong"))
    whole = each.agg(F.count("*").alias("n"), F.sum("e").cast("long").alias("execution"), F.sum("m").cast("long").alias("signature"), (F.sum("e") - F.sum("m")).cast("long").alias("es_gap"), (100 * (F.avg("m") - F.avg("m1"))).alias("signature_change_pp"), (100 * (F.avg("e") - F.avg("e1"))).alias("execution_change_pp"))
    models = each.groupBy(key).agg(F.sum("m").alias("x"), F.sum("m1").alias("y"))
    return whole.crossJoin(runwise).crossJoin(spearman(models, "x", "y").select(F.col("spearman").alias("rank_correlation")))


def digest_agreement(rows: DataFrame, digest: str, key: str = "model", item: str = "prompt_id") -> DataFrame:
    """(pair, items, same, rate): of items whose digests in both runs of a pair aren't empty, how many are equal; of those with all
    three, "all" counts items whose runs all agree and "pairs" the mean over their three pairs. No items give a null rate."""
    at = lambda k: F.nullif(F.max(F.when(F.col("run") == k, F.col(digest))), F.lit(""))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    whole = a.isNotNull() & b.isNotNull() & c.isNotNull()
    same = (a == b).cast("int") + (a == c).cast("int") + (b == c).cast("int")
    each = lambda n, of, hit: F.struct(F.lit(n).alias("pair"), of.cast("long").alias("of"), F.coalesce(hit, F.lit(0)).cast("long").alias("hit"))
    two = lambda n, x, y: each(n, x.isNotNull() & y.isNotNull(), (x == y).cast("int"))
    kinds = [two("1-2", a, b), two("1-3", a, c), two("2-3", b, c), each("all", whole, (same == 3).cast("int")), each("pairs", 3 * whole.cast("int"), F.when(whole, same))]
    items = rows.groupBy(key, item).agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    return items.select(F.inline(F.array(*kinds))).groupBy("pair").agg(F.sum("of").alias("items"), F.sum("hit").alias("same"), rate(F.sum("hit"), F.sum("of")).alias("rate"))
