"""Building a benchmark: group labels and splits in hash order, quotas, representatives, deduplication, canonical logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_order
from ..staging import settle


def majority_label(rows: DataFrame, group: str, label: str, ranks: dict[str, int] | None = None) -> DataFrame:
    """(group, label): of each group, the most frequent label; ties go to the label of least rank, then to the one that sorts first."""
    counts = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(label)), F.lit(len(ranks))) if ranks else F.lit(0)
    return counts.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), rank, F.col(label))).alias(label))


def group_split(rows: DataFrame, group: str, label: str, train: float = 0.8, validation: float = 0.1, ranges: int = 64) -> DataFrame:
    """(group, label, split): within each majority label, groups in hash order are cut by number of groups; no group is parted.

    A group's place is that of its range of hashes (their first digits, so ranges are even) and its place there, so a label that
    most groups have is ordered by many tasks.
    """
    labels = majority_label(rows, group, label).withColumn("hash", F.sha2(F.concat_ws(":", label, group), 256))
    digits = max(1, (ranges - 1).bit_length() // 4 + 1)
    ranged = labels.withColumn("range", F.substring("hash", 1, digits))
    sums = ranged.groupBy(label, "range").agg(F.count("*").alias("m"))
    whole = Window.partitionBy(label)
    starts = sums.select(label, "range", F.coalesce(F.sum("m").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("m").over(whole).alias("n"))
    own = F.row_number().over(Window.partitionBy(label, "range").orderBy("hash")) - 1
    ranked = ranged.withColumn("own", own).join(starts, [label, "range"]).withColumn("r", F.col("start") + F.col("own"))
    cut = lambda share: F.floor(share * F.col("n"))
    split = F.when(F.col("r") < cut(train), "train").when(F.col("r") < cut(train + validation), "validation").otherwise("test")
    return ranked.select(group, label, split.alias("split"))


def overlap(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def first_by(rows: DataFrame, *keys: str, order: list[Column]) -> DataFrame:
    """One row of each key: the first in order. An aggregate, so it is combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])).alias("first")).select(*keys, "first.*")


def dedup_lowest_hash(rows: DataFrame, key: str, *identity: str) -> DataFrame:
    return first_by(rows, key, order=[hash_order(*identity), *[F.col(c) for c in identity]])


def representatives(rows: DataFrame, signature: str, identity: str, seed: str) -> DataFrame:
    """Of each signature: the member of lowest seeded rank, and how many members there are."""
    rank = hash_order(F.lit(seed), F.col(identity).cast("string"))
    return rows.groupBy(signature).agg(F.min_by(identity, rank).alias("representative"), F.count("*").alias("members"))


def quota_pick(rows: DataFrame, stratum: str, flag: str, identity: str, quota: int) -> DataFrame:
    """Up to quota rows of each stratum: half with the flag, half without, the rest filled in hash order."""
    rank = hash_order(F.col(identity).cast("string"))
    half = Window.partitionBy(stratum, flag).orderBy(rank)
    preferred = (F.row_number().over(half) <= quota // 2).cast("int")
    own = Window.partitionBy(stratum).orderBy(F.desc("preferred"), rank)
    return rows.withColumn("preferred", preferred).withColumn("pick", F.row_number().over(own)).where(F.col("pick") <= quota).drop("preferred", "pick")


def joint_allocation(available: DataFrame, label: str, bin_: str, count: str, labels: dict[str, int], bins: dict[str, int]) -> DataFrame:
    """(label, bin, quota) of two labels and three bins whose totals are all given: of the whole tables with these margins the one
    of least squared distance to each label's own profile over bins; of equal ones that with the first label's smaller counts.

    available: counts of the pool, a few rows. The first label's counts of two bins name a table, so all are tried.
    """
    (one, n1), (two, n2) = labels.items()
    names, tops = list(bins), list(bins.values())
    if len(names) != 3 or n1 + n2 != sum(tops):
        raise ValueError("three bins, and totals of labels and bins that agree")
    has = lambda which, b: F.coalesce(F.sum(F.when((F.col(label) == which) & (F.col(bin_) == b), F.col(count))), F.lit(0))
    pool = available.where(F.col(bin_).isin(*names)).agg(*[has(x, b).alias(f"{k}{i}") for k, x in (("a", one), ("b", two)) for i, b in enumerate(names)])
    grid = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(tops[0]))).alias("x0")).select("*", F.explode(F.sequence(F.lit(0), F.lit(tops[1]))).alias("x1")).withColumn("x2", n1 - F.col("x0") - F.col("x1"))
    grid = grid.where(F.col("x2").between(0, tops[2]))
    expected = lambda k, i, n: F.col(f"{k}{i}") * float(n) / (F.col(f"{k}0") + F.col(f"{k}1") + F.col(f"{k}2"))
    terms = [(F.col(f"x{i}") - expected("a", i, n1)) ** 2 + (tops[i] - F.col(f"x{i}") - expected("b", i, n2)) ** 2 for i in range(3)]
    best = grid.orderBy(F.round(terms[0] + terms[1] + terms[2], 9), "x0", "x1", "x2").limit(1)
    rows = [F.struct(F.lit(x).alias(label), F.lit(b).alias(bin_), (F.col(f"x{i}") if x == one else tops[i] - F.col(f"x{i}")).cast("long").alias("quota")) for x in (one, two) for i, b in enumerate(names)]
    return best.select(F.inline(F.array(*rows)))


def stratified_extension(rows: DataFrame, stratum: str, signature: str, identity: str, quotas: list[tuple[str, int]]) -> DataFrame:
    """Strata in order; each takes its quota in hash order among signatures that no earlier one took. As many steps as strata."""
    rank = hash_order(F.col(identity).cast("string"))
    taken = None
    for name, quota in quotas:
        pool = rows.where(F.col(stratum) == name)
        if taken is not None:
            pool = pool.join(taken.select(signature), signature, "left_anti")
        own = first_by(pool, signature, order=[rank]).select(*rows.columns).orderBy(rank).limit(quota)
        taken = own if taken is None else taken.unionByName(own)
    return taken


def quota_search(capacities: DataFrame, stratum: str, cohort: str, free: str, target: int) -> DataFrame:
    """Quotas of a two-cohort table, `target` in each stratum, all combinations tried: least greatest deviation between the
    cohorts' totals, then least squared deviation within strata, then the quotas in order. capacities: a few rows."""
    wide = capacities.groupBy(stratum).pivot(cohort, ["extension", "pilot"]).agg(F.max(free)).na.fill(0)
    options = wide.select(stratum, "extension", F.explode(F.sequence(F.lit(0), F.least("pilot", F.lit(target)).cast("int"))).alias("p")).where(F.lit(target) - F.col("p") <= F.col("extension"))
    names = [r[0] for r in wide.select(stratum).orderBy(stratum).collect()]
    grid = None
    for k, name in enumerate(names):
        own = options.where(F.col(stratum) == name).select(F.col("p").alias(f"p{k}"))
        grid = own if grid is None else grid.crossJoin(own)
    cols = [F.col(f"p{k}") for k in range(len(names))]
    total = sum(cols[1:], cols[0])
    square = sum([(2 * c - target) ** 2 for c in cols], F.lit(0))
    best = grid.orderBy(F.abs(2 * total - target * len(names)), square, *cols).limit(1)
    return best.select(F.inline(F.array(*[F.struct(F.lit(n).alias(stratum), F.col(f"p{k}").cast("long").alias("pilot"), (F.lit(target) - F.col(f"p{k}")).cast("long").alias("extension")) for k, n in enumerate(names)])))


#: Allocations that tie and are carried from stratum to stratum; beyond that those of least hash so far stay.
TIED = 4096


def quota_table(capacities: DataFrame, stratum: str, cohort: str, free: str, target: int, total: int, seed: str = "") -> DataFrame:
    """(stratum, pilot, extension): target rows in each stratum and total pilots in all, as even as can be.

    Least is the greatest deviation of a stratum's pilots from half the target, then the sum of squared deviations, then the seeded
    hash of the pilots of all strata. Strata are added one by one to a table of states (pilots so far, greatest deviation), of
    which only the least squares can win, so the table grows with strata times target, not with the product of options. Raises
    if nothing fits; with more than TIED equal allocations the tie is settled among those.
    """
    wide = capacities.groupBy(stratum).pivot(cohort, ["extension", "pilot"]).agg(F.max(free)).na.fill(0)
    fits = F.filter(F.sequence(F.lit(0), F.lit(target)), lambda p: (p <= F.col("pilot")) & (F.lit(target) - p <= F.col("extension")))
    options = {r[0]: r[1] for r in wide.select(stratum, fits.alias("fits")).orderBy(stratum).collect()}
    states = capacities.sparkSession.range(1).select(F.lit(0).alias("sum"), F.lit(0.0).alias("worst"), F.lit(0.0).alias("squares"), F.array(F.lit("")).alias("keys"))
    for n, fit in enumerate(options.values()):
        step = states.select("*", F.explode(F.array(*map(F.lit, fit)) if fit else F.array().cast("array<int>")).alias("p")).where(F.col("sum") + F.col("p") <= total)
        off = F.abs(F.col("p") - target / 2)
        key = F.transform("keys", lambda k: F.concat(k, F.lit("," if n else ""), F.col("p").cast("string")))
        step = step.select((F.col("sum") + F.col("p")).alias("sum"), F.greatest("worst", off).alias("worst"), (F.col("squares") + off * off).alias("squares"), key.alias("keys"))
        least = F.min("squares").over(Window.partitionBy("sum", "worst"))
        step = step.withColumn("least", least).where("squares = least")
        ordered = F.array_sort(F.transform(F.flatten(F.collect_list("keys")), lambda k: F.struct(hash_order(F.lit(seed), F.lit("allocation"), k).alias("h"), k.alias("k"))))
        states = step.groupBy("sum", "worst", "squares").agg(F.transform(F.slice(ordered, 1, TIED), lambda x: x["k"]).alias("keys"))
        if n % 8 == 7:
            states = settle(states, "states")  # a plan of many exchanges is cut
    final = states.where(F.col("sum") == total).select("worst", "squares", F.explode("keys").alias("key"))
    best = final.orderBy("worst", "squares", hash_order(F.lit(seed), F.lit("allocation"), F.col("key"))).first()
    if best is None:
        raise ValueError("no allocation fits the strata and the total")
    rows = [(name, int(p), target - int(p)) for name, p in zip(options, best.key.split(","), strict=True)]
    return capacities.sparkSession.createDataFrame(rows, f"{stratum} {dict(capacities.dtypes)[stratum]}, pilot long, extension long")


def canonical_log(attempts: DataFrame, key: str, time: str, index: str, error: str) -> DataFrame:
    """One attempt for each key: the earliest without error, else the earliest; with how many it supersedes."""
    order = F.struct(F.col(error), F.col(time), F.col(index))
    return attempts.groupBy(key).agg(F.min_by(F.struct(time, index, error), order).alias("a"), (F.count("*") - 1).alias("superseded")).select(key, "a.*", "superseded")


#: Why an attempt gave way to another one.
DUPLICATE, RETRYABLE = "duplicate successful call", "retryable API error"


def superseded(attempts: DataFrame, key: str, time: str, index: str, error: str) -> DataFrame:
    """The attempts that canonical_log() leaves out, as they are, with the index that stands for them and the reason."""
    kept = canonical_log(attempts, key, time, index, error).select(key, F.col(index).alias("kept_index"))
    reason = F.when(F.col(error), RETRYABLE).otherwise(DUPLICATE)
    return attempts.join(kept, key).where(~F.col(index).eqNullSafe(F.col("kept_index"))).withColumn("reason", reason)


def last_write(attempts: DataFrame, key: str, time: str, index: str) -> DataFrame:
    others = [c for c in attempts.columns if c != key]
    return attempts.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(time, index)).alias("a")).select(key, "a.*")


def disjoint_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both panels; a key in both is listed by common_keys()."""
    return a.unionByName(b)


def novel(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of the keys (signature, group, near-duplicate group) with known ones; a null key counts as novel."""
    out = rows
    for k in keys:
        out = out.join(known.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return out.select(*rows.columns)


def in_request_order(rows: DataFrame, requests: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of a merged log in the order in which they were asked for; those that weren't are left out."""
    return rows.join(requests.select(key, position), key).orderBy(position)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def transport_affected(attempts: DataFrame, key: str, time: str, index: str, error: str) -> DataFrame:
    """Attempts numbered within their key, and whether one had to be tried again before it."""
    w = Window.partitionBy(key).orderBy(time, index)
    return attempts.withColumns({"attempt": F.row_number().over(w).cast("long"), "after_error": F.coalesce(F.lag(error).over(w), F.lit(False))})
