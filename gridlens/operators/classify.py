"""Naive Bayes over categorical tokens as joins, and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import each_of, rate

#: Ranges that the scores of a curve are cut into.
RANGES = 64


def fit_nb(train: DataFrame, label: str, tokens: Column, alpha: float = 1.0, prior: str = "share", n: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(priors(label, prior), terms(label, term, lp), unseen(label, lp)): log probabilities, smoothed by alpha over the vocabulary.

    prior: "share" of the rows, "smoothed" share, by alpha for each label, or "uniform". Labels are few.
    n: a column that says how many rows a row stands for.
    """
    total, times = Window.partitionBy(), F.col(n) if n else F.lit(1)
    own, all_, k = F.col("n"), F.sum("n").over(total), F.count("*").over(total)
    of = {"share": F.log(own / all_), "smoothed": F.log((own + alpha) / (all_ + alpha * k)), "uniform": -F.log(k.cast("double"))}
    priors = train.groupBy(label).agg(F.sum(times).alias("n")).select(label, of[prior].alias("prior"))
    counts = each_of(train, tokens, "term", label, times.alias("times")).groupBy(label, "term").agg(F.sum("times").alias("c"))
    vocabulary = counts.agg(F.countDistinct("term").alias("v"))
    sums = counts.groupBy(label).agg(F.sum("c").alias("t")).crossJoin(F.broadcast(vocabulary))
    unseen = priors.join(sums, label, "left").select(label, F.log(F.lit(alpha) / (F.coalesce("t", F.lit(0)) + alpha * F.coalesce("v", F.lit(1)))).alias("none"))
    terms = counts.join(F.broadcast(sums), label).select(label, "term", F.log((F.col("c") + alpha) / (F.col("t") + alpha * F.col("v"))).alias("lp"))
    return priors, terms, unseen


def score_nb(rows: DataFrame, identity: str, label: str, tokens: Column, model: tuple[DataFrame, DataFrame, DataFrame], digits: int | None = 9) -> DataFrame:
    """(identity, label, score): every label's log score, to so many digits if any. A token that a label never had counts as unseen: each row starts with
    all its tokens unseen and terms that are known make good the difference, so no row meets the whole vocabulary."""
    priors, terms, unseen = model
    own = rows.select(identity, F.size(tokens).alias("size"))
    base = own.crossJoin(F.broadcast(priors.join(unseen, label))).withColumn("base", F.col("prior") + F.col("size") * F.col("none"))
    each = each_of(rows, tokens, "term", identity).groupBy(identity, "term").agg(F.count("*").alias("k"))
    gain = each.join(terms, "term").join(F.broadcast(unseen), label).groupBy(identity, label).agg(F.sum(F.col("k") * (F.col("lp") - F.col("none"))).alias("gain"))
    score = F.col("base") + F.coalesce("gain", F.lit(0.0))
    return base.join(gain, [identity, label], "left").select(identity, label, (score if digits is None else F.round(score, digits)).alias("score"))


def predict(scores: DataFrame, identity: str, label: str) -> DataFrame:
    """The label of the highest score; ties go to the one that sorts first."""
    return scores.groupBy(identity).agg(F.min_by(label, F.struct(-F.col("score"), F.col(label))).alias("predicted"))


def baseline_metrics(rows: DataFrame, truth: str, predicted: Column, score: Column, positive: str) -> DataFrame:
    """Accuracy, share of positives missed and of negatives called positive, and the area under the curve, of any rule."""
    own = rows.select(F.col(truth).alias("t"), predicted.alias("p"), score.cast("double").alias("s"))
    pos = F.col("t") == positive
    sums = own.agg(
        F.count("*").alias("n"), F.avg((F.col("t") == F.col("p")).cast("int")).alias("accuracy"),
        F.avg(F.when(pos, (F.col("p") != positive).cast("int"))).alias("missed"), F.avg(F.when(~pos, (F.col("p") == positive).cast("int"))).alias("called"),
    )
    return sums.crossJoin(auroc(own, "s", pos).select("auroc"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def label_metrics(table: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) from a confusion table; undefined ones are zero."""
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    pairs = table.select(F.col(truth).alias("t"), F.col(predicted).alias("p"), "n")
    long = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("said"), hit.alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x"))
    sums = long.groupBy("x.label").agg(F.sum("x.truth").alias("support"), F.sum("x.said").alias("said"), F.sum("x.hit").alias("hit"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(rate(F.col("hit"), F.col("said"))), zero(rate(F.col("hit"), F.col("support")))
    return sums.select("label", "support", "hit", p.alias("precision"), r.alias("recall"), zero(F.try_divide(2 * p * r, p + r)).alias("f1"))


def overall(labels: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy over labels with support, and macro F1."""
    return labels.agg(
        F.sum("support").alias("n"), rate(F.sum("hit"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
    )


def auroc(rows: DataFrame, score: str, positive: Column, weight: Column | None = None, *keys: str) -> DataFrame:
    """Area under the ROC curve, ties at one half, of each key.

    Rows are summed for each score; scores are then cut into ranges of about equal count at sampled quantiles, so what lies
    below a score is the sum of the ranges before its own and of its own up to it, and no task orders all scores.
    """
    w = weight if weight is not None else F.lit(1.0)
    each = rows.groupBy(*keys, score).agg(F.sum(F.when(positive, w).otherwise(0.0)).alias("pos"), F.sum(F.when(positive, 0.0).otherwise(w)).alias("neg"))
    cuts = each.select(F.percentile_approx(F.col(score).cast("double"), [k / RANGES for k in range(1, RANGES)], 1000).alias("cuts"))
    own = F.size(F.filter("cuts", lambda c: c < F.col(score).cast("double")))
    ranged = each.crossJoin(F.broadcast(cuts)).withColumn("range", own).drop("cuts")
    sums = ranged.groupBy(*keys, "range").agg(F.sum("neg").alias("neg"))
    before = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = sums.select(*keys, "range", before(Window.partitionBy(*keys).orderBy("range")).alias("start"))  # RANGES rows a key
    inside = ranged.withColumn("inside", before(Window.partitionBy(*keys, "range").orderBy(score)))
    below = F.col("start") + F.col("inside")
    return inside.join(F.broadcast(starts), [*keys, "range"]).groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auroc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
