"""Ranked retrieval as joins of postings: BM25, TF-IDF cosine, reciprocal-rank fusion, rank metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import each_of


def postings(docs: DataFrame, doc: str, terms: Column) -> DataFrame:
    """(doc, term, tf)."""
    return each_of(docs, terms, "term", F.col(doc).alias("doc")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, index: DataFrame, n_docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of all pairs with a common term. queries: (query, term, qtf); index: postings; n_docs: one row (n, avgdl).

    Postings of terms that no query has fall away first; lengths are of all terms.
    """
    length = index.groupBy("doc").agg(F.sum("tf").alias("dl"))
    index = index.join(queries.select("term").distinct(), "term", "left_semi")
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = queries.join(df, "term").crossJoin(F.broadcast(n_docs)).select("query", "term", "qtf", idf.alias("idf"), "avgdl")
    hits = weighted.join(index, "term").join(length, "doc")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query", "doc").agg(F.round(F.sum(part), 9).alias("score"))


def tfidf_weights(index: DataFrame, n_docs: Column) -> DataFrame:
    """(doc, term, w): (1 + ln tf) * (ln((N+1)/(df+1)) + 1), of unit length for each document."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    raw = index.join(df, "term").withColumn("w", (1 + F.log("tf")) * (F.log((n_docs + 1) / (F.col("df") + 1)) + 1))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))


def tfidf(queries: DataFrame, index: DataFrame, n_docs: Column) -> DataFrame:
    """(query, doc, score): cosine of TF-IDF vectors; a query's terms that no document has fall away before its norm."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    q = queries.join(df, "term").withColumn("qw", (1 + F.log("qtf")) * (F.log((n_docs + 1) / (F.col("df") + 1)) + 1))
    norm = q.groupBy("query").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    q = q.join(norm, "query").select("query", "term", (F.col("qw") / F.col("qn")).alias("qw"))
    return q.join(tfidf_weights(index, n_docs), "term").groupBy("query", "doc").agg(F.round(F.sum(F.col("qw") * F.col("w")), 9).alias("score"))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds rank by (-score, doc) within a query; the first k."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def ids_before(ids: DataFrame, targets: DataFrame, ranges: int = 256) -> DataFrame:
    """(target, before): how many of ids(doc) are less than each target.

    Ids are cut into ranges at sampled quantiles; whole ranges before a target's own are summed, and only within its own range
    is it compared with ids, so nothing orders all ids in one task.
    """
    cuts = ids.select(F.percentile_approx("doc", [k / ranges for k in range(1, ranges)], 10_000).alias("cuts"))
    place = lambda c: F.size(F.filter("cuts", lambda x: x < F.col(c)))
    each = ids.crossJoin(F.broadcast(cuts)).select("doc", place("doc").alias("range"))
    sums = each.groupBy("range").agg(F.count("*").alias("n"))
    starts = sums.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # ranges rows
    own = targets.select("target").distinct().crossJoin(F.broadcast(cuts)).select("target", place("target").alias("range"))
    inside = own.join(each, "range", "left").groupBy("target", "range").agg(F.count_if(F.col("doc") < F.col("target")).alias("inside"))
    return inside.join(F.broadcast(starts), "range", "left").select("target", (F.coalesce("start", F.lit(0)) + F.col("inside")).alias("before"))


def target_ranks(scores: DataFrame, targets: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(query, rank) of each query's target in the full ranking, documents of score zero included, without listing them.

    targets: (query, target). Among documents without a common term, order is by id: the place is counted, not enumerated.
    """
    own = targets.join(scores.withColumnRenamed("doc", "target"), ["query", "target"], "left").withColumn("s", F.coalesce("score", F.lit(0.0)))
    better = (F.col("o.score") > F.col("t.s")) | ((F.col("o.score") == F.col("t.s")) & (F.col("o.doc") < F.col("t.target")))
    hit = own.alias("t").join(scores.where("score > 0").alias("o"), F.col("t.query") == F.col("o.query"), "left")
    counts = hit.groupBy("t.query", "t.target", "t.s").agg(
        F.sum(better.cast("long")).alias("above"), F.count("o.doc").alias("positive"), F.sum((F.col("o.doc") < F.col("t.target")).cast("long")).alias("positive_before")
    )
    zero = F.coalesce("positive", F.lit(0)) + F.col("before") - F.coalesce("positive_before", F.lit(0)) + 1
    return counts.join(ids_before(doc_ids, targets), "target").select("query", F.when(F.col("s") > 0, F.coalesce("above", F.lit(0)) + 1).otherwise(zero).cast("long").alias("rank"))


def fuse(lists: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: (query, doc, score)."""
    parts = [df.select("query", "doc", (F.lit(w) / (k + F.col("rank"))).alias("s")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query", "doc").agg(F.round(F.sum("s"), 9).alias("score"))


def rank_metrics(ranks: DataFrame, *keys: str) -> DataFrame:
    at = lambda k: F.avg((F.col("rank") <= k).cast("int")).alias(f"recall_{k}")
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), at(1), at(5), at(10), F.avg(1 / F.col("rank")).alias("mrr"), F.avg("rank").alias("mean_rank"), F.percentile("rank", F.lit(0.5)).alias("median_rank"))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def best(results: DataFrame, *order: str) -> DataFrame:
    """The row that is greatest in order, of equal ones the first by its position column pos."""
    return results.agg(F.max_by(F.struct("*"), F.struct(*order, -F.col("pos"))).alias("r")).select("r.*")
