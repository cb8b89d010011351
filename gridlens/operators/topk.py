"""Exact best documents and exact ranks from weighted postings without scoring every pair: maxima of blocks bound what isn't read.

A score is a sum of w * imp over the terms that a query and a document share, and no part of it is negative. Terms whose parts
can't lift a document to the threshold by themselves are read for those documents only that other terms bring near to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import each_of
from ..staging import settle

#: Scores count to nine digits; bounds are sums in another order.
SLACK = 1e-7
#: Ids of a block of documents; lengths of a block differ by less than a fifth.
BLOCK_BITS, PER_DOUBLING = 9, 4


@dataclass(frozen=True)
class Lists:
    """postings (term, doc, block, imp), the largest imp of each term in each block, and of each term with its documents."""

    postings: DataFrame
    blocks: DataFrame
    tops: DataFrame


def counted(docs: DataFrame, doc: str, terms: Column) -> DataFrame:
    """(doc, dl, term, tf): postings with each document's number of terms, in one pass over the texts."""
    each = docs.select(F.col(doc).alias("doc"), terms.alias("t")).select("doc", F.size("t").alias("dl"), "t")
    return each_of(each, F.col("t"), "term", "doc", "dl").groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))


def block_of(doc: str, length: str) -> Column:
    """Documents of about one length and in one range of ids, so that maxima lie close to what their documents have."""
    size = F.floor(F.log2(1 + F.col(length)) * PER_DOUBLING).cast("long")
    return (F.shiftleft(size, 52) + F.shiftright(doc, BLOCK_BITS).bitwiseAND((1 << 52) - 1)).alias("block")


def lists(postings: DataFrame) -> Lists:
    """From (term, doc, block, imp); written once, since it is read for maxima, near documents and completion."""
    held = settle(postings.select("term", "doc", "block", "imp"), "lists")
    blocks = settle(held.groupBy("term", "block").agg(F.max("imp").alias("top"), F.count("*").alias("n")), "maxima")
    return Lists(held, blocks.select("term", "block", "top"), blocks.groupBy("term").agg(F.max("top").alias("top"), F.sum("n").alias("df")))


def bm25_lists(counts: DataFrame, queries: DataFrame, n_docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> tuple[Lists, DataFrame]:
    """Lists of the terms that some query has, and (query, term, w). counts: (doc, dl, term, tf); n_docs: one row (n, avgdl)."""
    own = counts.join(queries.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(n_docs.select("avgdl")))
    imp = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    out = lists(own.select("term", "doc", block_of("doc", "dl"), imp.alias("imp")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return out, queries.join(out.tops, "term").crossJoin(F.broadcast(n_docs.select("n"))).select("query", "term", (F.col("qtf") * idf).alias("w"))


def tfidf_lists(counts: DataFrame, queries: DataFrame, n_docs: DataFrame) -> tuple[Lists, DataFrame]:
    """The same for cosines of TF-IDF vectors. Norms need all terms of a document; only the queries' terms become lists."""
    df = settle(counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs.select("n"))).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "idf")
    raw = counts.join(df, "term").select("doc", "dl", "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    norms = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    own = raw.join(queries.select("term").distinct(), "term", "left_semi").join(norms, "doc")
    out = lists(own.select("term", "doc", block_of("doc", "dl"), (F.col("raw") / F.col("norm")).alias("imp")))
    q = queries.join(df, "term").select("query", "term", ((1 + F.log("qtf")) * F.col("idf")).alias("qw"))
    size = q.groupBy("query").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    return out, q.join(size, "query").select("query", "term", (F.col("qw") / F.col("qn")).alias("w"))


def planned(weights: DataFrame, index: Lists) -> DataFrame:
    """(query, term, w, df, rest, seed): terms by the most that they can give. rest: what a term and those after it give at most;
    seed: whether it belongs to the first that make up half of what all can give."""
    own = weights.join(index.tops, "term").withColumn("most", F.col("w") * F.col("top"))
    order = Window.partitionBy("query").orderBy(F.desc("most"), "term")
    rest = F.sum("most").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return settle(own.select("query", "term", "w", "df", rest.alias("rest"), (before < F.sum("most").over(Window.partitionBy("query")) / 2).alias("seed")), "planned")


def partial(plan: DataFrame, index: Lists) -> DataFrame:
    hits = plan.select("query", "term", "w").join(index.postings, "term")
    return hits.groupBy("query", "doc", "block").agg(F.sum(F.col("w") * F.col("imp")).alias("part"))


def kth(parts: DataFrame, k: int) -> DataFrame:
    """(query, theta): the kth largest part, or zero if there are fewer."""
    best = parts.select("query", "part").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("part")))).where(F.col("r") <= k)
    return best.groupBy("query").agg(F.when(F.count("*") == k, F.min("part")).otherwise(0.0).alias("theta"))


def reaching(plan: DataFrame, index: Lists, theta: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, doc, score) of all documents whose score reaches theta(query, theta), or zero where that has no row; with k, of
    those that may be among a query's k best. And (query, read, all): postings that were read, and all of the query's terms."""
    whole = plan.join(theta, "query", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
    whole = whole.withColumn("first", (F.col("theta") <= 0) | (F.col("rest") >= F.col("theta") - SLACK))
    parts = settle(partial(whole.where("first"), index), "parts")
    floor = whole.groupBy("query").agg(F.max("theta").alias("theta"))
    if k:
        floor = floor.join(kth(parts, k).withColumnRenamed("theta", "raised"), "query", "left").select("query", F.greatest("theta", F.coalesce("raised", F.lit(0.0))).alias("theta"))
    later = whole.where("not first").select("query", "term", "w")
    more = later.join(index.blocks, "term").groupBy("query", "block").agg(F.sum(F.col("w") * F.col("top")).alias("more"))
    near = parts.join(floor, "query").join(more, ["query", "block"], "left")
    near = settle(near.where(F.col("part") + F.coalesce("more", F.lit(0.0)) >= F.col("theta") - SLACK).select("query", "doc", "part", "theta"), "near")
    rest = near.select("query", "doc").join(later, "query").join(index.postings.select("term", "doc", "imp"), ["term", "doc"])
    rest = rest.groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("imp")).alias("others"), F.count("*").alias("n"))
    scores = near.join(rest, ["query", "doc"], "left").withColumn("score", F.round(F.col("part") + F.coalesce("others", F.lit(0.0)), 9))
    completed = rest.groupBy("query").agg(F.sum("n").alias("completed"))
    read = whole.groupBy("query").agg(F.sum(F.when(F.col("first"), F.col("df")).otherwise(0)).alias("listed"), F.sum("df").alias("all")).join(completed, "query", "left")
    return scores.where(F.col("score") >= F.col("theta") - SLACK).select("query", "doc", "score"), read.select("query", (F.col("listed") + F.coalesce("completed", F.lit(0))).alias("read"), "all")


def best(plan: DataFrame, index: Lists, k: int) -> tuple[DataFrame, DataFrame]:
    """(query, doc, score, rank): the k best of each query by (-score, doc); and the postings read, as reaching() counts them.

    The terms that can give most set a first threshold: the kth best sum of their parts.
    """
    scores, read = reaching(plan, index, kth(partial(plan.where("seed"), index), k), k)
    first = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= k), read


def at_least_targets(plan: DataFrame, index: Lists, targets: DataFrame) -> DataFrame:
    """(query, doc, score) of what scores as high as the query's target or higher: all that a target's rank rests on. For a
    target without a common term that is every document that has one."""
    own = plan.select("query", "term", "w").join(targets, "query").join(index.postings.select("term", F.col("doc").alias("target"), "imp"), ["term", "target"])
    theta = own.groupBy("query").agg(F.sum(F.col("w") * F.col("imp")).alias("theta"))
    return reaching(plan.join(targets.select("query").distinct(), "query", "left_semi"), index, theta)[0]


def fused(sources: list[tuple[DataFrame, Lists, float]], k: int, damp: int = 60, depth: int = 128) -> DataFrame:
    """(query, doc, score, rank): the k best by reciprocal-rank fusion of rankings of all documents, from the tops of the lists.

    A document that a list hasn't shown down to its depth can gain less from it than the next rank there would give. A query
    is settled once k documents are known from every list and neither another one nor any unseen one can reach the last of
    them; lists of the others are followed four times as deep. A list that ends is known whole.
    """
    out, open_queries = None, None
    while True:
        rows = None
        for i, (plan, index, weight) in enumerate(sources):
            own = plan if open_queries is None else plan.join(open_queries, "query", "left_semi")
            shown = best(own, index, depth)[0].select("query", "doc", (F.lit(weight) / (damp + F.col("rank"))).alias("s"), F.lit(i).alias("i"))
            full = F.count("*").over(Window.partitionBy("query")) == depth
            shown = shown.withColumn("next", F.when(full, weight / (damp + depth + 1)).otherwise(0.0))
            rows = shown if rows is None else rows.unionByName(shown)
        rows = settle(rows, "shown")
        unseen = rows.groupBy("query", "i").agg(F.max("next").alias("next")).groupBy("query").agg(F.sum("next").alias("unseen"))
        docs = rows.groupBy("query", "doc").agg(F.round(F.sum("s"), 9).alias("score"), F.sum("next").alias("seen")).join(unseen, "query")
        docs = docs.withColumn("gain", F.col("unseen") - F.col("seen")).withColumn("known", F.col("gain") < 1e-12)
        ranks = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query", "known").orderBy(F.desc("score"), "doc")).cast("long"))
        last = F.max(F.when(F.col("known") & (F.col("rank") == k), F.col("score")))
        rival = F.coalesce(F.max(F.when(~F.col("known"), F.col("score") + F.col("gain"))), F.lit(0.0))
        state = ranks.groupBy("query").agg(last.alias("last"), rival.alias("rival"), F.first("unseen").alias("unseen"))
        done = (F.col("unseen") < 1e-12) | (F.coalesce("last", F.lit(-1.0)) - SLACK > F.greatest("rival", "unseen"))
        state = settle(state.select("query", done.alias("done")), "settled")
        found = ranks.where(F.col("known") & (F.col("rank") <= k)).join(state.where("done"), "query", "left_semi").select("query", "doc", "score", "rank")
        out = found if out is None else out.unionByName(found)
        open_queries = state.where("not done").select("query")
        if open_queries.isEmpty():
            return out
        depth *= 4
