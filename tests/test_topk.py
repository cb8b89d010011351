"""Pruned top-k, ranks and fusion beside full scoring."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridlens.functions import exprs as X
from gridlens.operators import retrieval as R
from gridlens.operators import topk as K


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    words = [f"w{int(k)}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(k, r.choices(words, weights, k=r.choice([3, 20, 60]))) for k in range(400)] + [(1000 + k, ["w3", "w250", "w7"]) for k in range(30)] + [(2000, None), (2001, [])]
    queries = [(k, r.choices(words, k=8) + r.choices(words, weights, k=6)) for k in range(12)] + [(50, ["w250", "w7", "w3"]), (51, ["unknown"]), (52, []), (53, ["w299"])]
    frames = [spark.createDataFrame(x, f"{n} long, t array<string>") for x, n in ((docs, "doc"), (queries, "query"))]
    counts = K.counted(frames[0], "doc", F.col("t")).cache()
    asked = R.postings(frames[1], "query", F.col("t")).select(F.col("doc").alias("query"), "term", F.col("tf").alias("qtf")).cache()
    n = frames[0].agg(F.count("*").alias("n")).crossJoin(counts.agg(F.sum("tf").alias("t"))).select("n", (F.col("t") / F.col("n")).alias("avgdl"))
    index = counts.select("doc", "term", "tf")
    full = {"bm25": R.bm25(asked, index, n).cache(), "tfidf": R.tfidf(asked, index, F.lit(len(docs))).cache()}
    pruned = {}
    for name, make in (("bm25", K.bm25_lists), ("tfidf", K.tfidf_lists)):
        found, weights = make(counts, asked, n)
        pruned[name] = (K.planned(weights, found), found)
    return frames[0].select("doc"), full, pruned


def rows(df):
    return sorted((r["query"], r["rank"], r["doc"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("name", ["bm25", "tfidf"])
@pytest.mark.parametrize("k", [1, 5, 33, 1000])
def test_best_are_those_of_full_scoring(corpus, name, k):
    _, full, pruned = corpus
    found, read = K.best(*pruned[name], k)
    assert rows(found) == rows(R.ranked(full[name], k))
    assert all(r["read"] <= r["all"] for r in read.collect())


def test_fewer_postings_are_read_for_fewer_documents(corpus):
    share = [K.best(*corpus[2]["bm25"], k)[1].agg(F.sum("read") / F.sum("all")).first()[0] for k in (1, 1000)]
    assert share[0] < 0.8 and share[1] == 1


def test_ranks_of_targets(spark, corpus):
    ids, full, pruned = corpus
    targets = spark.createDataFrame([(q, d) for q, d in zip([*range(12), 50, 51, 52, 53], [1, 50, 100, 1000, 1029, 2000, 399, 17, 3, 2001, 8, 9, 1015, 77, 5, 1001])], "query long, target long")
    got = R.target_ranks(K.at_least_targets(*pruned["bm25"], targets), targets, ids)
    want = R.target_ranks(full["bm25"], targets, ids)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("depth", [4, 128])
def test_fusion_from_the_tops_of_the_lists(corpus, depth):
    _, full, pruned = corpus
    want = R.ranked(R.fuse([(R.ranked(full["bm25"]), 1.0), (R.ranked(full["tfidf"]), 0.75)]), 5)
    got = K.fused([(*pruned["bm25"], 1.0), (*pruned["tfidf"], 0.75)], 5, depth=depth)
    assert rows(got) == rows(want)


def test_character_runs_of_odd_texts(spark):
    texts = ["", " ", "a", "Ab  c", "π𝔸b", "x" * 3000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.char_ngrams(F.col("t"))).collect()]
    for text, grams in zip(texts, got, strict=True):
        padded = " " + " ".join(text.replace("π", " pi ").lower().split()) + " "
        assert grams == [padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)]
    assert math.isclose(len(got[-1]), 3 * 3002 - 9)
