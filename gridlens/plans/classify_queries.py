"""Binned features, Naive Bayes and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import classify as C
from . import fixtures as D
from .cells_queries import r6
from .registry import query

_BIN = "CASE WHEN x < 0 THEN 'negative' " + " ".join(f"WHEN x = {e} THEN '{n}'" for e, n in X.EXACT_BINS) + " " + " ".join(f"WHEN x <= {e} THEN '{n}'" for e, n in X.NUMERIC_BINS) + " ELSE '1000_plus' END"


@query("numeric_bins", f"SELECT bin, count(*) AS n FROM (SELECT CASE WHEN raw IS NULL THEN '<missing>' WHEN x IS NULL THEN '<non_numeric>' ELSE {_BIN} END AS bin FROM (SELECT raw, try_cast(raw AS DOUBLE) AS x FROM (SELECT CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN event_type ELSE CAST(value - 5 AS VARCHAR) END AS raw FROM events))) GROUP BY bin")
def _(spark, sf):
    raw = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, F.col("event_type")).otherwise((F.col("value") - 5).cast("string"))
    return D.table(spark, sf, "events").select(raw.alias("raw")).groupBy(X.numeric_bin(F.col("raw")).alias("bin")).agg(F.count("*").alias("n"))


def _tokens(df):
    own = F.array(F.concat(F.lit("lang="), X.normal_value(F.col("lang"))), F.concat(F.lit("source="), X.normal_value(F.col("source"))), F.concat(F.lit("chars_bin="), X.numeric_bin(F.col("n_chars").cast("string"))))
    return df.withColumn("tokens", F.concat(own, F.transform(X.code_tokens(F.col("text")), lambda t: F.concat(F.lit("code="), t))))


_CODE = r"list_transform(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?', 0), lambda w: lower(w)), lambda w: length(w) > 1 OR w IN ('h', 'x', 'y', 'z', 's', 't'))[1:400], lambda w: 'code=' || w)"
_NB = f"""tk AS (SELECT doc_id, y, doc_id % 5 = 0 AS test, ['lang=' || trim(lang), 'source=' || trim(source), 'chars_bin=' || (SELECT {_BIN} FROM (SELECT CAST(n_chars AS DOUBLE) AS x))] || {_CODE} AS tokens FROM labelled),
 pr AS (SELECT y, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM tk WHERE NOT test GROUP BY y), ct AS (SELECT y, term, count(*) AS c FROM (SELECT y, unnest(tokens) AS term FROM tk WHERE NOT test) GROUP BY 1, 2),
 sm AS (SELECT y, sum(c) AS t, (SELECT count(DISTINCT term) FROM ct) AS v FROM ct GROUP BY y), te AS (SELECT doc_id, y AS truth, unnest(tokens) AS term FROM tk WHERE test),
 sc AS (SELECT te.doc_id, pr.y, any_value(truth) AS truth, round(any_value(prior) + sum(ln((coalesce(c, 0) + 1) / (t + v))), 9) AS score FROM te CROSS JOIN pr JOIN sm ON sm.y = pr.y LEFT JOIN ct ON ct.y = pr.y AND ct.term = te.term GROUP BY 1, 2),
 pd AS (SELECT doc_id, truth, y AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, y) AS r FROM sc) WHERE r = 1)"""


def _scores(spark, sf):
    rows = _tokens(D.labelled(spark, sf))
    model = C.fit_nb(rows.where("doc_id % 5 <> 0"), "y", F.col("tokens"))
    return C.score_nb(rows.where("doc_id % 5 = 0"), "doc_id", "y", F.col("tokens"), model)


def _predicted(spark, sf):
    truth = D.labelled(spark, sf).select("doc_id", F.col("y").alias("truth"))
    return C.predict(_scores(spark, sf), "doc_id", "y").join(truth, "doc_id").select("doc_id", "truth", "predicted")


@query("naive_bayes_predict", f"WITH {_NB} SELECT * FROM pd")
def _(spark, sf):
    return _predicted(spark, sf)


@query("confusion", f"WITH {_NB} SELECT truth, predicted, count(*) AS n FROM pd GROUP BY 1, 2")
def _(spark, sf):
    return C.confusion(_predicted(spark, sf), "truth", "predicted")


_LM = """lb AS (SELECT l AS label, count(*) FILTER (WHERE truth = l) AS support, count(*) FILTER (WHERE predicted = l) AS said, count(*) FILTER (WHERE truth = l AND predicted = l) AS hit FROM pd, (SELECT DISTINCT truth AS l FROM pd UNION SELECT predicted FROM pd) GROUP BY l),
 lm AS (SELECT label, support, hit, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM lb), lf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM lm)"""


@query("nb_metrics", f"WITH {_NB}, {_LM} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM lf")
def _(spark, sf):
    return r6(C.label_metrics(C.confusion(_predicted(spark, sf), "truth", "predicted"), "truth", "predicted").drop("hit"), "precision", "recall", "f1")


@query("nb_overall", f"WITH {_NB}, {_LM} SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1 FROM lf")
def _(spark, sf):
    return r6(C.overall(C.label_metrics(C.confusion(_predicted(spark, sf), "truth", "predicted"), "truth", "predicted")), "accuracy", "balanced_accuracy", "macro_f1")


@query("auroc", "SELECT round(sum(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM labelled p, labelled n WHERE p.y = 1 AND n.y = 0")
def _(spark, sf):
    return r6(C.auroc(D.labelled(spark, sf), "n_chars", F.col("y") == 1).select("auroc"), "auroc")


@query("auroc_weighted", "SELECT round(sum(p.w * n.w * CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0 END) / sum(p.w * n.w), 6) AS auroc FROM (SELECT *, doc_id % 3 + 1.0 AS w FROM labelled) p, (SELECT *, doc_id % 3 + 1.0 AS w FROM labelled) n WHERE p.y = 1 AND n.y = 0")
def _(spark, sf):
    return r6(C.auroc(D.labelled(spark, sf), "n_chars", F.col("y") == 1, F.col("doc_id") % 3 + F.lit(1.0)).select("auroc"), "auroc")
