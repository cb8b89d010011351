"""Repeatability, paired tests and rank stability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import agreement as A
from ..operators import order_stats as O
from . import fixtures as D
from .cells_queries import r6
from .registry import query


def _items(spark, sf):
    return A.triples(D.runs(spark, sf), "signature")


_AG = """count(*) AS items, avg(CAST(a = b AND b = c AS INT)) AS unanimous, avg(CAST(NOT (a = b AND b = c) AS INT)) AS any_flip,
 avg((CAST(a = b AS INT) + CAST(a = c AS INT) + CAST(b = c AS INT)) / 3.0::DOUBLE) AS pairwise, avg((a + b + c) / 3.0::DOUBLE) AS positive"""
_AC1 = "round(unanimous, 6) AS unanimous, round(any_flip, 6) AS any_flip, round(pairwise, 6) AS pairwise, round(positive, 6) AS positive, round((pairwise - 2 * positive * (1 - positive)) / (1 - 2 * positive * (1 - positive)), 6) AS ac1"


@query("agreement_ac1", f"SELECT items, {_AC1} FROM (SELECT {_AG} FROM triples)")
def _(spark, sf):
    return r6(A.agreement(_items(spark, sf)), "unanimous", "any_flip", "pairwise", "positive", "ac1")


@query("agreement_by_model", f"SELECT model, items, {_AC1} FROM (SELECT model, {_AG} FROM triples GROUP BY model)")
def _(spark, sf):
    return r6(A.agreement(_items(spark, sf), "model"), "unanimous", "any_flip", "pairwise", "positive", "ac1")


@query("stratum_agreement", f"SELECT gate_bin, items, {_AC1} FROM (SELECT CASE WHEN types <= 2 THEN '1-2' WHEN types <= 4 THEN '3-4' ELSE '5+' END AS gate_bin, {_AG} FROM triples JOIN features USING (prompt_id) GROUP BY 1)")
def _(spark, sf):
    bins = D.features(spark, sf).select("prompt_id", X.bins(F.col("types"), *X.TYPE_BINS).alias("gate_bin"))
    return r6(A.agreement(_items(spark, sf).join(F.broadcast(bins), "prompt_id"), "gate_bin"), "unanimous", "any_flip", "pairwise", "positive", "ac1")


@query("cochran_q", """SELECT items, round(q, 6) AS q, round(exp(-q / 2), 6) AS p FROM (SELECT count(*) AS items, coalesce(2 * (3 * (sum(a) * sum(a) + sum(b) * sum(b) + sum(c) * sum(c)) - sum(a + b + c) * sum(a + b + c)) / nullif(CAST(3 * sum(a + b + c) - sum((a + b + c) * (a + b + c)) AS DOUBLE), 0), 0) AS q FROM triples)""")
def _(spark, sf):
    return r6(A.cochran_q(_items(spark, sf)), "q", "p")


_MC = """pairs AS (SELECT model, unnest(['1-2', '1-3', '2-3']) AS pair, unnest([a, a, b]) AS x, unnest([b, c, c]) AS y FROM triples), d AS (SELECT model, pair, CAST(sum(CAST(x > y AS INT)) AS BIGINT) AS only_x, CAST(sum(CAST(x < y AS INT)) AS BIGINT) AS only_y FROM pairs GROUP BY 1, 2),
 t AS (SELECT *, CASE WHEN only_x + only_y = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(only_x, only_y) + 1), lambda i: exp(lgamma(only_x + only_y + 1) - lgamma(i + 1) - lgamma(only_x + only_y - i + 1) - (only_x + only_y) * ln(2))))) END AS p FROM d),
 o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, pair) AS r, count(*) OVER (PARTITION BY model) AS m FROM t)"""


@query("mcnemar_holm", f"WITH {_MC} SELECT model, pair, only_x, only_y, round(p, 6) AS p, round(max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY model ORDER BY r ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM o")
def _(spark, sf):
    tests = A.mcnemar(A.run_pairs(_items(spark, sf)), "x", "y", "model", "pair")
    return r6(A.holm(tests, "p", "model", tie=["pair"]), "p", "p_holm")


@query("stability_patterns", "SELECT p AS pattern, (SELECT count(*) FROM triples WHERE a || '' || b || '' || c = p) AS n FROM (SELECT unnest(['000', '001', '010', '011', '100', '101', '110', '111']) AS p)")
def _(spark, sf):
    return A.patterns(_items(spark, sf))


@query("majority_vote", """SELECT model, count(*) AS items, round(avg(CAST(a + b + c >= 2 AS INT)), 6) AS majority, round(avg(a), 6) AS run1, round(avg(CAST(a + b + c >= 2 AS INT)) - avg(a), 6) AS change FROM triples GROUP BY model""")
def _(spark, sf):
    return r6(A.majority(_items(spark, sf), "model"), "majority", "run1", "change")


@query("run_summaries", """SELECT run, count(*) AS n, count(*) FILTER (WHERE execution) AS executed, count(*) FILTER (WHERE signature) AS matched, count(*) FILTER (WHERE execution AND NOT signature) AS runnable_wrong, round(avg(CAST(signature AS INT)), 6) AS rate FROM runs GROUP BY run""")
def _(spark, sf):
    e, m = F.col("execution"), F.col("signature")
    return r6(D.runs(spark, sf).groupBy("run").agg(F.count("*").alias("n"), X.ones(e).alias("executed"), X.ones(m).alias("matched"), X.ones(e & ~m).alias("runnable_wrong"), F.avg(m.cast("int")).alias("rate")), "rate")


@query("model_run_rates", "SELECT model, round(avg(a), 6) AS run1, round(avg(b), 6) AS run2, round(avg(c), 6) AS run3, round(100 * (greatest(avg(a), avg(b), avg(c)) - least(avg(a), avg(b), avg(c))), 6) AS range_pp FROM triples GROUP BY model")
def _(spark, sf):
    out = _items(spark, sf).groupBy("model").agg(F.avg("a").alias("run1"), F.avg("b").alias("run2"), F.avg("c").alias("run3"))
    return r6(out.withColumn("range_pp", 100 * (F.greatest("run1", "run2", "run3") - F.least("run1", "run2", "run3"))), "run1", "run2", "run3", "range_pp")


_RR = "mr AS (SELECT model, avg(b) AS x, avg(c) AS y FROM triples GROUP BY model), rk AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM mr)"


def _model_runs(spark, sf):
    return _items(spark, sf).groupBy("model").agg(F.avg("b").alias("x"), F.avg("c").alias("y"))


@query("rank_stability", f"""WITH {_RR}, t AS (SELECT model, rank() OVER (ORDER BY x DESC) <= 5 AS tx, rank() OVER (ORDER BY y DESC) <= 5 AS ty FROM mr)
 SELECT (SELECT round(corr(rx, ry), 6) FROM rk) AS spearman, (SELECT round(count(*) FILTER (WHERE tx AND ty) / count(*) FILTER (WHERE tx OR ty), 6) FROM t) AS jaccard""")
def _(spark, sf):
    m = _model_runs(spark, sf)
    return r6(A.spearman(m, "x", "y").select("spearman").crossJoin(A.top_jaccard(m, "x", "y", "model")), "spearman", "jaccard")


#: Models that stand for the frontier in this panel.
FRONTIER = (0, 3, 7, 11)
_MR3 = "m3 AS (SELECT model, avg(a) AS r1, avg(b) AS r2, avg(c) AS r3 FROM triples GROUP BY model)"


def _pair(i: int, j: int) -> str:
    t = f"(SELECT model, r{i} AS x, r{j} AS y, rank() OVER (ORDER BY r{i}) + (count(*) OVER (PARTITION BY r{i}) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY r{j}) + (count(*) OVER (PARTITION BY r{j}) - 1) / 2.0::DOUBLE AS ry, rank() OVER (ORDER BY r{i} DESC) <= 5 AS tx, rank() OVER (ORDER BY r{j} DESC) <= 5 AS ty FROM m3)"
    means = ", ".join(f"round(avg({c}) FILTER (WHERE model {o}IN {FRONTIER}), 6) AS {n}_{w}" for n, o in (("frontier", ""), ("others", "NOT ")) for c, w in (("x", "first"), ("y", "second")))
    tau = f"(SELECT round(sum(sign(p.r{i} - q.r{i}) * sign(p.r{j} - q.r{j})) / sqrt(sum(abs(sign(p.r{i} - q.r{i}))) * sum(abs(sign(p.r{j} - q.r{j})))), 6) FROM m3 p JOIN m3 q ON p.model < q.model)"
    return f"SELECT '{i}-{j}' AS runs, round(corr(rx, ry), 6) AS spearman, {tau} AS tau_b, round(count(*) FILTER (WHERE tx AND ty) / count(*) FILTER (WHERE tx OR ty), 6) AS jaccard, {means} FROM {t}"


@query("rank_stability_pairs", f"WITH {_MR3} " + " UNION ALL ".join(_pair(i, j) for i, j in ((1, 2), (1, 3), (2, 3))))
def _(spark, sf):
    rates = _items(spark, sf).groupBy("model").agg(F.avg("a").alias("r1"), F.avg("b").alias("r2"), F.avg("c").alias("r3"))
    out = None
    for i, j in ((1, 2), (1, 3), (2, 3)):
        row = A.stability(rates, "model", f"r{i}", f"r{j}", F.col("model").isin(*FRONTIER)).select(F.lit(f"{i}-{j}").alias("runs"), "*")
        out = row if out is None else out.unionByName(row)
    return r6(out, *out.columns[1:])


_V = "CAST(sum(CAST({e} AS INT)) >= 2 AS INT)"


@query("majority_summary", f"""WITH i AS (SELECT model, prompt_id, {_V.format(e='execution')} AS e, {_V.format(e='signature')} AS m, {_V.format(e='(execution AND NOT signature)')} AS w, max(CASE WHEN run = 1 THEN CAST(execution AS INT) END) AS e1, max(CASE WHEN run = 1 THEN CAST(signature AS INT) END) AS m1 FROM runs GROUP BY 1, 2),
 g AS (SELECT model, sum(m) AS x, sum(m1) AS y FROM i GROUP BY 1), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM g)
 SELECT count(*) AS n, CAST(sum(e) AS BIGINT) AS execution, CAST(sum(m) AS BIGINT) AS signature, CAST(sum(e) - sum(m) AS BIGINT) AS es_gap, CAST(sum(w) AS BIGINT) AS runwise_wrong, round(100 * (avg(m) - avg(m1)), 6) AS signature_change_pp, round(100 * (avg(e) - avg(e1)), 6) AS execution_change_pp, (SELECT round(corr(rx, ry), 6) FROM k) AS rank_correlation FROM i""")
def _(spark, sf):
    runs = D.runs(spark, sf)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("run", F.col(c).cast("int").alias("v")))), lambda r: r["v"]).alias(c)
    items = runs.groupBy("model", "prompt_id").agg(in_order("execution"), in_order("signature"))
    return r6(A.majority_summary(items, "model"), "signature_change_pp", "execution_change_pp", "rank_correlation")


@query("kendall_tau_b", "WITH mr AS (SELECT model, avg(b) AS x, avg(c) AS y FROM triples GROUP BY model) SELECT round(sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))), 6) AS tau_b FROM mr p JOIN mr q ON p.model < q.model")
def _(spark, sf):
    return r6(A.kendall_tau_b(_model_runs(spark, sf), "model", "x", "y"), "tau_b")


@query("tau_b_of_customers", """WITH c AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_acctbal AS DOUBLE) AS y FROM customer) SELECT CAST((SELECT count(*) FROM c) AS BIGINT) AS n, round(sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))), 6) AS tau_b FROM c p JOIN c q ON p.c_custkey < q.c_custkey""")
def _(spark, sf):
    return r6(O.tau_b(D.table(spark, sf, "customer"), "c_nationkey", "c_acctbal"), "tau_b")


@query("pearson_spearman", "WITH s AS (SELECT prompt_id, types, any_value(gates) AS gates, avg(CAST(signature AS INT)) AS rate FROM cells JOIN features USING (prompt_id) GROUP BY 1, 2), rk AS (SELECT *, rank() OVER (ORDER BY gates) + (count(*) OVER (PARTITION BY gates) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0::DOUBLE AS ry FROM s) SELECT count(*) AS n, round(corr(gates, rate), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM rk")
def _(spark, sf):
    rates = D.cells(spark, sf).groupBy("prompt_id").agg(F.avg(F.col("signature").cast("int")).alias("rate")).join(D.features(spark, sf), "prompt_id")
    return r6(A.spearman(rates.select(F.col("gates").cast("double").alias("gates"), "rate"), "gates", "rate"), "pearson", "spearman")


@query("exact_text_agreement", """WITH h AS (SELECT source, doc_id % 40 AS item, min(CASE WHEN doc_id % 3 = 0 THEN md5(text) END) AS a, min(CASE WHEN doc_id % 3 = 1 THEN md5(text) END) AS b FROM documents GROUP BY 1, 2) SELECT count(*) AS pairs, count(*) FILTER (WHERE a = b) AS same FROM h WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(spark, sf):
    at = lambda k: F.min(F.when(F.col("doc_id") % 3 == k, F.md5("text")))
    h = D.table(spark, sf, "documents").groupBy("source", (F.col("doc_id") % 40).alias("item")).agg(at(0).alias("a"), at(1).alias("b")).where("a is not null and b is not null")
    return h.agg(F.count("*").alias("pairs"), X.ones(F.col("a") == F.col("b")).alias("same"))


# A document is a run of its item (three ids in a row); every seventh text is empty.
_DIGESTS = "h AS (SELECT source AS model, doc_id // 3 AS prompt_id, doc_id % 3 + 1 AS run, CASE WHEN doc_id % 7 = 0 OR coalesce(text, '') = '' THEN '' ELSE sha256(text) END AS text, CASE WHEN coalesce(lang, '') = '' THEN '' ELSE sha256(lang) END AS lang FROM documents)"


def _digest_pairs(d):
    i = f"(SELECT model, prompt_id, nullif(max(CASE WHEN run = 1 THEN {d} END), '') AS a, nullif(max(CASE WHEN run = 2 THEN {d} END), '') AS b, nullif(max(CASE WHEN run = 3 THEN {d} END), '') AS c FROM h GROUP BY 1, 2)"
    one = lambda n, x, y: f"SELECT '{n}' AS pair, count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS items, count(*) FILTER (WHERE {x} = {y}) AS same FROM {i}"
    three = "a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"
    alike = f"SELECT 'all' AS pair, count(*) FILTER (WHERE {three}) AS items, count(*) FILTER (WHERE a = b AND a = c) AS same FROM {i} UNION ALL SELECT 'pairs', 3 * count(*) FILTER (WHERE {three}), count(*) FILTER (WHERE {three} AND a = b) + count(*) FILTER (WHERE {three} AND a = c) + count(*) FILTER (WHERE {three} AND b = c) FROM {i}"
    return f"SELECT '{d}' AS form, pair, items, same, round(same / nullif(items, 0), 6) AS rate FROM ({one('1-2', 'a', 'b')} UNION ALL {one('1-3', 'a', 'c')} UNION ALL {one('2-3', 'b', 'c')} UNION ALL {alike})"


@query("digest_agreement", f"WITH {_DIGESTS} {_digest_pairs('text')} UNION ALL {_digest_pairs('lang')}")
def _(spark, sf):
    d = F.col("doc_id")
    docs = D.table(spark, sf, "documents").select(F.col("source").alias("model"), F.floor(d / 3).alias("prompt_id"), (d % 3 + 1).alias("run"), X.text_digest(F.when(d % 7 != 0, F.col("text"))).alias("text"), X.text_digest(F.col("lang")).alias("lang"))
    both = [A.digest_agreement(docs, form).select(F.lit(form).alias("form"), "*") for form in ("text", "lang")]
    return r6(both[0].unionByName(both[1]), "rate")


@query("transport_complete_items", "WITH bad AS (SELECT DISTINCT model, prompt_id FROM runs WHERE (model * 7 + prompt_id * 3 + run) % 11 = 0) SELECT run, count(*) AS n FROM runs r WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.model = r.model AND b.prompt_id = r.prompt_id) GROUP BY run")
def _(spark, sf):
    hit = ((F.col("model") * 7 + F.col("prompt_id") * 3 + F.col("run")) % 11 == 0).cast("int")
    own = D.runs(spark, sf).withColumn("hit", F.max(hit).over(Window.partitionBy("model", "prompt_id")))
    return own.where("hit = 0").groupBy("run").agg(F.count("*").alias("n"))
