"""Selection, ids, checked joins, audits and histograms of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import classify as N
from ..operators import models as M
from ..operators import records as R
from ..operators import resample as B
from ..operators import validate as V
from ..staging import settle
from . import fixtures as D
from .cells_queries import _SIG, r6, signatures
from .registry import query
from .resample_queries import _RND


@query("clean_rows", """SELECT role, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT role, trim(text) AS t FROM conversations WHERE role IN ('user', 'assistant')) WHERE t <> '' GROUP BY role""")
def _(spark, sf):
    rows = D.table(spark, sf, "conversations").select("role", "text", F.concat_ws("-", "conv_id", "turn").alias("id"))
    return R.clean_rows(rows, "role", "text", "id", ("user", "assistant")).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("source_group_id", "SELECT concat_ws('|', coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END, ''), '<owner>'), coalesce(source, '<repo>'), coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'f' || doc_id % 7 END, CAST(doc_id AS VARCHAR))) AS group_id, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    d = F.col("doc_id")
    gid = R.group_id(F.when(d % 5 == 0, "").otherwise(F.col("lang")), F.col("source"), F.when(d % 3 != 0, F.concat(F.lit("f"), d % 7)), d.cast("string"))
    return D.table(spark, sf, "documents").groupBy(gid.alias("group_id")).agg(F.count("*").alias("n"))


@query("prompt_selection", "SELECT item_id FROM benchmark WHERE item_id NOT IN (3, 5) ORDER BY sha256(CAST(item_id AS VARCHAR)) LIMIT 12")
def _(spark, sf):
    prompts = D.table(spark, sf, "benchmark").select("item_id", F.sha2(F.col("item_id").cast("string"), 256).alias("h"))
    return R.select_prompts(prompts, "item_id", "h", exclude=[3, 5], limit=12).select("item_id")


@query("response_fallback_join", """SELECT matched_by, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'prompt_id' WHEN c_custkey % 3 = 1 THEN 'row_id' END AS matched_by FROM customer) GROUP BY 1""")
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    people = D.table(spark, sf, "customer")
    prompts = people.select(F.concat(F.lit("p"), k).alias("prompt_id"), F.concat(F.lit("r"), k).alias("row_id"))
    said = people.where("c_custkey % 3 < 2").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "p").otherwise("r"), k).alias("ref"), F.col("c_name").alias("text"))
    return R.join_with_fallback(said, prompts, "prompt_id", "row_id").groupBy("matched_by").agg(F.count("*").alias("n"))


@query("request_hash_check", """SELECT fault, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'unknown' WHEN c_custkey % 7 = 0 THEN 'body' END AS fault FROM customer) WHERE fault IS NOT NULL GROUP BY fault""")
def _(spark, sf):
    people = D.table(spark, sf, "customer").select("c_custkey", F.sha2("c_name", 256).alias("body"), F.sha2("c_mktsegment", 256).alias("prompt"))
    answers = people.withColumn("body", F.when(F.col("c_custkey") % 7 == 0, "other").otherwise(F.col("body")))
    return R.hash_mismatches(people.where("c_custkey % 10 <> 0"), answers, "c_custkey", ["body", "prompt"]).groupBy("fault").agg(F.count("*").alias("n"))


_F4 = ("execution", "assembly", "signature", "ordered")


@query("failed_combinations", """SELECT failed, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT coalesce(nullif(concat_ws(' + ', CASE WHEN NOT execution THEN 'execution' END, CASE WHEN NOT assembly THEN 'assembly' END, CASE WHEN NOT signature THEN 'signature' END, CASE WHEN NOT ordered THEN 'ordered' END), ''), 'none') AS failed, count(*) AS n FROM cells GROUP BY 1)""")
def _(spark, sf):
    return r6(R.combinations(D.cells(spark, sf), list(_F4)), "share")


@query("missing_symbols", "SELECT nullif(regexp_extract(m, 'name ''([^'']+)'' is not defined', 1), '') AS symbol, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'NameError: name ''q' || user_id % 5 || ''' is not defined' ELSE event_type END AS m FROM events) GROUP BY 1")
def _(spark, sf):
    said = F.when(F.col("event_type") == "error", F.concat(F.lit("NameError: name 'q"), F.col("user_id") % 5, F.lit("' is not defined"))).otherwise(F.col("event_type"))
    return D.table(spark, sf, "events").groupBy(R.missing_name(said).alias("symbol")).agg(F.count("*").alias("n"))


@query("run_completeness_audit", """WITH lg AS (SELECT event_id % 5 AS model, user_id, count(*) AS rows, min(CAST(event_type = 'error' AS INT)) AS failed FROM events GROUP BY 1, 2), t AS (SELECT count(DISTINCT user_id) AS total FROM events),
 a AS (SELECT model, count(*) AS answered, count(*) FILTER (WHERE rows > 1) AS repeated, count(*) FILTER (WHERE failed = 1) AS errors_only FROM lg GROUP BY 1)
 SELECT *, total - answered AS missing, CASE WHEN total = answered AND errors_only = 0 THEN 'complete' WHEN total = answered THEN 'complete_with_errors' ELSE 'incomplete' END AS status FROM a, t""")
def _(spark, sf):
    events = D.table(spark, sf, "events")
    log = events.select((F.col("event_id") % 5).alias("model"), "user_id", (F.col("event_type") == "error").alias("failed_"))
    return R.run_audit(events.select("user_id"), log, "user_id", "failed_")


@query("circuit_choice", "SELECT p_brand, min(name) AS name, round(any_value(score), 6) AS score FROM (SELECT p_brand, p_name || '#' || p_partkey AS name, 100.0 * abs(p_size - 20) + 50.0 * abs(p_partkey % 11 - 5) AS score, min(100.0 * abs(p_size - 20) + 50.0 * abs(p_partkey % 11 - 5)) OVER (PARTITION BY p_brand) AS best FROM part) WHERE score = best GROUP BY p_brand")
def _(spark, sf):
    parts = D.table(spark, sf, "part").select("p_brand", F.concat_ws("#", "p_name", "p_partkey").alias("n"), (F.col("p_size") - 20).alias("dq"), (F.col("p_partkey") % 11 - 5).alias("dc"))
    return r6(R.choose(parts, "p_brand", "n", {"dq": 100.0, "dc": 50.0}), "score")


@query("template_rollup", "SELECT l_shipmode_ AS template, count(*) AS cases, round(sum(q), 4) AS total, string_agg(DISTINCT f, ',' ORDER BY f) AS labels FROM (SELECT l_linenumber % 4 AS l_shipmode_, l_quantity AS q, l_returnflag || l_linestatus AS f FROM lineitem) GROUP BY 1")
def _(spark, sf):
    out = R.templates(D.table(spark, sf, "lineitem"), F.col("l_linenumber") % 4, F.concat("l_returnflag", "l_linestatus"), F.col("l_quantity"))
    return out.withColumn("total", F.round("total", 4))


@query("harness_summary", """SELECT model, count(*) AS n, count(*) FILTER (WHERE execution) AS executed, count(*) FILTER (WHERE signature) AS matched, round(count(*) FILTER (WHERE signature) / count(*), 6) AS match_rate, round(count(*) FILTER (WHERE signature) / nullif(count(*) FILTER (WHERE execution), 0), 6) AS match_given_execution,
 count(*) FILTER (WHERE NOT execution) AS with_error, count(DISTINCT CASE WHEN NOT execution THEN prompt_id % 4 END) AS kinds_of_error FROM cells GROUP BY model""")
def _(spark, sf):
    error = F.when(~F.col("execution"), F.col("prompt_id") % 4)
    return r6(R.harness_summary(D.cells(spark, sf), error, "model"), "match_rate", "match_given_execution")


@query("prompt_cohorts", "SELECT CASE WHEN CAST(string_split(id, '_')[-1] AS BIGINT) <= 70 THEN 'pilot' ELSE 'extension' END AS cohort, count(*) AS n, max(id) AS last FROM (SELECT 'prompt_gen_' || lpad(CAST(prompt_id AS VARCHAR), 4, '0') AS id FROM features) GROUP BY 1")
def _(spark, sf):
    ids = D.features(spark, sf).select(F.format_string("prompt_gen_%04d", "prompt_id").alias("id"))
    number = F.element_at(F.split("id", "_"), -1).cast("long")
    return ids.groupBy(F.when(number <= 70, "pilot").otherwise("extension").alias("cohort")).agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("iso_times", "SELECT strftime(ts, '%Y-%m-%dT%H:00:00Z') AS hour, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return D.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH:00:00'Z'").alias("hour")).agg(F.count("*").alias("n"))


@query("signature_bootstrap_rate", f"""WITH s AS ({_SIG}), r AS (SELECT sig, avg(CAST(signature AS INT)) AS x FROM cells JOIN s USING (prompt_id) GROUP BY 1), un AS (SELECT *, row_number() OVER (ORDER BY sig) - 1 AS pos, count(*) OVER () AS size FROM r),
 wt AS (SELECT rep, {_RND.format("'c' || rep || ':' || i")} % size AS pos, count(*) AS w FROM (SELECT unnest(range(1, 201)) AS rep) CROSS JOIN (SELECT pos AS i, size FROM un) GROUP BY 1, 2), es AS (SELECT rep, sum(w * x) / sum(w) AS e FROM wt JOIN un USING (pos) GROUP BY rep)
 SELECT count(*) AS reps, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.025::DOUBLE), 6) AS low, round(quantile_cont(e, 0.975::DOUBLE), 6) AS high FROM es""")
def _(spark, sf):
    sums = D.cells(spark, sf).join(F.broadcast(signatures(spark, sf)), "prompt_id").groupBy(F.col("sig").alias("cluster")).agg(F.avg(F.col("signature").cast("int")).alias("x")).withColumn("n", F.lit(1))
    return r6(B.interval(B.cluster_bootstrap(sums, 200, "c")), "mean", "low", "high")


@query("matrix_with_baselines", "SELECT prompt_id, " + ", ".join(f"max(CASE WHEN model = {m} THEN CAST(signature AS INT) END) AS m{m}" for m in range(21)) + ", CAST(prompt_id % 2 AS INT) AS copy_baseline FROM cells GROUP BY prompt_id")
def _(spark, sf):
    own = D.cells(spark, sf).select("prompt_id", F.concat(F.lit("m"), "model").alias("column"), F.col("signature").cast("int").alias("v"))
    copied = own.select("prompt_id").distinct().select("prompt_id", F.lit("copy_baseline").alias("column"), (F.col("prompt_id") % 2).cast("int").alias("v"))
    return own.unionByName(copied).groupBy("prompt_id").pivot("column", [*[f"m{m}" for m in range(21)], "copy_baseline"]).agg(F.max("v"))


@query("dense_matrix", """WITH w AS (SELECT prompt_id FROM cells GROUP BY 1 HAVING count(*) = 21) SELECT prompt_id, string_agg(CAST(signature AS INT), '' ORDER BY model) AS row FROM cells JOIN w USING (prompt_id) GROUP BY 1""")
def _(spark, sf):
    cells = settle(D.cells(spark, sf), "cells")
    whole = cells.groupBy("prompt_id").agg(F.count("*").alias("n")).where("n = 21").select("prompt_id")
    models = spark.range(21).withColumnRenamed("id", "model")
    return V.dense(cells, models, whole, "signature").select("prompt_id", F.array_join("row", "").alias("row"))


@query("unpenalised_logit")
def _(spark, sf):
    from .models_queries import _grouped

    df = M.standardised(_grouped(spark, sf), ["entropy"])
    return M.logit(df, F.col("s"), F.col("n"), {"entropy": F.col("z_entropy"), "barrier": F.col("barrier")}, ridge=0.0).frame(spark)


@query("dashboard_reconciliation", """WITH a AS (SELECT model, count(*) FILTER (WHERE signature) AS matched FROM cells GROUP BY 1), b AS (SELECT model, count(*) FILTER (WHERE ordered) AS ordered FROM cells GROUP BY 1), c AS (SELECT model, round(avg(CAST(signature AS INT)), 6) AS repeat_rate FROM runs GROUP BY 1)
 SELECT model, matched, ordered, repeat_rate, ordered <= matched AS nested FROM a JOIN b USING (model) JOIN c USING (model)""")
def _(spark, sf):
    cells = C.summarize(D.cells(spark, sf), "model")
    repeat = D.runs(spark, sf).groupBy("model").agg(F.round(F.avg(F.col("signature").cast("int")), 6).alias("repeat_rate"))
    return cells.select("model", F.col("signature").alias("matched"), "ordered").join(repeat, "model").withColumn("nested", F.col("ordered") <= F.col("matched"))


@query("stress_predictions", """WITH tk AS (SELECT doc_id, y, ['lang=' || lang, 'source=' || source] AS t FROM labelled), pr AS (SELECT y, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM tk GROUP BY y), ct AS (SELECT y, term, count(*) AS c FROM (SELECT y, unnest(t) AS term FROM tk) GROUP BY 1, 2), sm AS (SELECT y, sum(c) AS n, (SELECT count(DISTINCT term) FROM ct) AS v FROM ct GROUP BY y),
 sc AS (SELECT e.doc_id, pr.y, round(any_value(prior) + sum(ln((coalesce(c, 0) + 1) / (n + v))), 9) AS s FROM (SELECT doc_id, unnest(t) AS term FROM tk) e CROSS JOIN pr JOIN sm ON sm.y = pr.y LEFT JOIN ct ON ct.y = pr.y AND ct.term = e.term GROUP BY 1, 2)
 SELECT doc_id, round(max(s) FILTER (WHERE y = 1) - max(s) FILTER (WHERE y = 0), 6) AS margin FROM sc GROUP BY doc_id""")
def _(spark, sf):
    rows = D.labelled(spark, sf).select("doc_id", "y", F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source")).alias("t"))
    scores = N.score_nb(rows, "doc_id", "y", F.col("t"), N.fit_nb(rows, "y", F.col("t")))
    at = lambda k: F.max(F.when(F.col("y") == k, F.col("score")))
    return scores.groupBy("doc_id").agg(F.round(at(1) - at(0), 6).alias("margin"))
