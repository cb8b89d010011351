"""Cell metrics, comparisons, failures, strata, items, models and families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cells as C
from ..operators import validate as V
from . import fixtures as D
from .registry import query


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_SUMS = """count(*) AS cells, count(DISTINCT model) AS models, count(DISTINCT prompt_id) AS prompts,
 count(*) FILTER (WHERE execution) AS execution, count(*) FILTER (WHERE assembly) AS assembly, count(*) FILTER (WHERE signature) AS signature,
 count(*) FILTER (WHERE ordered) AS ordered, count(*) FILTER (WHERE parameter) AS parameter,
 count(*) FILTER (WHERE assembly AND NOT signature) AS assembly_without_signature, count(*) FILTER (WHERE signature AND NOT assembly) AS signature_without_assembly"""
_RATES = """*, execution - signature AS es_gap, execution - assembly AS attrition, assembly - signature AS as_gap,
 round(execution / cells, 6) AS execution_rate, round(assembly / cells, 6) AS assembly_rate, round(signature / cells, 6) AS signature_rate, round(ordered / cells, 6) AS ordered_rate,
 round(parameter / cells, 6) AS parameter_rate, round((execution - signature) / cells, 6) AS es_gap_rate, round((assembly - signature) / cells, 6) AS as_gap_rate,
 round((execution - signature) / nullif(execution, 0), 6) AS disagreement_rate, round((assembly - signature) / nullif(execution - signature, 0), 6) AS as_gap_share"""
_RATE_NAMES = ["execution_rate", "assembly_rate", "signature_rate", "ordered_rate", "parameter_rate", "es_gap_rate", "as_gap_rate", "disagreement_rate", "as_gap_share"]


@query("cell_summary", f"SELECT {_RATES} FROM (SELECT {_SUMS} FROM cells)")
def _(spark, sf):
    return r6(C.summarize(D.cells(spark, sf)), *_RATE_NAMES)


@query("cell_summary_by_model", f"SELECT {_RATES} FROM (SELECT model, {_SUMS} FROM cells GROUP BY model)")
def _(spark, sf):
    return r6(C.summarize(D.cells(spark, sf), "model"), *_RATE_NAMES)


_TIDY_OF = {"disagreement": "es_gap", "as_gap_of_es_gap": "as_gap"}
_TIDY = " UNION ALL ".join(f"SELECT '{s}' AS section, '{m}' AS metric, CAST({_TIDY_OF.get(m, m)} AS BIGINT) AS count, CAST({d} AS BIGINT) AS denominator FROM s" for m, (s, d) in C.PRIMARY.items())


@query("cell_tidy_metrics", f"WITH s AS (SELECT {_RATES} FROM (SELECT {_SUMS} FROM cells)) SELECT section, metric, true AS available, count, denominator, round(count / nullif(denominator, 0), 6) AS rate FROM ({_TIDY})")
def _(spark, sf):
    return r6(C.tidy(C.summarize(D.cells(spark, sf)), C.PRIMARY), "rate")


@query("cell_invariant_violations", """SELECT rule, count(*) AS n FROM (
 SELECT unnest([CASE WHEN assembly AND NOT execution THEN 'assembly without execution' END, CASE WHEN signature AND NOT execution THEN 'signature without execution' END,
 CASE WHEN ordered AND NOT signature THEN 'ordered without signature' END, CASE WHEN parameter AND NOT ordered THEN 'parameter without ordered' END]) AS rule
 FROM (SELECT model, prompt_id, (model + prompt_id) % 5 <> 0 AND execution AS execution, assembly, signature, ordered, parameter FROM cells)) WHERE rule IS NOT NULL GROUP BY rule""")
def _(spark, sf):
    spoiled = D.cells(spark, sf).withColumn("execution", ((F.col("model") + F.col("prompt_id")) % 5 != 0) & F.col("execution"))
    return V.implication_violations(spoiled).groupBy("rule").agg(F.count("*").alias("n"))


@query("cell_alias_resolution", """SELECT model, count(*) FILTER (WHERE coalesce(CASE WHEN prompt_id % 2 = 0 THEN execution END, execution)) AS execution,
 count(*) FILTER (WHERE prompt_id % 7 = 0 AND model = 3) AS conflicts FROM cells GROUP BY model""")
def _(spark, sf):
    raw = D.cells(spark, sf).select(
        "model", "prompt_id", F.when(F.col("prompt_id") % 2 == 0, F.col("execution").cast("string")).alias("report_executable"),
        F.when((F.col("prompt_id") % 7 == 0) & (F.col("model") == 3), "maybe").otherwise(F.col("execution").cast("int").cast("string")).alias("execution_success"),
        F.col("execution").alias("truth"),
    )
    bad = V.conflicts(raw).groupBy("model").agg(F.count("*").alias("conflicts"))
    fine = V.resolve(raw.withColumn("execution_success", F.col("truth").cast("int").cast("string"))).groupBy("model").agg(X.ones(F.col("execution")).alias("execution"))
    return fine.join(bad, "model", "left").select("model", "execution", F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))


@query("grid_completeness", """SELECT m AS model, p AS prompt_id FROM (SELECT unnest(range(21)) AS m), (SELECT unnest(range(154)) AS p)
 WHERE NOT EXISTS (SELECT 1 FROM cells WHERE model = m AND prompt_id = p AND q_ok) """.replace(" AND q_ok", " AND execution"))
def _(spark, sf):
    return V.missing_cells(D.cells(spark, sf).where("execution"), spark.range(21).toDF("model"), spark.range(154).toDF("prompt_id"))


@query("identifiable_sensitivity", """SELECT model, round(avg(CAST(signature AS INT)), 6) AS full_rate, round(avg(CAST(signature AS INT)) FILTER (WHERE prompt_id NOT IN (3, 50, 77, 120)), 6) AS kept_rate,
 round(100 * (avg(CAST(signature AS INT)) FILTER (WHERE prompt_id NOT IN (3, 50, 77, 120)) - avg(CAST(signature AS INT))), 6) AS delta_pp FROM cells GROUP BY model""")
def _(spark, sf):
    kept = ~F.col("prompt_id").isin(3, 50, 77, 120)
    x = F.col("signature").cast("int")
    out = D.cells(spark, sf).groupBy("model").agg(F.avg(x).alias("full_rate"), F.avg(F.when(kept, x)).alias("kept_rate"))
    return r6(out.withColumn("delta_pp", 100 * (F.col("kept_rate") - F.col("full_rate"))), "full_rate", "kept_rate", "delta_pp")


_R5 = ("execution", "assembly", "signature", "ordered", "parameter")
_CMP = " UNION ALL ".join(f"SELECT '{m}_rate' AS metric, (SELECT avg(CAST({m} AS INT)) FROM cand) AS candidate, (SELECT avg(CAST({m} AS INT)) FROM froz) AS frozen" for m in _R5)


@query("candidate_vs_frozen", f"""WITH cand AS (SELECT * FROM cells WHERE model = 20 AND prompt_id < 100), froz AS (SELECT * FROM cells WHERE model < 20 AND prompt_id IN (SELECT prompt_id FROM cand))
 SELECT metric, round(candidate, 6) AS candidate, round(frozen, 6) AS frozen, round(candidate - frozen, 6) AS delta FROM ({_CMP})""")
def _(spark, sf):
    cells = D.cells(spark, sf)
    return r6(C.compare(cells.where("model = 20 and prompt_id < 100"), cells.where("model < 20")), "candidate", "frozen", "delta")


@query("assembly_layer_audit", """SELECT model, count(*) FILTER (WHERE execution) AS e, count(*) FILTER (WHERE assembly) AS a, count(*) FILTER (WHERE signature) AS m,
 count(*) FILTER (WHERE execution AND NOT assembly) AS e_without_a, count(*) FILTER (WHERE assembly AND NOT signature) AS a_without_m FROM cells GROUP BY model""")
def _(spark, sf):
    return C.summarize(D.cells(spark, sf), "model").select(
        "model", F.col("execution").alias("e"), F.col("assembly").alias("a"), F.col("signature").alias("m"), F.col("attrition").alias("e_without_a"), F.col("assembly_without_signature").alias("a_without_m")
    )


@query("policy_transitions", """SELECT 'signature' AS endpoint, count(*) AS cells, count(*) FILTER (WHERE NOT signature AND execution AND prompt_id % 3 = 0) AS gained, CAST(0 AS BIGINT) AS lost,
 count(*) FILTER (WHERE NOT signature AND execution AND prompt_id % 3 = 0) AS changed FROM cells""")
def _(spark, sf):
    cells = D.cells(spark, sf)
    return C.transitions(cells, cells.withColumn("signature", F.col("signature") | (F.col("execution") & (F.col("prompt_id") % 3 == 0))), "signature")


@query("component_mismatch", " UNION ALL ".join(f"SELECT '{c}' AS component, count(*) FILTER (WHERE NOT {c}) AS all_cells, count(*) FILTER (WHERE NOT {c} AND execution) AS executed FROM cells" for c in _R5[1:]))
def _(spark, sf):
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("ok")) for c in _R5[1:]])).alias("x")
    return D.cells(spark, sf).select("execution", rows).groupBy("x.component").agg(X.ones(~F.col("x.ok")).alias("all_cells"), X.ones(~F.col("x.ok") & F.col("execution")).alias("executed"))


def _strata(spark, sf):
    f = D.features(spark, sf).withColumns({"width_bin": X.bins(F.col("qubits"), *X.WIDTH_BINS), "gate_bin": X.bins(F.col("gates"), *X.COUNT_BINS), "has_barrier": F.map_contains_key("counts", "N")})
    return D.cells(spark, sf).join(F.broadcast(f), "prompt_id")


def _case(column, spec):
    edges, last = spec
    return "CASE " + " ".join(f"WHEN {column} <= {e} THEN '{n}'" for e, n in edges) + f" ELSE '{last}' END"


_WIDTH, _GATES = _case("qubits", X.WIDTH_BINS), _case("gates", X.COUNT_BINS)


@query("strata_rollup", f"""SELECT width_bin, count(*) AS n, count(DISTINCT prompt_id) AS prompts, count(DISTINCT model) AS models, round(avg(CAST(execution AS INT)), 6) AS execution_rate, round(avg(CAST(signature AS INT)), 6) AS signature_rate,
 round(count(*) FILTER (WHERE signature AND execution) / nullif(count(*) FILTER (WHERE execution), 0), 6) AS signature_given_execution, count(*) FILTER (WHERE execution AND NOT signature) AS runnable_wrong,
 round(count(*) FILTER (WHERE execution AND NOT signature) / count(*), 6) AS runnable_wrong_rate, round(count(*) FILTER (WHERE execution AND NOT signature) / nullif(count(*) FILTER (WHERE execution), 0), 6) AS runnable_wrong_given_execution
 FROM (SELECT c.*, {_WIDTH} AS width_bin FROM cells c JOIN features USING (prompt_id)) GROUP BY width_bin""")
def _(spark, sf):
    return r6(C.group_rates(_strata(spark, sf), "width_bin"), "execution_rate", "signature_rate", "signature_given_execution", "runnable_wrong_rate", "runnable_wrong_given_execution")


@query("label_grouping_sets", f"""SELECT coalesce(gate_bin, '(all)') AS label, count(*) AS n, count(*) FILTER (WHERE execution) AS executed, round(avg(CAST(signature AS INT)), 6) AS rate
 FROM (SELECT c.*, {_GATES} AS gate_bin FROM cells c JOIN features USING (prompt_id)) GROUP BY GROUPING SETS ((), (gate_bin))""")
def _(spark, sf):
    out = _strata(spark, sf).groupingSets([[], [F.col("gate_bin")]], "gate_bin").agg(F.count("*").alias("n"), X.ones(F.col("execution")).alias("executed"), F.avg(F.col("signature").cast("int")).alias("rate"))
    return r6(out.select(F.coalesce("gate_bin", F.lit("(all)")).alias("label"), "n", "executed", "rate"), "rate")


_ITEMS = """SELECT prompt_id, count(*) AS models, count(*) FILTER (WHERE signature) AS solved, count(*) FILTER (WHERE signature AND model % 3 = 0) AS frontier_solved,
 count(*) FILTER (WHERE signature AND model % 3 <> 0) AS other_solved FROM cells GROUP BY prompt_id"""


def _items(spark, sf):
    return C.item_difficulty(D.cells(spark, sf), frontier=F.col("model") % 3 == 0)


@query("item_difficulty", f"SELECT *, round(1 - solved / models, 6) AS difficulty FROM ({_ITEMS})")
def _(spark, sf):
    return r6(_items(spark, sf), "difficulty").select("prompt_id", "models", "solved", "frontier_solved", "other_solved", "difficulty")


@query("item_buckets", f"""SELECT count(*) FILTER (WHERE solved = models) AS universal_easy, count(*) FILTER (WHERE solved = 0) AS universal_hard, count(*) FILTER (WHERE frontier_solved > 0 AND other_solved = 0) AS frontier_only,
 count(*) FILTER (WHERE other_solved > 0 AND frontier_solved = 0) AS other_only, count(*) FILTER (WHERE solved > 0 AND solved < models) AS mixed FROM ({_ITEMS})""")
def _(spark, sf):
    return _items(spark, sf).agg(*[X.ones(F.col(c)).alias(c) for c in ("universal_easy", "universal_hard", "frontier_only", "other_only", "mixed")])


@query("tier_feature_interactions", """WITH j AS (SELECT c.*, has_barrier, types >= 3 AS diverse, gates >= 13 AS big, model % 3 AS tier FROM cells c JOIN features USING (prompt_id))
 SELECT feature, value, tier, count(*) AS n, round(avg(CAST(signature AS INT)), 6) AS rate FROM (SELECT 'has_barrier' AS feature, CAST(has_barrier AS VARCHAR) AS value, tier, signature FROM j
 UNION ALL SELECT 'diverse', CAST(diverse AS VARCHAR), tier, signature FROM j UNION ALL SELECT 'big', CAST(big AS VARCHAR), tier, signature FROM j) GROUP BY 1, 2, 3""")
def _(spark, sf):
    flags = _strata(spark, sf).withColumns({"diverse": F.col("types") >= 3, "big": F.col("gates") >= 13, "tier": F.col("model") % 3})
    return r6(C.unpivot_rates(flags, ["has_barrier", "diverse", "big"], "tier"), "rate")


@query("model_rank_zscore", """SELECT model, n, round(exec_rate, 6) AS execution_rate, round(rate, 6) AS rate, row_number() OVER (ORDER BY rate DESC, model) AS rank,
 round((rate - avg(rate) OVER ()) / coalesce(nullif(stddev_samp(rate) OVER (), 0), 1), 6) AS z, rank() OVER (ORDER BY rate DESC) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0::DOUBLE AS average_rank FROM model_rates""")
def _(spark, sf):
    return r6(C.model_distribution(D.cells(spark, sf)), "execution_rate", "rate", "z").drop("signature_given_execution")


# Models' tiers: a dimension of the panel, here the nations of suppliers.
_TIERS = "tiers AS (SELECT DISTINCT l_suppkey % 21 AS model, CASE WHEN l_suppkey % 21 IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 3)) THEN 'frontier' WHEN l_suppkey % 21 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'mid' ELSE 'small' END AS tier FROM lineitem)"


def _tiers(spark, sf):
    region = F.col("n_regionkey")
    tier = F.when(region.isin(0, 3), "frontier").when(region == 1, "mid").otherwise("small")
    return D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("model"), tier.alias("tier"))


@query("tier_distribution", """WITH """ + _TIERS + """ SELECT tier, count(*) AS n, round(avg(rate), 6) AS mean, round(median(rate), 6) AS median, round(min(rate), 6) AS min, round(max(rate), 6) AS max, round(coalesce(stddev_samp(rate), 0), 6) AS sd FROM model_rates JOIN tiers USING (model) GROUP BY 1""")
def _(spark, sf):
    own = C.model_distribution(D.cells(spark, sf)).join(F.broadcast(_tiers(spark, sf)), "model")  # one row a model
    return r6(C.spread(own, "rate", "tier"), "mean", "median", "min", "max", "sd")


@query("tier_delta", "SELECT tier, round(mean, 6) AS mean, round(mean - lag(mean) OVER (ORDER BY tier), 6) AS delta FROM (SELECT model % 3 AS tier, avg(rate) AS mean FROM model_rates GROUP BY 1)")
def _(spark, sf):
    means = C.group_rates(D.cells(spark, sf), "model").groupBy((F.col("model") % 3).alias("tier")).agg(F.avg("signature_rate").alias("mean"))
    return r6(means.withColumn("delta", F.col("mean") - F.lag("mean").over(Window.partitionBy().orderBy("tier"))), "mean", "delta")


_SIG = "SELECT prompt_id, sha256(qubits || '|' || clbits || '|' || gates || '|{' || entries || '}') AS sig FROM features"


def signatures(spark, sf):
    return D.features(spark, sf).select("prompt_id", X.signature(F.col("qubits"), F.col("clbits"), F.col("gates"), F.col("counts")).alias("sig"))


@query("signature_collapse", f"""WITH s AS ({_SIG}), w AS (SELECT model, sig, avg(CAST(signature AS INT)) AS m FROM cells JOIN s USING (prompt_id) GROUP BY 1, 2)
 SELECT model, count(*) AS signatures, round(avg(m), 6) AS collapsed, round(any_value(rate), 6) AS plain FROM w JOIN model_rates USING (model) GROUP BY model""")
def _(spark, sf):
    return r6(C.collapse(D.cells(spark, sf), signatures(spark, sf)), "collapsed", "plain")


@query("duplicate_signatures", f"WITH s AS ({_SIG}) SELECT sig, count(*) AS n, string_agg(prompt_id, ',' ORDER BY prompt_id) AS prompts FROM s GROUP BY sig HAVING count(*) > 1")
def _(spark, sf):
    groups = signatures(spark, sf).groupBy("sig").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("prompt_id")).alias("p")).where("n > 1")
    return groups.select("sig", "n", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("prompts"))


@query("family_macro_rates", """WITH f AS (SELECT prompt_id, unnest(CASE WHEN prompt_id % 10 = 0 THEN ['a' || prompt_id % 4, 'b'] WHEN prompt_id > 151 THEN ['tiny'] ELSE ['c' || prompt_id % 3] END) AS family FROM features),
 s AS (SELECT family, count(DISTINCT prompt_id) AS prompts FROM f GROUP BY 1), p AS (SELECT prompt_id, CASE WHEN prompts < 3 THEN 'rare' ELSE family END AS pool FROM f JOIN s USING (family))
 SELECT pool, count(DISTINCT prompt_id) AS prompts, count(*) AS n, round(avg(CAST(signature AS INT)), 6) AS rate FROM cells JOIN p USING (prompt_id) GROUP BY pool""")
def _(spark, sf):
    p = F.col("prompt_id")
    label = F.when(p % 10 == 0, F.array(F.concat(F.lit("a"), p % 4), F.lit("b"))).when(p > 151, F.array(F.lit("tiny"))).otherwise(F.array(F.concat(F.lit("c"), p % 3)))
    return r6(C.family_macro(D.cells(spark, sf), D.features(spark, sf).select("prompt_id", F.explode(label).alias("family"))), "rate")


@query("leave_one_developer_out", """WITH d AS (SELECT model % 7 AS omitted, count(*) AS n, count(*) FILTER (WHERE signature) AS s FROM cells GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(s) AS ts FROM d)
 SELECT omitted, CAST(tn - n AS BIGINT) AS n, round((ts - s) / (tn - n), 6) AS rate, round((ts - s) / (tn - n) - ts / tn, 6) AS delta FROM d, t""")
def _(spark, sf):
    return r6(C.leave_one_out(D.cells(spark, sf), F.col("model") % 7), "rate", "delta")


@query("cohort_pivot", """SELECT model, round(avg(CAST(signature AS INT)) FILTER (WHERE prompt_id < 70), 6) AS pilot, round(avg(CAST(signature AS INT)) FILTER (WHERE prompt_id >= 70), 6) AS extension,
 round(avg(CAST(signature AS INT)) FILTER (WHERE prompt_id >= 70) - avg(CAST(signature AS INT)) FILTER (WHERE prompt_id < 70), 6) AS change FROM cells GROUP BY model""")
def _(spark, sf):
    cohort = F.when(F.col("prompt_id") < 70, "pilot").otherwise("extension")
    wide = D.cells(spark, sf).withColumn("cohort", cohort).groupBy("model").pivot("cohort", ["pilot", "extension"])
    out = wide.agg(F.avg(F.col("signature").cast("int")))
    return r6(out.withColumn("change", F.col("extension") - F.col("pilot")), "pilot", "extension", "change")


@query("count_map_entropy", """WITH t AS (SELECT prompt_id, sum(n) AS total FROM gatecounts GROUP BY 1) SELECT prompt_id, round(sum(-(n / total) * ln(n / total)), 6) AS entropy, CAST(any_value(total) AS BIGINT) AS total
 FROM gatecounts JOIN t USING (prompt_id) GROUP BY 1""")
def _(spark, sf):
    return r6(D.features(spark, sf).select("prompt_id", X.entropy(F.col("counts")).alias("entropy"), X.map_total(F.col("counts")).alias("total")), "entropy")


@query("gate_totals", "SELECT flag AS gate, CAST(sum(n) AS BIGINT) AS total, count(*) AS prompts FROM gatecounts GROUP BY 1")
def _(spark, sf):
    return D.features(spark, sf).select(F.explode("counts").alias("gate", "n")).groupBy("gate").agg(F.sum("n").alias("total"), F.count("*").alias("prompts"))


@query("structural_check", """WITH p AS (SELECT a.prompt_id, a.qubits = b.qubits AS qubits_ok, a.clbits = b.clbits AS clbits_ok, a.gates = b.gates AS gates_ok, a.entries = b.entries AS types_ok
 FROM features a JOIN features b ON b.prompt_id = (a.prompt_id + 9) % 154) SELECT count(*) AS n, count(*) FILTER (WHERE qubits_ok) AS qubits_ok, count(*) FILTER (WHERE clbits_ok) AS clbits_ok, count(*) FILTER (WHERE gates_ok) AS gates_ok,
 count(*) FILTER (WHERE types_ok) AS types_ok, count(*) FILTER (WHERE qubits_ok AND clbits_ok AND gates_ok AND types_ok) AS all_ok FROM p""")
def _(spark, sf):
    f = D.features(spark, sf).withColumn("entries", X.sorted_entries(F.col("counts"))).drop("counts")
    g = f.select(*[F.col(c).alias("o_" + c) for c in f.columns])
    same = {c + "_ok": F.col(s) == F.col("o_" + s) for c, s in (("qubits", "qubits"), ("clbits", "clbits"), ("gates", "gates"), ("types", "entries"))}
    pairs = f.join(g, F.col("o_prompt_id") == (F.col("prompt_id") + 9) % 154).select(*[v.alias(k) for k, v in same.items()])
    every = F.col("qubits_ok") & F.col("clbits_ok") & F.col("gates_ok") & F.col("types_ok")
    return pairs.agg(F.count("*").alias("n"), *[X.ones(F.col(c)).alias(c) for c in same], X.ones(every).alias("all_ok"))


@query("wilson_interval", """SELECT model, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high
 FROM (SELECT model, rate AS p, CAST(n AS DOUBLE) AS n, CAST(1.959963984540054 AS DOUBLE) AS z FROM model_rates)""")
def _(spark, sf):
    out = D.cells(spark, sf).groupBy("model").agg(X.wilson(X.ones(F.col("signature")), F.count("*")).alias("w"))
    return r6(out.select("model", "w.low", "w.high"), "low", "high")


@query("crosstab_pivot", """SELECT l_linestatus AS slice, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1""")
def _(spark, sf):
    wide = D.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("slice")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return wide.select("slice", *[F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in "ANR"])


@query("complementarity", """WITH copied AS (SELECT prompt_id FROM features WHERE gates % 2 = 0) SELECT prompt_id, count(*) AS models FROM cells JOIN copied USING (prompt_id) GROUP BY 1 HAVING count(*) FILTER (WHERE parameter AND model < 6) = 0""")
def _(spark, sf):
    copied = D.features(spark, sf).where("gates % 2 = 0").select("prompt_id")
    joined = D.cells(spark, sf).join(F.broadcast(copied), "prompt_id").groupBy("prompt_id").agg(F.count("*").alias("models"), X.ones(F.col("parameter") & (F.col("model") < 6)).alias("s"))
    return joined.where("s = 0").select("prompt_id", "models")


@query("exemplar_ranks", f"""WITH r AS (SELECT prompt_id, row_number() OVER (ORDER BY round(1 - solved / models, 9), types, gates, prompt_id) - 1 AS pos, count(*) OVER () AS n FROM ({_ITEMS}) JOIN features USING (prompt_id))
 SELECT prompt_id, pos FROM r WHERE pos IN (0, round_even((n - 1) / 3.0, 0), round_even(2 * (n - 1) / 3.0, 0), n - 1)""")
def _(spark, sf):
    every = Window.partitionBy()
    items = _items(spark, sf).join(D.features(spark, sf).select("prompt_id", "types", "gates"), "prompt_id")
    r = items.withColumns({"pos": (F.row_number().over(every.orderBy(F.round("difficulty", 9), "types", "gates", "prompt_id")) - 1).cast("long"), "n": F.count("*").over(every)})
    at = lambda k: F.bround(k * (F.col("n") - 1) / 3.0, 0)
    return r.where(F.col("pos").isin(0) | (F.col("pos") == at(1)) | (F.col("pos") == at(2)) | (F.col("pos") == F.col("n") - 1)).select("prompt_id", "pos")
