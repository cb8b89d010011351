"""Python forms, tapes, manifests, resumed logs and props read from JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.python_forms import ast_hash, sequence_ratio
from ..sources import readers as S
from ..streaming import attempts as T
from ..staging import settle
from . import fixtures as D
from .registry import query


def _code(spark, sf):
    """A program for each order line that differs in form only by l_linenumber, in content by l_quantity."""
    gap = F.when(F.col("l_linenumber") % 2 == 0, "x = {}  # note\nprint(x)").otherwise("x={}\nprint( x )")
    text = F.replace(gap, F.lit("{}"), F.col("l_quantity").cast("int").cast("string"))
    return D.table(spark, sf, "lineitem").select(F.col("l_orderkey"), text.alias("code"))


@query("ast_hash_agreement", "SELECT count(DISTINCT CAST(l_quantity AS INT) * 2 + l_linenumber % 2) AS texts, count(DISTINCT CAST(l_quantity AS INT)) AS trees, count(*) AS rows FROM lineitem")
def _(spark, sf):
    distinct = _code(spark, sf).select("code").distinct().withColumn("tree", ast_hash("code"))
    return _code(spark, sf).join(distinct, "code").agg(F.countDistinct("code").alias("texts"), F.countDistinct("tree").alias("trees"), F.count("*").alias("rows"))


@query("sequence_ratio")
def _(spark, sf):
    t = D.table(spark, sf, "benchmark").select("item_id", X.tokens(F.col("text")).alias("t"))
    pairs = t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u")), "item_id")
    return pairs.select("item_id", F.round(sequence_ratio("t", "u"), 6).alias("ratio"))


@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def _(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return D.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("manifest_verify", "SELECT * FROM (VALUES ('nation.parquet', 'content'), ('region.parquet', 'size'), ('gone.parquet', 'missing')) AS t(path, fault)")
def _(spark, sf):
    """The whole folder against a manifest that is wrong in three places."""
    found = settle(S.digests(spark, sf), "digests")
    named = lambda n: F.col("path") == n
    wrong = found.withColumn("sha256", F.when(named("nation.parquet"), F.lit("0" * 64)).otherwise(F.col("sha256"))).withColumn("bytes", F.col("bytes") + named("region.parquet").cast("long"))
    listed = wrong.unionByName(spark.range(1).select(F.lit("gone.parquet").alias("path"), F.lit(1).cast("long").alias("bytes"), F.lit("0" * 64).alias("sha256")))
    return S.verify(listed, found)


@query("resume_prompts", "SELECT prompt_id FROM (SELECT DISTINCT prompt_id FROM attempts) WHERE prompt_id NOT IN (SELECT prompt_id FROM attempts WHERE NOT is_error)")
def _(spark, sf):
    log = D.attempts(spark, sf)
    return T.unfinished(log.select("prompt_id").distinct(), log)


@query("attempt_windows", "SELECT date_trunc('day', created_at) AS start, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors FROM attempts GROUP BY 1")
def _(spark, sf):
    return T.error_rates(D.attempts(spark, sf)).drop("end")


@query("status_text", "SELECT l_shipmode_ AS status, printf('%.2f%%', 100.0 * n / t) AS share FROM (SELECT o_orderstatus AS l_shipmode_, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY 1)")
def _(spark, sf):
    counts = D.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    from ..operators.cells import with_share

    return with_share(counts).select("status", F.format_string("%.2f%%", 100 * F.col("share")).alias("share"))
