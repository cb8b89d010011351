"""The tables at hand as inputs of the engine: cells, runs, features, attempts, labelled documents; in Spark and as SQL views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATEST = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey", "l_suppkey")
ENDPOINTS = {"execution": 5, "assembly": 6, "signature": 24, "ordered": 27, "parameter": 29}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _endpoints(grouped: DataFrame, *keys: str) -> DataFrame:
    return grouped.select(*keys, *[(F.col("q") >= n).alias(c) for c, n in ENDPOINTS.items()])


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(model, prompt_id, endpoints): of each cell, the latest attempt decides."""
    rows = table(spark, sf, "lineitem").withColumns({"model": F.col("l_suppkey") % 21, "prompt_id": F.col("l_partkey") % 154})
    return _endpoints(rows.groupBy("model", "prompt_id").agg(F.max_by("l_quantity", F.struct(*LATEST)).alias("q")), "model", "prompt_id")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """(model, prompt_id, run, endpoints) of items that have all three runs."""
    rows = table(spark, sf, "lineitem").withColumns(
        {"model": F.col("l_suppkey") % 21, "prompt_id": F.col("l_partkey") % 154, "run": (F.col("l_linenumber") % 3 + 1).cast("long")}
    )
    each = rows.groupBy("model", "prompt_id", "run").agg(F.max_by("l_quantity", F.struct(*LATEST)).alias("q"))
    whole = each.groupBy("model", "prompt_id").agg(F.count("*").alias("n")).where("n = 3").drop("n")
    return _endpoints(each.join(whole, ["model", "prompt_id"]), "model", "prompt_id", "run")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """(prompt_id, counts map, qubits, clbits, gates, types): counts of return flags stand for gates, N for barriers."""
    rows = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 154).alias("prompt_id"), F.col("l_returnflag").alias("flag"))
    each = rows.agg(F.count("*").alias("n")).withColumn("n", F.col("n") % 7 + 1)
    maps = each.groupBy("prompt_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("counts"))
    maps = maps.withColumns({
        "qubits": F.col("prompt_id") % 9 + 1,
        "clbits": F.col("prompt_id") % 3,
        "types": F.size("counts").cast("long"),
    })
    return maps.withColumn("gates", F.aggregate(F.map_values(F.map_filter("counts", lambda k, _: k != "N")), F.lit(0).cast("long"), lambda a, v: a + v))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """(prompt_id, created_at, idx, is_error)."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("prompt_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("idx"), (F.col("event_type") == "error").alias("is_error")
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, lang, source, n_chars, y): documents with a quality label."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


def harness(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a harness run: what an execution did, its checks, and metadata; line items stand for them, nulls included."""
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in HARNESS.items()])


#: Columns of harness() in terms of line items, in what Spark and DuckDB both read.
HARNESS = {
    "row_id": "l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 100 + l_suppkey % 100",
    "part": "l_orderkey % 5",
    "label": "CASE WHEN l_linestatus = 'O' THEN 'strict_n8' ELSE 'extended_n8' END",
    "empty": "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity <= 2 END",
    "executed": "l_quantity > 8",
    "error": "CASE WHEN l_returnflag = 'A' THEN 'NameError' WHEN l_returnflag = 'N' THEN 'TypeError' WHEN l_linenumber = 1 THEN '' END",
    "circuit": "CASE WHEN l_tax > 0.01 THEN true END",
    "types_ok": "l_discount < 0.08",
    "clbits_ok": "l_linenumber <> 3",
    "qubits_ok": "l_linenumber <> 5",
    "count_ok": "l_partkey % 7 <> 0",
    "whole_ok": "l_discount < 0.08 AND l_linenumber <> 3 AND l_linenumber <> 5 AND l_partkey % 7 <> 0 AND l_suppkey % 4 <> 0",
    "exported": "CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE l_suppkey % 3 <> 0 END",
    "status": "CASE WHEN l_linestatus = 'O' THEN 'validated' WHEN l_tax > 0.05 THEN 'failed' END",
    "confidence": "CASE WHEN l_returnflag <> 'R' THEN 'high' ELSE 'low' END",
    "demo": "CASE WHEN l_linenumber = 7 THEN true WHEN l_linenumber = 2 THEN false END",
    "cleanup": "CASE WHEN l_partkey % 11 = 0 THEN true WHEN l_partkey % 2 = 0 THEN false END",
    "lines": "CASE WHEN l_linenumber = 4 AND l_quantity > 45 THEN NULL ELSE CAST(l_quantity AS BIGINT) END",
    "gates": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_partkey % 6 END",
    "strategy": "CASE WHEN l_suppkey % 5 = 0 THEN 'empirical_promoted_repo' WHEN l_suppkey % 5 = 1 THEN 'search' END",
    "mutation": "CASE WHEN l_suppkey % 3 = 0 THEN true WHEN l_suppkey % 3 = 1 THEN false END",
    "bucket": "CASE WHEN l_returnflag = 'A' THEN 'public_open' WHEN l_returnflag = 'N' THEN 'restricted' END",
    "rights": "CASE WHEN l_tax < 0.03 THEN 'redistributable_mit' WHEN l_tax < 0.06 THEN 'unknown' END",
    "n_barrier": "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_suppkey % 2 END",
    "n_h": "l_partkey % 3",
    "n_cx": "l_partkey % 4",
    "qubits": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey % 5 END",
}

_PICK = "ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_partkey DESC, l_suppkey DESC"
_ENDS = ", ".join(f"q >= {n} AS {c}" for c, n in ENDPOINTS.items())
#: The same in SQL; a query's SQL gets those it names, and those that they name.
VIEWS = {
    "cells": f"""SELECT model, prompt_id, {_ENDS} FROM (
        SELECT l_suppkey % 21 AS model, l_partkey % 154 AS prompt_id, l_quantity AS q,
               row_number() OVER (PARTITION BY l_suppkey % 21, l_partkey % 154 {_PICK}) AS r FROM lineitem) WHERE r = 1""",
    "runs": f"""SELECT model, prompt_id, run, {_ENDS} FROM (
        SELECT *, count(*) OVER (PARTITION BY model, prompt_id) AS complete FROM (
            SELECT l_suppkey % 21 AS model, l_partkey % 154 AS prompt_id, CAST(l_linenumber % 3 + 1 AS BIGINT) AS run, l_quantity AS q,
                   row_number() OVER (PARTITION BY l_suppkey % 21, l_partkey % 154, l_linenumber % 3 {_PICK}) AS r FROM lineitem)
        WHERE r = 1) WHERE complete = 3""",
    "gatecounts": "SELECT l_partkey % 154 AS prompt_id, l_returnflag AS flag, count(*) % 7 + 1 AS n FROM lineitem GROUP BY 1, 2",
    "features": """SELECT prompt_id, prompt_id % 9 + 1 AS qubits, prompt_id % 3 AS clbits, count(*) AS types,
        CAST(coalesce(sum(n) FILTER (WHERE flag <> 'N'), 0) AS BIGINT) AS gates, bool_or(flag = 'N') AS has_barrier,
        string_agg('"' || flag || '":' || n, ',' ORDER BY flag) AS entries FROM gatecounts GROUP BY 1""",
    "harness": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in HARNESS.items()) + " FROM lineitem",
    "attempts": "SELECT user_id AS prompt_id, ts AS created_at, event_id AS idx, event_type = 'error' AS is_error FROM events",
    "labelled": "SELECT d.*, l.quality AS y FROM documents d JOIN labels l USING (doc_id)",
    "triples": """SELECT model, prompt_id, max(CASE WHEN run = 1 THEN CAST(signature AS INT) END) AS a, max(CASE WHEN run = 2 THEN CAST(signature AS INT) END) AS b,
        max(CASE WHEN run = 3 THEN CAST(signature AS INT) END) AS c FROM runs GROUP BY 1, 2""",
    "model_rates": "SELECT model, avg(CAST(signature AS INT)) AS rate, avg(CAST(execution AS INT)) AS exec_rate, count(*) AS n FROM cells GROUP BY 1",
}


def with_views(sql: str) -> str:
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    rest = sql.strip()
    return f"WITH {views}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {views} {rest}"
