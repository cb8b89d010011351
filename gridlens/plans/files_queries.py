"""Files that are written and read back: JSON lines, CSV, manifests, reports, splits, batch outputs; and forms of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cells as C
from ..operators import validate as V
from ..sources import readers as S
from ..sources import sinks as K
from ..staging import settle, shared_folder
from . import fixtures as D
from .cells_queries import r6
from .registry import query


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("jsonl_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    path = _folder(spark, "jsonl")
    K.write_canonical_json(D.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return S.json_lines(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("csv_round_trip", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    path = _folder(spark, "csv")
    K.write_delimited(D.table(spark, sf, "region"), path, ["r_regionkey", "r_name"])
    return S.csv(spark, path, "r_regionkey int, r_name string")


@query("manifest_round_trip", "SELECT 'part/' || p_partkey AS path, CAST(p_size AS BIGINT) AS bytes, sha256(p_name) AS sha256 FROM part")
def _(spark, sf):
    path = _folder(spark, "manifest")
    rows = D.table(spark, sf, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("path"), F.col("p_size").cast("long").alias("bytes"), F.sha2("p_name", 256).alias("sha256"))
    K.write_delimited(rows, path, ["path", "bytes", "sha256"], sep="\t")
    return S.manifest(spark, path)


_REPORTED = """SELECT 'm' || model AS model, count(*) AS cells, count(*) FILTER (WHERE execution) AS execution, count(*) FILTER (WHERE assembly) AS assembly, count(*) FILTER (WHERE signature) AS signature,
 count(*) FILTER (WHERE ordered) AS ordered, count(*) FILTER (WHERE parameter) AS parameter FROM cells WHERE model <> 20 GROUP BY model"""


@query("report_scan", _REPORTED)
def _(spark, sf):
    folder = _folder(spark, "reports")
    done = lambda c: F.struct(F.col("execution").alias("execution_success"), F.col("execution").alias("circuit_found"), F.struct(F.col("assembly").alias("success")).alias("qasm3_export")).alias(c)
    checks = F.struct(F.col("signature").alias("all_match"), F.col("ordered").alias("ordered_match"), F.col("parameter").alias("parameter_match")).alias("structural_checks")
    records = D.cells(spark, sf).select("model", F.struct(F.col("prompt_id").cast("string").alias("prompt_id"), done("execution"), checks).alias("r"))
    whole = settle(records.groupBy("model").agg(F.to_json(F.struct(F.collect_list("r").alias("records"))).alias("report")), "records")
    for model in range(21):  # a report is one file for a model's prompts
        whole.where(F.col("model") == model).select("report").coalesce(1).write.text(f"{folder}/run_{model}/report.json")
    cells = S.report_cells(S.reports(spark, folder, {f"run_{m}": f"m{m}" for m in range(20)}))  # the last folder is of no known model
    return C.summarize(cells, "model").select("model", "cells", "execution", "assembly", "signature", "ordered", "parameter")


@query("release_reproduction", """SELECT count(*) AS cells, count(DISTINCT model) AS models, count(*) FILTER (WHERE execution) AS execution, count(*) FILTER (WHERE signature) AS signature, round(count(*) FILTER (WHERE signature) / count(*), 6) AS signature_rate FROM cells""")
def _(spark, sf):
    path = _folder(spark, "release")
    names = {"execution": "report_executable", "assembly": "report_assembly_admissible", "signature": "report_signature_match", "ordered": "ordered_wire_tape_match", "parameter": "parameter_aware_tape_match"}
    K.write_canonical_json(D.cells(spark, sf).select(F.col("model").cast("string").alias("model"), F.col("prompt_id").cast("string").alias("prompt_id"), *[F.col(c).alias(n) for c, n in names.items()]), path)
    rows = S.json_lines(spark, path, "model string, prompt_id string, " + ", ".join(f"{n} boolean" for n in names.values()))
    return r6(C.summarize(V.resolve(rows)).select("cells", "models", "execution", "signature", "signature_rate"), "signature_rate")


@query("split_files", "SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split, count(*) AS rows, CAST(0 AS BIGINT) AS faults FROM documents GROUP BY 1")
def _(spark, sf):
    path = _folder(spark, "splits")
    docs = D.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "validation").otherwise("test")
    assigned = docs.select("doc_id", split.alias("split"))
    K.write_splits(docs, assigned, "doc_id", path)
    faults = K.splits_differ(spark, docs, assigned, "doc_id", path).agg(F.count("*").alias("faults"))
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("rows")).crossJoin(faults)


@query("batch_outputs", """SELECT item_id AS prompt_id, CASE WHEN item_id % 4 = 3 THEN NULL WHEN item_id % 4 = 2 THEN '' ELSE 'a' || item_id || 'b' END AS text, CASE WHEN item_id % 4 = 3 THEN 'no response' WHEN item_id % 4 = 2 THEN 'too long' END AS error, CASE WHEN item_id % 4 = 3 THEN NULL ELSE 'm' END AS model,
 CASE WHEN item_id % 4 = 3 THEN NULL WHEN item_id % 4 = 1 THEN 'completed' ELSE 'unknown' END AS finish, CASE item_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 7 END AS tokens_in, CASE item_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 8 END AS tokens_out FROM benchmark""")
def _(spark, sf):
    k, i = F.col("item_id") % 4, F.col("item_id").cast("string")
    said = F.concat(F.lit('[{"type":"message","content":[{"type":"t","text":"a'), i, F.lit('"},{"type":"t","text":"b"}]}]'))
    usage = F.when(k == 0, '{"input_tokens":5,"output_tokens":6}').otherwise('{"prompt_tokens":7,"completion_tokens":8}')
    body = F.when(k == 2, '{"model":"m","output":[],"error":{"message":"too long"}}').otherwise(F.concat(F.lit('{"model":"m",'), F.when(k == 1, '"status":"completed",').otherwise(""), F.lit('"output":'), said, F.lit(',"usage":'), usage, F.lit("}")))
    items = D.table(spark, sf, "benchmark").select("item_id", i.alias("prompt_id"), k.alias("k"), body.alias("body"))
    line = F.concat(F.lit('{"custom_id":"run::'), F.col("prompt_id"), F.lit('","response":{"status_code":200,"body":'), F.col("body"), F.lit("}}"))
    lines = items.where("k < 3").select(F.from_json(line, S.BATCH).alias("l")).select("l.*")
    return S.batch_responses(lines, items.select("prompt_id")).withColumn("prompt_id", F.col("prompt_id").cast("long"))


@query("exact_bijection", "SELECT CAST(doc_id AS BIGINT) AS id, CASE WHEN doc_id % 50 = 0 THEN 'left' ELSE 'right' END AS only FROM documents WHERE doc_id % 50 = 0 OR doc_id % 70 = 1")
def _(spark, sf):
    ids = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return V.key_mismatches(ids.where("id % 50 = 0 or id % 70 <> 1"), ids.where("id % 50 <> 0"), "id")


@query("text_forms", r"""SELECT p_partkey, trim(p_name) AS code, CASE WHEN length(l) > 24 THEN substr(l, 1, 21) || '...' ELSE l END AS short, regexp_replace(regexp_replace(lower(p_type || ' #' || p_size || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT *, trim(regexp_replace(p_type || '  of' || chr(10) || p_name || ' and ' || p_brand, '\s+', ' ', 'g')) AS l FROM part)""")
def _(spark, sf):
    fenced = F.concat(F.lit("Sure:\n```Python\n"), "p_name", F.lit("\n```\nand ```python\nno\n```"))
    line = F.concat("p_type", F.lit("  of\n"), "p_name", F.lit(" and "), "p_brand")
    return D.table(spark, sf, "part").select("p_partkey", X.strip_fence(fenced).alias("code"), X.short(line, 24).alias("short"), X.slug(F.concat("p_type", F.lit(" #"), F.col("p_size"), F.lit("!"))).alias("slug"))


@query("unix_times", "SELECT strftime(to_timestamp(1700000000 + l_orderkey * 3600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("l_orderkey") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return D.table(spark, sf, "lineitem").groupBy(at.alias("at")).agg(F.count("*").alias("n"))
