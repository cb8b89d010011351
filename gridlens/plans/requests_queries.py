"""From a split's manifest to requests, their audit, and the code that is copied most."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import requests as Q
from . import fixtures as D
from .cells_queries import r6
from .registry import query

_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END"
#: Rows of documents and the manifest of their splits: groups are blocks of ten ids, so some lie in several splits.
_LISTED = f"""rw AS (SELECT CAST(doc_id AS VARCHAR) AS row_id, 'g' || doc_id // 10 AS own FROM documents WHERE doc_id % 41 <> 0), mf AS (SELECT CAST(CASE WHEN doc_id % 97 = 1 THEN NULL ELSE doc_id END AS VARCHAR) AS row_id, CASE WHEN doc_id % 101 = 2 THEN 'holdout' ELSE {_SPLIT} END AS split,
 CASE WHEN doc_id % 53 = 3 THEN 'elsewhere' WHEN doc_id % 2 = 0 THEN 'g' || doc_id // 10 ELSE '' END AS stated, CASE WHEN doc_id % 10 = 9 AND doc_id % 30 <> 9 THEN doc_id // 20 WHEN doc_id % 89 = 0 THEN doc_id END AS pos FROM documents),
 li AS (SELECT *, row_id IS NULL OR split NOT IN ('train', 'validation', 'test') AS odd FROM mf), bo AS (SELECT coalesce(rw.row_id, li.row_id) AS row_id, own, nullif(stated, '') AS stated, split, pos, rw.row_id IS NOT NULL AS there, li.row_id IS NOT NULL AS listed FROM rw FULL JOIN (SELECT * FROM li WHERE NOT odd) li ON rw.row_id = li.row_id)"""


@query("manifest_faults", f"""WITH {_LISTED} SELECT row_id, 'no such split' AS fault FROM li WHERE odd UNION ALL SELECT row_id, CASE WHEN NOT listed THEN 'not listed' WHEN NOT there THEN 'not a row' ELSE 'other group' END FROM bo WHERE NOT listed OR NOT there OR stated <> own
 UNION ALL SELECT own, 'group in several splits' FROM bo WHERE there AND listed GROUP BY own HAVING count(DISTINCT split) > 1 UNION ALL SELECT row_id, 'place outside test' FROM li WHERE pos IS NOT NULL AND split <> 'test'
 UNION ALL SELECT row_id, 'no place' FROM li WHERE split = 'test' AND pos IS NULL UNION ALL SELECT min(row_id), 'place taken twice' FROM li WHERE split = 'test' AND pos IS NOT NULL GROUP BY pos HAVING count(*) > 1""")
def _(spark, sf):
    d = F.col("doc_id")
    docs, group = D.table(spark, sf, "documents"), F.concat(F.lit("g"), F.floor(d / 10))
    rows = docs.where(d % 41 != 0).select(d.alias("row_id"), group.alias("group_id"))
    stated = F.when(d % 53 == 3, "elsewhere").when(d % 2 == 0, group).otherwise("")
    pos = F.when((d % 10 == 9) & (d % 30 != 9), F.floor(d / 20)).when(d % 89 == 0, d)
    split = F.when(d % 101 == 2, "holdout").otherwise(F.expr(_SPLIT))
    return Q.manifest_faults(rows, docs.select(F.when(d % 97 != 1, d).alias("row_id"), split.alias("split"), stated.alias("group_id"), pos.alias("pos")), "row_id", "group_id")


#: Models that are asked: provider, model, family, and whether they take controls of sampling.
TARGETS = [("p1", "m/chat-1", "openai_compatible_chat", True), ("p2", "m-resp", Q.RESPONSES, True), ("p3", "m-msg", Q.MESSAGES, False), ("p3", "m-msg-2", Q.MESSAGES, True), ("p4", "m-gen", Q.CONTENTS, True), ("p5", "m-base", Q.COMPLETION, True)]
SYSTEM = "You write code."
_J = lambda *kv: "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in kv) + " || '}'"
_S = lambda v: f"""'"' || {v} || '"'"""
_MSG = lambda role, text: _J(("content", _S(text)), ("role", _S(f"'{role}'")))
_BOTH = "'[' || " + _MSG("system", f"'{SYSTEM}'") + " || ',' || " + _MSG("user", "t") + " || ']'"
_TEXT = f"'{SYSTEM}\\n\\n{Q.ABOVE}\\n' || trim(t) || '\\n\\n{Q.BELOW}'"
_PART = lambda text: "'[' || " + _J(("text", _S(text))) + " || ']'"
_ONE = "'[' || " + _MSG("user", "t") + " || ']'"
_HEAT = (("temperature", "'0.0'"), ("top_p", "'0.95'"))
_BODY = f"""CASE family WHEN '{Q.RESPONSES}' THEN {_J(("input", "messages"), ("max_output_tokens", "'2048'"), ("model", _S("model")))}
 WHEN '{Q.MESSAGES}' THEN CASE WHEN sampling THEN {_J(("max_tokens", "'2048'"), ("messages", _ONE), ("model", _S("model")), ("system", _S(f"'{SYSTEM}'")), *_HEAT)} ELSE {_J(("max_tokens", "'2048'"), ("messages", _ONE), ("model", _S("model")), ("system", _S(f"'{SYSTEM}'")))} END
 WHEN '{Q.CONTENTS}' THEN {_J(("contents", "'[' || " + _J(("parts", _PART("t")), ("role", _S("'user'"))) + " || ']'"), ("generation_config", _J(("max_output_tokens", "'2048'"), *_HEAT)), ("model", _S("model")), ("system_instruction", _J(("parts", _PART(f"'{SYSTEM}'")))))}
 WHEN '{Q.COMPLETION}' THEN {_J(("max_tokens", "'2048'"), ("model", _S("model")), ("prompt", _S("prompt")), *_HEAT)} ELSE {_J(("max_tokens", "'2048'"), ("messages", "messages"), ("model", _S("model")), ("seed", "'7'"), *_HEAT)} END"""
_SHOWN = _J(("messages", "messages"), ("prompt", _S("prompt")), ("prompt_id", _S("prompt_id")), ("row_id", _S("row_id")))
_RECORD = _J(("instruction", _S("t")), ("label", _S("'strict'")), ("messages", "messages"), ("prompt", _S("prompt")), ("prompt_id", _S("prompt_id")), ("row_id", _S("row_id")), ("split", _S("'test'")))
_ASKED = f"""b AS (SELECT CAST(item_id AS VARCHAR) AS row_id, 'gen_' || lpad(CAST(item_id + 1 AS VARCHAR), CAST(greatest(4, length(CAST(item_id + 1 AS VARCHAR))) AS INT), '0') AS prompt_id, regexp_replace(text, '[^A-Za-z0-9., ]', ' ', 'g') AS t FROM benchmark), c AS (SELECT *, {_TEXT} AS prompt, {_BOTH} AS messages FROM b),
 q AS (SELECT *, {_BODY} AS body FROM c, (VALUES {', '.join(str(t).replace('True', 'true').replace('False', 'false') for t in TARGETS)}) AS m(provider, model, family, sampling))"""


def _asked(spark, sf):
    text = F.regexp_replace("text", "[^A-Za-z0-9., ]", " ")
    test = D.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("row_id"), F.lit("strict").alias("label"), text.alias("instruction"), F.col("item_id").alias("pos"))
    targets = spark.createDataFrame(TARGETS, "provider string, model string, family string, sampling boolean")
    return Q.model_requests(Q.prompt_records(test, SYSTEM, "gen"), targets, temperature=0.0, top_p=0.95, max_tokens=2048, seed=7)


@query("model_requests", f"""WITH {_ASKED} SELECT prompt_id, model, body, sha256({_SHOWN}) AS model_input_sha256, sha256({_RECORD}) AS prompt_record_sha256, sha256({_J(("api_model_id", _S("model")), ("body", "body"), ("provider", _S("provider")), ("request_family", _S("family")))}) AS request_sha256 FROM q""")
def _(spark, sf):
    return _asked(spark, sf).select("prompt_id", "model", "body", *[d for d in ("model_input_sha256", "prompt_record_sha256", "request_sha256")])


# ------------------------------------------------------------------------------------------------------------- run audits

# Users are prompts and events responses to one of five models; a model is asked for the users that aren't its own number modulo 7.
_RUN = """rq AS (SELECT m AS model, u AS prompt_id, md5('r' || u) AS request_sha256, md5('i' || u) AS model_input_sha256, md5('p' || u) AS prompt_record_sha256 FROM (SELECT DISTINCT user_id AS u FROM events), (SELECT unnest(range(5)) AS m) WHERE u % 7 <> m),
 rs AS (SELECT event_id % 5 AS model, user_id AS prompt_id, event_id AS seq, nullif(event_type, 'view') AS finish, 'v' || event_id % 3 AS resolved, md5('r' || CASE WHEN event_id % 9 = 0 THEN 0 ELSE user_id END) AS request_sha256, md5('i' || user_id) AS model_input_sha256, CASE WHEN event_id % 11 <> 0 THEN md5('p' || user_id) END AS prompt_record_sha256 FROM events)"""


@query("run_audit", f"""WITH {_RUN}, h AS (SELECT rs.*, rq.model IS NOT NULL AS asked, CASE WHEN rq.model IS NULL THEN 1 ELSE CAST(rs.request_sha256 <> rq.request_sha256 AS INT) + CAST(rs.model_input_sha256 <> rq.model_input_sha256 AS INT) + CAST(coalesce(rs.prompt_record_sha256, '') <> rq.prompt_record_sha256 AS INT) END AS wrong,
 row_number() OVER (PARTITION BY rs.model, rs.prompt_id ORDER BY seq DESC) AS r FROM rs LEFT JOIN rq ON rq.model = rs.model AND rq.prompt_id = rs.prompt_id), f AS (SELECT model, string_agg(finish || ':' || n, ',' ORDER BY finish) AS finishes FROM (SELECT model, coalesce(finish, '<missing>') AS finish, count(*) AS n FROM h WHERE r = 1 GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT model, count(*) AS response_rows, count(*) FILTER (WHERE r = 1) AS answered, count(*) FILTER (WHERE r > 1) AS repeats, CAST(sum(wrong) AS BIGINT) AS mismatches, count(*) FILTER (WHERE r = 1 AND finish = 'error') AS errors, string_agg(DISTINCT resolved, ',' ORDER BY resolved) FILTER (WHERE r = 1) AS resolved, count(*) FILTER (WHERE r = 1 AND asked) AS known FROM h GROUP BY model),
 a AS (SELECT model, count(*) AS request_rows FROM rq GROUP BY 1) SELECT model, request_rows, response_rows, answered, repeats, mismatches, errors, resolved, finishes, CAST(120 AS BIGINT) AS evaluated, request_rows - known AS missing, 'pending' AS status FROM a JOIN s USING (model) JOIN f USING (model)""")
def _(spark, sf):
    events, u, e = D.table(spark, sf, "events"), F.col("user_id").cast("string"), F.col("event_id")
    digest = lambda p, c: F.md5(F.concat(F.lit(p), c))
    digests = [digest("r", u).alias("request_sha256"), digest("i", u).alias("model_input_sha256"), digest("p", u).alias("prompt_record_sha256")]
    asked = events.select("user_id").distinct().crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "model"))).where("user_id % 7 <> model")
    said = events.select(
        (e % 5).alias("model"), F.col("user_id").alias("prompt_id"), e.alias("at"), F.nullif("event_type", F.lit("view")).alias("finish"), F.concat(F.lit("v"), e % 3).alias("resolved"),
        digest("r", F.when(e % 9 == 0, "0").otherwise(u)).alias("request_sha256"), digests[1], F.when(e % 11 != 0, digest("p", u)).alias("prompt_record_sha256"),
    )
    evaluated = spark.range(5).select(F.col("id").alias("model"), F.lit(120).cast("long").alias("rows"))
    return Q.audit_runs(asked.select("model", F.col("user_id").alias("prompt_id"), *digests), said, evaluated, 120)


@query("majority_copy", f"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS code, {_SPLIT} AS split FROM documents), m AS (SELECT code, count(*) AS copies, min(doc_id) AS doc_id FROM d WHERE split = 'train' AND code IS NOT NULL GROUP BY code ORDER BY copies DESC, code LIMIT 1)
 SELECT m.doc_id AS copied, copies, count(*) AS tested, count(*) FILTER (WHERE d.code = m.code) AS exact, round(count(*) FILTER (WHERE d.code = m.code) / count(*), 6) AS rate FROM d, m WHERE split = 'test' GROUP BY 1, 2""")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", X.normal_code(F.col("text")).alias("code"), F.expr(_SPLIT).alias("split"))
    major = Q.majority_code(docs.where("split = 'train'"), "code", "doc_id")
    out = Q.copied(docs.where("split = 'test'"), "code", major).agg(F.count("*").alias("tested"), X.ones(F.col("exact")).alias("exact"), X.rate(X.ones(F.col("exact")), F.count("*")).alias("rate"))
    return r6(major.select(F.col("doc_id").alias("copied"), "copies").crossJoin(out), "rate")
