"""Splits, quotas, representatives, deduplication and attempt logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import construct as C
from . import fixtures as D
from .cells_queries import _SIG, r6, signatures
from .registry import query

_SPLIT = """ml AS (SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1),
 rk AS (SELECT source, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(lang || ':' || source)) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM ml),
 sp AS (SELECT source, lang, CASE WHEN r < floor(0.8 * n) THEN 'train' WHEN r < floor(CAST(0.9 AS DOUBLE) * n) THEN 'validation' ELSE 'test' END AS split FROM rk)"""


def _split(spark, sf):
    return C.group_split(D.table(spark, sf, "documents").select("source", "lang"), "source", "lang")


@query("group_split_80_10_10", f"WITH {_SPLIT} SELECT * FROM sp")
def _(spark, sf):
    return _split(spark, sf)


@query("split_summary", f"WITH {_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT source) AS groups, count(DISTINCT d.lang) AS labels FROM documents d JOIN sp USING (source) GROUP BY split")
def _(spark, sf):
    docs = D.table(spark, sf, "documents").select("source", F.col("lang").alias("own"))
    return docs.join(_split(spark, sf).drop("lang"), "source").groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("source").alias("groups"), F.countDistinct("own").alias("labels"))


@query("split_group_overlap", """SELECT md5(text) AS text_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM (SELECT text, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM documents) GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def _(spark, sf):
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "validation").otherwise("test")
    rows = D.table(spark, sf, "documents").select(F.md5("text").alias("text_id"), split.alias("split"))
    return C.overlap(rows, "text_id").select("text_id", F.array_join("splits", ",").alias("splits"))


@query("signature_representatives", f"""WITH s AS ({_SIG}), r AS (SELECT sig, prompt_id, count(*) OVER (PARTITION BY sig) AS members, row_number() OVER (PARTITION BY sig ORDER BY sha256('panel' || chr(0) || prompt_id)) AS r FROM s)
 SELECT sig, prompt_id AS representative, members FROM r WHERE r = 1""")
def _(spark, sf):
    return C.representatives(signatures(spark, sf), "sig", "prompt_id", "panel")


@query("dedup_lowest_hash", "SELECT md5(text) AS text_id, arg_min(doc_id, sha256(CAST(doc_id AS VARCHAR))) AS doc_id FROM documents GROUP BY 1")
def _(spark, sf):
    rows = D.table(spark, sf, "documents").select(F.md5("text").alias("text_id"), "doc_id")
    return C.dedup_lowest_hash(rows, "text_id", "doc_id")


@query("stratum_pick", """WITH p AS (SELECT source, lang = 'en' AS flag, doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents), q AS (SELECT *, row_number() OVER (PARTITION BY source, flag ORDER BY h) <= 3 AS preferred FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY preferred DESC, h) AS pick FROM q) SELECT source, flag, doc_id FROM r WHERE pick <= 6""")
def _(spark, sf):
    return C.quota_pick(D.table(spark, sf, "documents").select("source", (F.col("lang") == "en").alias("flag"), "doc_id"), "source", "flag", "doc_id", 6)


_BIN3 = "CASE WHEN n_chars <= 800 THEN 'a' WHEN n_chars <= 2000 THEN 'b' ELSE 'c' END"


@query("joint_allocation", f"""WITH c AS (SELECT CASE WHEN lang = 'en' THEN 'one' ELSE 'two' END AS label, {_BIN3} AS bin, count(*) AS n FROM documents GROUP BY 1, 2), e AS (SELECT label, bin, n / sum(n) OVER (PARTITION BY label) AS p FROM c),
 g AS (SELECT x0, x1, 50 - x0 - x1 AS x2 FROM (SELECT unnest(range(31)) AS x0), (SELECT unnest(range(35)) AS x1)), f AS (SELECT * FROM g WHERE x2 BETWEEN 0 AND 20),
 q AS (SELECT f.*, v.label, v.bin, v.x FROM f, LATERAL (VALUES ('one', 'a', x0), ('one', 'b', x1), ('one', 'c', x2), ('two', 'a', 30 - x0), ('two', 'b', 34 - x1), ('two', 'c', 20 - x2)) AS v(label, bin, x)),
 d AS (SELECT x0, x1, x2, round(sum(pow(x - (CASE q.label WHEN 'one' THEN 50 ELSE 34 END) * coalesce(p, 0), 2)), 9) AS d FROM q LEFT JOIN e ON e.label = q.label AND e.bin = q.bin GROUP BY 1, 2, 3), b AS (SELECT x0, x1, x2 FROM d ORDER BY d, x0, x1, x2 LIMIT 1)
 SELECT label, bin, CAST(x AS BIGINT) AS quota FROM q JOIN b USING (x0, x1, x2)""")
def _(spark, sf):
    size = F.when(F.col("n_chars") <= 800, "a").when(F.col("n_chars") <= 2000, "b").otherwise("c")
    counts = D.table(spark, sf, "documents").groupBy(F.when(F.col("lang") == "en", "one").otherwise("two").alias("label"), size.alias("bin")).agg(F.count("*").alias("n"))
    return C.joint_allocation(counts, "label", "bin", "n", {"one": 50, "two": 34}, {"a": 30, "b": 34, "c": 20})


_QUOTAS = [("en", 20), ("fr", 10), ("de", 5), ("es", 5)]


def _strata():
    """Strata in order: each is the first of its signature among those that no stratum before took, up to its quota."""
    out, taken = [], "SELECT '' AS sig WHERE false"
    for k, (lang, quota) in enumerate(_QUOTAS):
        out.append(f"p{k} AS (SELECT lang, md5(text) AS sig, arg_min(doc_id, sha256(CAST(doc_id AS VARCHAR))) AS doc_id FROM documents WHERE lang = '{lang}' AND md5(text) NOT IN ({taken}) GROUP BY 1, 2), s{k} AS (SELECT * FROM p{k} ORDER BY sha256(CAST(doc_id AS VARCHAR)) LIMIT {quota})")
        taken += f" UNION ALL SELECT sig FROM s{k}"
    return ", ".join(out)


@query("stratified_extension", f"WITH {_strata()} " + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(len(_QUOTAS))))
def _(spark, sf):
    rows = D.table(spark, sf, "documents").select("lang", F.md5("text").alias("sig"), "doc_id")
    return C.stratified_extension(rows, "lang", "sig", "doc_id", _QUOTAS)


@query("ranked_majority", """SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, lang) AS r FROM (SELECT source, lang, count(*) // 20 AS n FROM documents GROUP BY 1, 2)) WHERE r = 1""")
def _(spark, sf):
    rows = D.table(spark, sf, "documents").groupBy("source", "lang").agg(F.floor(F.count("*") / 20).cast("int").alias("n"))
    return C.majority_label(rows.select("source", "lang", F.explode(F.array_repeat(F.lit(1), F.col("n") + 1))).select("source", "lang"), "source", "lang", {"fr": 0, "en": 1})


@query("merged_in_order", "SELECT prompt_id, pos FROM (SELECT prompt_id, row_number() OVER (ORDER BY sha256(CAST(prompt_id AS VARCHAR))) AS pos FROM features WHERE prompt_id % 3 < 2)")
def _(spark, sf):
    f = D.features(spark, sf).select("prompt_id")
    requests = f.where("prompt_id % 3 < 2").select("prompt_id", F.row_number().over(Window.orderBy(F.sha2(F.col("prompt_id").cast("string"), 256))).cast("long").alias("pos"))
    return C.in_request_order(C.disjoint_union(f.where("prompt_id < 60"), f.where("prompt_id >= 60"), "prompt_id"), requests, "prompt_id", "pos")


@query("cross_stratum_quotas", """WITH w AS (SELECT l_shipmode_ AS stratum, count(*) FILTER (WHERE NOT ext) AS pilot, count(*) FILTER (WHERE ext) AS extension FROM (SELECT prompt_id % 3 AS l_shipmode_, prompt_id >= 70 AS ext FROM features WHERE gates % 5 < 2) GROUP BY 1),
 o AS (SELECT stratum, unnest(range(CAST(least(pilot, 12) + 1 AS BIGINT))) AS p, extension FROM w), k AS (SELECT stratum, p FROM o WHERE 12 - p <= extension),
 g AS (SELECT a.p AS p0, b.p AS p1, c.p AS p2 FROM k a, k b, k c WHERE a.stratum = 0 AND b.stratum = 1 AND c.stratum = 2),
 best AS (SELECT * FROM g ORDER BY abs(2 * (p0 + p1 + p2) - 36), pow(2 * p0 - 12, 2) + pow(2 * p1 - 12, 2) + pow(2 * p2 - 12, 2), p0, p1, p2 LIMIT 1)
 SELECT 0 AS stratum, p0 AS pilot, 12 - p0 AS extension FROM best UNION ALL SELECT 1, p1, 12 - p1 FROM best UNION ALL SELECT 2, p2, 12 - p2 FROM best""")
def _(spark, sf):
    free = D.features(spark, sf).where("gates % 5 < 2").select((F.col("prompt_id") % 3).alias("stratum"), F.when(F.col("prompt_id") >= 70, "extension").otherwise("pilot").alias("cohort"))
    return C.quota_search(free.groupBy("stratum", "cohort").agg(F.count("*").alias("free")), "stratum", "cohort", "free", 12)


@query("seeded_quotas", """WITH w AS (SELECT stratum, count(*) FILTER (WHERE NOT ext) AS pilot, count(*) FILTER (WHERE ext) AS extension FROM (SELECT prompt_id % 3 AS stratum, prompt_id >= 77 AS ext FROM features) GROUP BY 1),
 k AS (SELECT stratum, p FROM (SELECT *, unnest(range(13)) AS p FROM w) WHERE p <= pilot AND 12 - p <= extension), g AS (SELECT a.p AS p0, b.p AS p1, c.p AS p2 FROM k a, k b, k c WHERE a.stratum = 0 AND b.stratum = 1 AND c.stratum = 2 AND a.p + b.p + c.p = 17),
 best AS (SELECT * FROM g ORDER BY greatest(abs(p0 - 6), abs(p1 - 6), abs(p2 - 6)), pow(p0 - 6, 2) + pow(p1 - 6, 2) + pow(p2 - 6, 2), sha256('seed' || chr(0) || 'allocation' || chr(0) || p0 || ',' || p1 || ',' || p2) LIMIT 1)
 SELECT 0 AS stratum, p0 AS pilot, 12 - p0 AS extension FROM best UNION ALL SELECT 1, p1, 12 - p1 FROM best UNION ALL SELECT 2, p2, 12 - p2 FROM best""")
def _(spark, sf):
    free = D.features(spark, sf).select((F.col("prompt_id") % 3).alias("stratum"), F.when(F.col("prompt_id") >= 77, "extension").otherwise("pilot").alias("cohort"))
    return C.quota_table(free.groupBy("stratum", "cohort").agg(F.count("*").alias("free")), "stratum", "cohort", "free", 12, 17, "seed")


@query("canonical_attempt_log", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY is_error, created_at, idx) AS r, count(*) OVER (PARTITION BY prompt_id) - 1 AS superseded FROM attempts)
 SELECT prompt_id, idx, is_error, superseded FROM r WHERE r = 1""")
def _(spark, sf):
    return C.canonical_log(D.attempts(spark, sf), "prompt_id", "created_at", "idx", "is_error").drop("created_at")


@query("superseded_attempts", """WITH r AS (SELECT *, row_number() OVER w AS r, first_value(idx) OVER w AS kept_index FROM attempts WINDOW w AS (PARTITION BY prompt_id ORDER BY is_error, created_at, idx))
 SELECT prompt_id, idx, kept_index, CASE WHEN is_error THEN 'retryable API error' ELSE 'duplicate successful call' END AS reason FROM r WHERE r > 1""")
def _(spark, sf):
    return C.superseded(D.attempts(spark, sf), "prompt_id", "created_at", "idx", "is_error").select("prompt_id", "idx", "kept_index", "reason")


@query("last_write_wins", "SELECT prompt_id, idx, is_error FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY created_at DESC, idx DESC) AS r FROM attempts) WHERE r = 1")
def _(spark, sf):
    return C.last_write(D.attempts(spark, sf), "prompt_id", "created_at", "idx").drop("created_at")


@query("attempt_summary", """WITH n AS (SELECT *, row_number() OVER w AS attempt, coalesce(lag(is_error) OVER w, false) AS after_error FROM attempts WINDOW w AS (PARTITION BY prompt_id ORDER BY created_at, idx))
 SELECT attempt, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors, count(*) FILTER (WHERE after_error) AS retried FROM n GROUP BY attempt""")
def _(spark, sf):
    n = C.transport_affected(D.attempts(spark, sf), "prompt_id", "created_at", "idx", "is_error")
    return n.groupBy("attempt").agg(F.count("*").alias("n"), X.ones(F.col("is_error")).alias("errors"), X.ones(F.col("after_error")).alias("retried"))


@query("disjoint_merge", """SELECT 'rows' AS what, count(*) AS n FROM (SELECT prompt_id FROM features WHERE prompt_id < 60 UNION ALL SELECT prompt_id FROM features WHERE prompt_id >= 55) UNION ALL
 SELECT 'common', count(*) FROM features WHERE prompt_id < 60 AND prompt_id >= 55""")
def _(spark, sf):
    f = D.features(spark, sf).select("prompt_id")
    a, b = f.where("prompt_id < 60"), f.where("prompt_id >= 55")
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(C.disjoint_union(a, b, "prompt_id"), "rows").unionByName(count(C.common_keys(a, b, "prompt_id"), "common"))


@query("novelty_anti_join", """WITH d AS (SELECT doc_id, lang, md5(text) AS sig, n_chars % 997 AS grp, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 400 END AS near FROM documents), o AS (SELECT * FROM d WHERE lang <> 'en')
 SELECT count(*) AS novel FROM d WHERE lang = 'en' AND sig NOT IN (SELECT sig FROM o) AND grp NOT IN (SELECT grp FROM o WHERE grp IS NOT NULL) AND (near IS NULL OR near NOT IN (SELECT near FROM o WHERE near IS NOT NULL))""")
def _(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("sig"), (F.col("n_chars") % 997).alias("grp"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 400).alias("near"))
    return C.novel(d.where("lang = 'en'"), d.where("lang <> 'en'"), ["sig", "grp", "near"]).agg(F.count("*").alias("novel"))


@query("scope_digest", "SELECT model, sha256(string_agg(CAST(prompt_id AS VARCHAR), chr(10) ORDER BY CAST(prompt_id AS VARCHAR)) || chr(10)) AS ids_sha256, count(*) AS prompts FROM cells GROUP BY model")
def _(spark, sf):
    ids = F.array_join(F.array_sort(F.collect_set(F.col("prompt_id").cast("string"))), "\n")
    return D.cells(spark, sf).groupBy("model").agg(F.sha2(F.concat(ids, F.lit("\n")), 256).alias("ids_sha256"), F.countDistinct("prompt_id").alias("prompts"))
