"""Tokens, n-grams, normal forms and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import retrieval as R
from ..operators import ranking as K
from ..staging import settle
from . import fixtures as D
from .cells_queries import r6
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_SHORT = ", ".join(f"'{w}'" for w in X.SHORT_TOKENS)


def tok(text: str) -> str:
    for letter, word in X.GREEK:
        text = f"replace({text}, '{letter}', '{word}')"
    split = r"flatten(list_transform(regexp_extract_all(" + text + r", '[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?', 0), lambda w: string_split(lower(replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' ')), ' ')))"
    return f"list_filter({split}, lambda w: w <> '' AND w NOT IN ({_STOP}) AND (length(w) > 1 OR w IN ({_SHORT})))"


_WORDS = f"words AS (SELECT doc_id AS doc, {tok('text')} AS terms FROM documents)"


def _docs(spark, sf):
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), X.tokens(F.col("text")).alias("terms"), "lang", "source")


@query("tokenize_terms", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def _(spark, sf):
    t = D.table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


#: Characters of text that one task takes apart or whose n-grams it counts.
CHARS = 1 << 22


def _parts(spark, sf):
    """Parts by the size of the input."""
    chars = D.table(spark, sf, "documents").agg(F.sum("n_chars")).first()[0] or 0
    return max(8, chars // CHARS)


@query("word_ngrams", f"""WITH {_WORDS}, b AS (SELECT doc, unnest(list_transform(range(1, len(terms)), lambda i: terms[i] || '__' || terms[i + 1])) AS gram FROM words WHERE len(terms) > 1)
 SELECT gram, count(*) AS n FROM b GROUP BY gram""")
def _(spark, sf):
    grams = X.each_of(_docs(spark, sf), X.word_ngrams(F.col("terms")), "gram").where(F.col("gram").contains("__"))
    # parts by the input's size, so that the distinct n-grams of a task don't grow with it
    return grams.repartition(_parts(spark, sf), "gram").groupBy("gram").agg(F.count("*").alias("n"))


@query("char_ngrams", """WITH p AS (SELECT ' ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || ' ' AS t FROM benchmark), g AS (SELECT unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))))) AS gram FROM p)
 SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def _(spark, sf):
    grams = X.each_of(D.table(spark, sf, "benchmark"), X.char_ngrams(F.col("text")), "gram")
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("text_normalize_hash", r"""SELECT conv_id, turn, CASE WHEN t = '' THEN '' ELSE sha256(t) END AS digest, trim(regexp_replace(t, '\s+', ' ', 'g')) = t AS one_line FROM (
 SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\A\s+|\s+\z', '', 'g') AS t FROM conversations)""")
def _(spark, sf):
    t = D.table(spark, sf, "conversations").select("conv_id", "turn", X.normal_lines(F.col("text")).alias("t"))
    return t.select("conv_id", "turn", X.text_digest(F.col("t")).alias("digest"), (X.normal_code(F.col("t")) == F.col("t")).alias("one_line"))


_FAMILY = "[" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{k}' END" for k, p in X.FAMILIES.items()) + "]"


@query("family_labels_rollup", f"""WITH f AS (SELECT n_chars, unnest(CASE WHEN len(l) = 0 THEN ['{X.NO_FAMILY}'] ELSE l END) AS family FROM (SELECT n_chars, list_filter({_FAMILY}, lambda x: x IS NOT NULL) AS l FROM documents))
 SELECT family, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM f GROUP BY family""")
def _(spark, sf):
    out = X.each_of(D.table(spark, sf, "documents"), X.any_labels(F.col("text")), "family", "n_chars").groupBy("family")
    return r6(out.agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars")), "mean_chars")


# ------------------------------------------------------------------------------------------------------------- retrieval

_INDEX = f"""{_WORDS}, pos AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM words) GROUP BY 1, 2), dl AS (SELECT doc, sum(tf) AS dl FROM pos GROUP BY 1), dfs AS (SELECT term, count(*) AS df FROM pos GROUP BY 1),
 nd AS (SELECT (SELECT count(*) FROM words) AS n, (SELECT sum(tf) FROM pos) / (SELECT count(*) FROM words) AS avgdl), qs AS (SELECT item_id AS query, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY 1, 2)"""
_BM = """bm AS (SELECT query, doc, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qs JOIN dfs USING (term) JOIN pos USING (term) JOIN dl USING (doc), nd GROUP BY 1, 2)"""
_TF = """dwr AS (SELECT doc, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM pos JOIN dfs USING (term), nd), dn AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM dwr GROUP BY 1),
 qwr AS (SELECT query, term, (1 + ln(qtf)) * (ln((n + 1) / (df + 1)) + 1) AS qw FROM qs JOIN dfs USING (term), nd), qn AS (SELECT query, sqrt(sum(qw * qw)) AS qn FROM qwr GROUP BY 1),
 ti AS (SELECT query, doc, round(sum(qw / qn * w / norm), 9) AS score FROM qwr JOIN qn USING (query) JOIN dwr USING (term) JOIN dn USING (doc) GROUP BY 1, 2)"""
_TOP = "SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {}"


def _sources(spark, sf, kind):
    """Documents and items as bags of words, which are written, or of runs of characters."""
    docs, items = D.table(spark, sf, "documents"), D.table(spark, sf, "benchmark")
    if kind == "chars":
        return K.chars(docs, "doc_id", F.col("text")), K.chars(items, "item_id", F.col("text"))
    # a file is read by one task for each of its row groups, however many texts one holds
    docs = docs.select("doc_id", "text").repartition(_parts(spark, sf), "doc_id")
    return tuple(K.words(t, key, X.tokens(F.col("text"))) for t, key in ((docs, "doc_id"), (items, "item_id")))


def _ranked(spark, sf, methods, result):
    """result(the scores of each method) for each block of items, all together. methods: bm25, words, chars."""
    out, made = None, {}
    n = D.table(spark, sf, "documents").count()
    for kind in {"words" if m == "bm25" else m: None for m in methods}:
        docs, items = _sources(spark, sf, kind)
        made[kind] = (docs, settle(K.frequencies(docs), "df"), list(K.blocks(items)))
        if kind in methods and docs.written:
            made[kind] = (K.normed(docs, made[kind][1], n), *made[kind][1:])
    if "bm25" in methods:
        avgdl = (made["words"][0].frame.agg(F.sum("dl")).first()[0] or 0) / n if n else 0.0
    for k in range(len(next(iter(made.values()))[2])):
        scores = []
        for m in methods:
            docs, df, asked = made["words" if m == "bm25" else m]
            scores.append(K.bm25(docs, df, asked[k], n, avgdl) if m == "bm25" else K.tfidf(docs, df, asked[k], n))
        part = result(*scores)
        out = part if out is None else out.unionByName(part)
    return out


@query("bm25_topk", f"WITH {_INDEX}, {_BM} SELECT * FROM ({_TOP.format('bm')}) WHERE rank <= 10")
def _(spark, sf):
    return r6(_ranked(spark, sf, ["bm25"], lambda x: K.best(x, 10)), "score")


@query("tfidf_topk", f"WITH {_INDEX}, {_TF} SELECT * FROM ({_TOP.format('ti')}) WHERE rank <= 10")
def _(spark, sf):
    return r6(_ranked(spark, sf, ["words"], lambda x: K.best(x, 10)), "score")


_RRF = f"rb AS ({_TOP.format('bm')}), rt AS ({_TOP.format('ti')}), fu AS (SELECT query, doc, round(sum(s), 9) AS score FROM (SELECT query, doc, 1.0 / (60 + rank) AS s FROM rb UNION ALL SELECT query, doc, 1.0 / (60 + rank) FROM rt) GROUP BY 1, 2)"


@query("rrf_fusion", f"WITH {_INDEX}, {_BM}, {_TF}, {_RRF} SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM fu QUALIFY rank <= 10")
def _(spark, sf):
    return _ranked(spark, sf, ["bm25", "words"], lambda b, w: K.fused([(K.kept(b), 1.0), (K.kept(w), 1.0)], 10)).drop("score")


# By words twice and by runs of characters: three ranked lists and their fusion.
_CG = "flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))))"


def _padded(name, key, source):
    text = "text"
    for letter, word in X.GREEK:
        text = f"replace({text}, '{letter}', '{word}')"
    return f"{name} AS (SELECT {key}, ' ' || trim(regexp_replace(lower({text}), '\\s+', ' ', 'g')) || ' ' AS t FROM {source})"


_CHARS = f"""{_padded('gd', 'doc_id', 'documents')}, {_padded('gq', 'item_id', 'benchmark')}, cp AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({_CG}) AS term FROM gd) GROUP BY 1, 2),
 cq AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({_CG}) AS term FROM gq) GROUP BY 1, 2), cd AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM cp GROUP BY 1),
 cr AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM cp JOIN cd USING (term)), cl AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM cr GROUP BY 1), cw AS (SELECT query, term, (1 + ln(qtf)) * idf AS qw FROM cq JOIN cd USING (term)), cn AS (SELECT query, sqrt(sum(qw * qw)) AS qn FROM cw GROUP BY 1),
 ch AS (SELECT query, doc, round(sum(qw / qn * w / norm), 9) AS score FROM cw JOIN cn USING (query) JOIN cr USING (term) JOIN cl USING (doc) GROUP BY 1, 2)"""
_THREE = f"{_INDEX}, {_BM}, {_TF}, {_CHARS}"
_FUSED = " UNION ALL ".join(f"SELECT query, doc, {w} / (60 + rank) AS s FROM ({_TOP.format(t)})" for t, w in (("bm", "1.0"), ("ti", "1.0"), ("ch", "0.75")))
#: Weights of BM25, words and characters in the fusion.
FUSION = (1.0, 1.0, 0.75)


@query("three_way_fusion", f"WITH {_THREE} SELECT query, doc, rank FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(sum(s), 9) DESC, doc) AS rank FROM ({_FUSED}) GROUP BY query, doc) WHERE rank <= 5")
def _(spark, sf):
    return _ranked(spark, sf, ["bm25", "words", "chars"], lambda b, w, c: K.fused(list(zip((K.kept(b), K.kept(w), c), FUSION, strict=True)), 5)).drop("score")


#: Documents are dealt into so many parts by id; an item's target is the document of least hash in a part.
PARTS = 64
_TARGETS = "lt AS (SELECT doc % 64 AS part, arg_min(doc, sha256(CAST(doc AS VARCHAR))) AS target FROM words GROUP BY 1), tg AS (SELECT item_id AS query, target FROM benchmark JOIN lt ON part = (item_id * 31 + 7) % 64)"


def _targets(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"))
    least = docs.groupBy((F.col("doc") % PARTS).alias("part")).agg(F.min_by("doc", F.sha2(F.col("doc").cast("string"), 256)).alias("target"))
    items = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), ((F.col("item_id") * 31 + 7) % PARTS).alias("part"))
    return settle(items.join(least, "part").select("query", "target"), "targets")


def _ranks(scores, targets):
    return K.ranks(scores, targets.withColumnRenamed("target", "doc"), absent=True).select("query", "rank")


_EV = """SELECT {p} AS pos, '{n}' AS method, avg(CAST(rank <= 1 AS INT)) AS r1, avg(CAST(rank <= 5 AS INT)) AS r5, avg(1 / rank) AS mrr FROM (
 SELECT t.query, t.target, w.doc, row_number() OVER (PARTITION BY t.query ORDER BY coalesce(b.score, 0) DESC, w.doc) AS rank FROM tg t CROSS JOIN words w LEFT JOIN {t} b ON b.query = t.query AND b.doc = w.doc) WHERE doc = target"""


@query("best_fair_baseline", f"WITH {_THREE}, {_TARGETS}, ev AS ({' UNION ALL '.join(_EV.format(p=k, n=n, t=t) for k, (n, t) in enumerate((('bm25', 'bm'), ('words', 'ti'), ('characters', 'ch'))))}) SELECT method, round(r1, 6) AS r1, round(r5, 6) AS r5, round(mrr, 6) AS mrr FROM ev ORDER BY r1 DESC, r5 DESC, mrr DESC, pos LIMIT 1")
def _(spark, sf):
    targets, names = _targets(spark, sf), ("bm25", "words", "characters")

    def each(*scores):
        rows = [_ranks(x, targets).select(F.lit(k).alias("pos"), F.lit(names[k]).alias("method"), "rank") for k, x in enumerate(scores)]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])

    at = lambda k: F.avg((F.col("rank") <= k).cast("int"))
    found = _ranked(spark, sf, ["bm25", "words", "chars"], each)
    out = found.groupBy("pos", "method").agg(at(1).alias("r1"), at(5).alias("r5"), F.avg(1 / F.col("rank")).alias("mrr"))
    return r6(R.best(out, "r1", "r5", "mrr"), "r1", "r5", "mrr").select("method", "r1", "r5", "mrr")


def _target_ranks(spark, sf):
    targets = _targets(spark, sf)
    return _ranked(spark, sf, ["bm25"], lambda x: _ranks(x, targets))


_TRUE_RANK = f"""WITH {_INDEX}, {_BM}, {_TARGETS}, al AS (SELECT t.query, t.target, w.doc, coalesce(b.score, 0) AS score FROM tg t CROSS JOIN words w LEFT JOIN bm b ON b.query = t.query AND b.doc = w.doc),
 rk AS (SELECT query, doc, target, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM al), tr AS (SELECT query, rank FROM rk WHERE doc = target)"""


@query("target_ranks", f"{_TRUE_RANK} SELECT * FROM tr")
def _(spark, sf):
    return _target_ranks(spark, sf)


@query("retrieval_metrics", f"""{_TRUE_RANK} SELECT query % 2 AS half, count(*) AS n, round(avg(CAST(rank <= 1 AS INT)), 6) AS recall_1, round(avg(CAST(rank <= 5 AS INT)), 6) AS recall_5, round(avg(CAST(rank <= 10 AS INT)), 6) AS recall_10,
 round(avg(1 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank FROM tr GROUP BY 1""")
def _(spark, sf):
    out = R.rank_metrics(_target_ranks(spark, sf).withColumn("half", F.col("query") % 2), "half")
    return r6(out, "recall_1", "recall_5", "recall_10", "mrr", "mean_rank", "median_rank")


@query("nearest_copy", f"""WITH {_INDEX}, {_BM}, top AS (SELECT * FROM ({_TOP.format('bm')}) WHERE rank = 1) SELECT top.query, top.doc, md5(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) AS copied, position(trim(regexp_replace(b.text, '\\s+', ' ', 'g')) IN trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) > 0 AS holds_item
 FROM top JOIN documents d ON d.doc_id = top.doc JOIN benchmark b ON b.item_id = top.query""")
def _(spark, sf):
    text = D.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    items = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("item"))
    found = F.broadcast(_ranked(spark, sf, ["bm25"], lambda x: K.best(x, 1)).select("query", "doc")).join(text, "doc").join(items, "query")
    t, i = X.normal_code(F.col("text")), X.normal_code(F.col("item"))
    return found.select("query", "doc", F.md5(t).alias("copied"), F.contains(t, i).alias("holds_item"))
