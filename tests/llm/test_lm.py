import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from gridlens.llm import lm

from .odd import SCHEMA, odd_documents


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(docs):
    counts = Counter()
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    for d, t in docs:
        if not out(d):
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    return Counter((d, out(d), len(w := words(t)), sum(counts[x] > 0 for x in w), n, round(sum(log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in docs)


def rows_of(frame):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in frame)


def test_query_matches_brute_force(spark, data):
    rows = lm.op5(spark, data).collect()
    assert rows_of(rows) == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()])
    assert all(r.score <= 0 for r in rows)
    base, own = (sum(getattr(r, c) for r in rows if r.held_out) for c in ("base_score", "score"))
    assert own > 0.95 * base  # both are negative: the model says more than single words do by a twentieth


@pytest.mark.parametrize("hot", [0, 3, 1 << 19])
def test_odd_rows_and_rare_words(spark, tmp_path, hot, monkeypatch):
    docs = odd_documents(spark, ["A a B", "zz zz zz Zz", "é É"])
    monkeypatch.setattr(lm, "table", lambda *_: docs)
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda d: fit(d, hot_words=hot))
    assert rows_of(lm.op5(spark, "").collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    model = lm.fit(docs.select("text"))
    assert lm.score(docs, model).collect() == [] and model.tokens == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    rows = [(" ".join(f"w{k}" for k in range(j, 3000, 2**j)),) for j in range(6)]
    model = lm.fit(spark.createDataFrame(rows, "text string"))
    tokens = [t for (r,) in rows for t in words(r)]
    counts = Counter(t for t in tokens if t)
    h = np.array([lm.hash_words(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in counts], np.uint64)
    true = lm.levels(np.array(list(counts.values())), 1)
    got = model.filter.level(h)
    assert (got >= true).all() and (got == true).mean() > 0.97
    other = lm.mix(np.arange(20_000, dtype=np.uint64))
    assert (model.filter.level(other) > 0).mean() < 0.03


@pytest.mark.parametrize("segments", [1, 8])
def test_counts_are_read_back(segments):
    rng = np.random.default_rng(segments)
    h = np.unique(lm.mix(np.arange(2000, dtype=np.uint64)))
    n = rng.choice([1, 1, 1, 2, 70_000], len(h))
    for uni in (True, False):
        batch = lm.counted(h, n, uni, segments)
        got_h, got_n = lm.read_counted(uni, batch.column(2), batch.column(3))
        got = sorted(zip(got_h.tolist(), got_n.tolist(), strict=True))
        assert got == sorted(zip((h if uni else h & lm.KEY).tolist(), n.tolist(), strict=True))


def test_score_matches_exact_counts(spark):
    """With a filter that errs nowhere, every score is the formula's on exact counts in levels."""
    texts = [(1, "a b a b c"), (2, "b c"), (3, "a b c d e"), (3, "a b c d e"), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = lm.fit(docs.select("text"), hot_words=2)
    one, two = Counter(), Counter()
    begin = object()
    for _, t in texts:
        w = words(t)
        one.update(w)
        two.update(zip([begin, *w], w, strict=False))
    level = lambda c: lm.represented(1)[lm.levels(np.array([c]), 1)[0]]
    total, distinct = sum(one.values()), len(one)
    want = Counter()
    for d, t in texts:
        w, out = words(t), 0.0
        for a, b in zip([begin, *w], w, strict=False):
            context, alone = level(one[None] if a is begin else one[a]), level(one[b])
            both = min(level(two[a, b]), alone, context)
            out += log10(min(1.0, (both + lm.MU * (alone + 1) / (total + distinct + 1)) / (max(context, both) + lm.MU)))
        want[d, round(out, 6)] += 1
    assert Counter((r.doc_id, round(r.score, 6)) for r in lm.score(docs, model).collect()) == want


def test_no_word_spans_rows():
    import pyarrow as pa

    tokens, first = lm.token_stream(pa.array(["ab", "cd", None, "", "ab cd"]))
    assert first.tolist() == [0, 2, 4, 5, 6, 9]
    assert tokens[0] == tokens[6] and tokens[2] == tokens[7] and tokens[4] == lm.END


def test_filter_that_is_not_broadcast_scores_alike(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = docs.select(lm.text_or_empty().alias("text"))
    small, large = lm.fit(texts, hot_words=100), lm.fit(texts, max_bits=1 << 12, hot_words=100)
    assert small.filter and not large.filter
    want, got = (sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, m).collect()) for m in (small, large))
    assert got == want
    assert lm.score(docs.limit(0), large).collect() == []


def test_every_pair_is_entered_at_any_size(spark):
    rows = [(" ".join(f"w{j * 400 + k}" for k in range(400)),) for j in range(10)]
    model = lm.fit(spark.createDataFrame(rows, "text string"), max_bits=1 << 12)
    known = spark.createDataFrame([(1, "w7 w8"), (2, "w8 w7")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in lm.score(known, model).collect()}
    assert scores[1] > scores[2]  # the pair was seen once
