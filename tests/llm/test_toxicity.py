import zlib

import numpy as np

from gridlens.llm import toxicity

from .odd import SCHEMA, odd_documents


def brute_posteriors(emit, trans):
    """All labellings of one sequence."""
    n = len(emit)
    mass = np.zeros((n, 2))
    for code in range(2**n):
        y = [code >> k & 1 for k in range(n)]
        w = np.exp(sum(e for e, v in zip(emit, y, strict=True) if v) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        for k, v in enumerate(y):
            mass[k, v] += w
    return np.log(mass[:, 1] / mass[:, 0])


def test_forward_backward_matches_all_labellings():
    rng = np.random.default_rng(2)
    emit, trans, first = rng.normal(size=18), rng.normal(size=(2, 2)), np.array([0, 1, 7, 7, 16, 18])
    got = toxicity.ratios(emit, first, trans)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            assert np.allclose(got[a:b], brute_posteriors(emit[a:b], trans))


def test_held_out_accuracy_and_offsets(spark):
    data = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in toxicity.op4(spark, data).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    assert np.mean([p == t for p, t in held]) >= 0.93
    for r in rows.values():
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            assert texts[r.doc_id][a:b].split() and texts[r.doc_id][a:b] == texts[r.doc_id][a:b].strip()


def test_odd_rows(spark):
    crf = toxicity.fit([("a fine day\nin town", 0), ("you total idiot\nyes", 1)] * 6)
    out = toxicity.score(odd_documents(spark, ["é idiot"]), crf).collect()
    assert len(out) == odd_documents(spark).count() + 1 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(spark.createDataFrame([], SCHEMA), toxicity.fit([])).collect() == []


def test_long_texts_are_fitted_on(spark):
    texts = [(k, f"{'you idiot' if k % 2 else 'a fine day'} " * 2600, k % 2) for k in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    rows = toxicity.labelled_rows(frame, frame)
    assert len(rows) == 40 and all(len(t) > 20_000 for t, _ in rows)
    assert len(toxicity.labelled_rows(frame, frame, chars=30_000)) == 4  # two of each class pass the bound
    assert len(toxicity.labelled_rows(frame, frame, rows=5)) == 10


def test_query_matches_a_brute_force_field(spark):
    """Scores and spans of the query, from marginals summed over all labellings of each short line."""
    rows = [("a fine day\nin town we go", 0), ("you total idiot\nyes", 1), ("idiot said he\nwell", 1), ("the town is fine", 0)] * 6
    crf = toxicity.fit(rows)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows[:4])] + [(9, "")], "doc_id long, text string")
    for r in toxicity.score(docs, crf).collect():
        text = dict(docs.collect())[r.doc_id]
        marginals = []
        for line in text.split("\n"):
            w = line.split()
            emit = [crf.bias + sum(crf.weights[p] for p in toxicity.own_places(x)) + crf.weights[toxicity.near_place(w[k - 1], "<") if k else toxicity.place("<^")]
                    + crf.weights[toxicity.near_place(w[k + 1], ">") if k + 1 < len(w) else toxicity.place(">$")] for k, x in enumerate(w)]
            if w:
                marginals += (1 / (1 + np.exp(-brute_posteriors(np.array(emit), crf.trans)))).tolist()
        p = np.array(marginals)
        x = np.array([1, p.max(), np.log1p(p[p >= 0.5].sum())]) if len(p) else np.array([1, 0, 0])
        assert abs(r.score - 1 / (1 + np.exp(-x @ crf.document))) < 1e-9
        assert (r.spans != "") == bool((p >= 0.5).any())
