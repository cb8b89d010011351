import re

import numpy as np

import corpus_pipeline
from gridlens.llm import decontaminate, packing, pii, quality

from .odd import odd_documents
from .test_dedup_leaks_quality import brute_components, tokens
from .test_packing import TOKENIZER, brute_pieces, check_layout
from .test_pii import brute_base


def leaks(doc, item):
    """Whether a window of the item lies in the document at some shift, by trying all shifts."""
    window = min(decontaminate.WINDOW, len(item))
    need = decontaminate.least_agreeing(window)
    if not item or sum(t in set(doc) for t in item) < need:
        return False
    a, b = np.array(doc, object), np.array(item, object)
    for shift in range(window - len(b), len(a) - window + 1):
        low, high = max(0, -shift), min(len(b), len(a) - shift)
        same = np.concatenate([[0], np.cumsum(a[low + shift : high + shift] == b[low:high])])
        if len(same) > window and (same[window:] - same[:-window]).max() >= need:
            return True
    return False


def redacted(text):
    spans = sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in brute_base(text))
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_each_stage_matches_brute_force(spark, data):
    table = lambda name: spark.read.parquet(f"{data}/{name}.parquet")
    docs = table("documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "personal_data", "best_fit_packing"]
    items = [tokens(r.text) for r in table("benchmark").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage_table(stage(spark, docs, data), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == table("documents").columns and docs.count() == len(after)
        if name == "quality_classifier":
            kept = {r.doc_id for r in quality.score(table("documents"), table("labels").select("doc_id", "quality")).collect() if r.keep}
            bad = {r.doc_id for r in table("labels").collect() if r.quality == 0}
            good = {r.doc_id for r in table("labels").collect() if r.quality == 1}
            assert set(after) == kept and len(good - kept) <= 0.05 * len(good) and len(bad & kept) <= 0.1 * len(bad) + 1
        elif name == "simhash_near_dedup":
            assert set(after) == {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before.values()])}
        elif name == "benchmark_decontamination":
            assert set(after) == {d for d, r in before.items() if not any(leaks(tokens(r.text), i) for i in items)}
        else:
            extra = re.compile("|".join(f"(?:{p})" for k, p in pii.PATTERNS.items() if k in pii.MORE_KINDS).replace(r"\x20", " "))
            for d, r in before.items():
                if not extra.search(r.text):
                    assert after[d].text == redacted(r.text)
                assert after[d].n_chars == (len(after[d].text) if after[d].text != r.text else r.n_chars)
            assert set(after) == set(before)
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    got = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows}
    assert got == set(brute_pieces([(r.doc_id, r.text) for r in before.values()])) and TOKENIZER == packing.default_tokenizer()
    check_layout(rows, 4096)


def test_odd_rows_and_an_empty_table(spark, data, tmp_path):
    odd = odd_documents(spark, ["mail me@x.org now", "plain words"])
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{data}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        frame, kept = spark.read.parquet(f"{folder}/documents.parquet"), None
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.stage_table(stage(spark, frame if kept is None else kept, folder), stage_name)
            assert kept.columns == docs.columns
        rows = corpus_pipeline.run(spark, folder).collect()
        want = brute_pieces([(r.doc_id, r.text) for r in kept.collect()])
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
        check_layout(rows, 4096)
