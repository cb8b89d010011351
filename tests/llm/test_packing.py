import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridlens.llm import packing

from .odd import SCHEMA, odd_documents

TOKENIZER = packing.default_tokenizer()


def check_layout(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def brute_pieces(docs, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    out = Counter()
    for doc, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out[doc, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    return out


def test_query_matches_brute_force(spark, data):
    rows = packing.op2(spark, data).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pieces(docs)
    bins = check_layout(rows, 4096)
    assert bins <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1


def test_odd_rows(spark):
    odd = ["I'm you'll DON'T's <|endoftext|> x", "naïve ŒUVRE ǅ İstanbul Σας", "a\x1cb c", "日本語 ½ ² x²", "'s 'S it's5", "éa  b", "ﬁn", "«¿hola?» — “x”…", "ẞß ÿŸ", "12ab!?c--d_e​f"]
    docs = odd_documents(spark, odd)
    rows = packing.pack(docs, TOKENIZER, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pieces([(r.doc_id, r.text) for r in docs.collect()])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    check_layout(rows, 4096)


def test_empty_table(spark):
    rows = packing.pack(spark.createDataFrame([], SCHEMA), TOKENIZER)
    assert rows.collect() == [] and {"sequence_id", "offset"} <= set(rows.columns)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_all_and_beats_first_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 512, 4096])
    lengths = [min(capacity, max(1, int(rng.lognormvariate(rng.uniform(1, 7), 1)))) for _ in range(rng.randint(1, 3000))]
    if seed % 3 == 0:
        lengths += [capacity // 3] * 2000  # a length that most pieces share
    histogram = Counter(lengths)
    plan = packing.best_plan(histogram, capacity)
    placed = Counter()
    for kind in plan.done:
        at = 0
        for n, _, k, offset in kind.items:
            assert offset == at
            at += n * k
            placed[n] += k * kind.bins
        assert at + kind.room == capacity and kind.room >= 0
    assert placed == histogram
    bins = []
    for n in sorted(lengths, reverse=True):
        for k, room in enumerate(bins):
            if room >= n:
                bins[k] -= n
                break
        else:
            bins.append(capacity - n)
    assert plan.bins <= 1.03 * len(bins) + 2


def test_hot_length_is_ranked_in_buckets(spark):
    parts = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, 7L, id % 50 + 1) as length", "7L as ids_crc32", "id as row")
    rows = packing.packed(parts, capacity=64, rows_per_bucket=100).collect()
    assert len(rows) == 5000
    check_layout(rows, 64)
