import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridlens.llm import common, decontaminate, quality, simhash

from .odd import SCHEMA, odd_documents


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(docs, max_bits=4):
    fps = [brute_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j in itertools.combinations(range(len(docs)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= max_bits:
            root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, f"{f:016x}", least.get(find(k))) for k, ((d, _), f) in enumerate(zip(docs, fps, strict=True))), key=repr)


def test_simhash_query_matches_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in simhash.op9(spark, data).collect()), key=repr) == brute_components(docs)


def test_simhash_odd_rows(spark):
    docs = odd_documents(spark, ["one", "one two", "a b c d", "A B C D"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in simhash.components(docs).collect()), key=repr) == brute_components(rows)
    assert simhash.components(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted({c for _, _, c in brute_components(rows) if c})
    assert [r.doc_id for r in kept.collect()].count(None) == 1


@pytest.mark.parametrize("block, wide", [(2, False), (5, True), (2048, False)])
def test_links_lose_no_component(spark, block, wide):
    rng = random.Random(block)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    for _ in range(10):  # chains
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), 4))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block, wide=wide)
    roots = dict(common.connected_components(got).collect())
    neighbours = {x: {y for y in fps if (x ^ y).bit_count() <= 4} for x in fps}
    signed_of = lambda x: x - (1 << 64) if x >> 63 else x
    for x, near in neighbours.items():
        for y in near - {x}:
            assert roots[signed_of(x)] == roots[signed_of(y)]
    seen = set()
    for x in fps:
        if x not in seen:
            part, queue = {x}, [x]
            while queue:
                for y in neighbours[queue.pop()] - part:
                    part.add(y)
                    queue.append(y)
            seen |= part
            assert len({roots.get(signed_of(y), signed_of(y)) for y in part}) == 1
            assert roots.get(signed_of(x), signed_of(x)) == min(map(signed_of, part))


def test_key_positions_cover_the_minimum():
    keys = simhash.key_positions(4)
    assert len(keys) == len(set(keys)) == 20
    assert all(any(set(k) <= set(four) for k in keys) for four in itertools.combinations(range(8), 4))
    assert len(simhash.key_positions(4, wide=True)) == 70


def test_rows_that_share_an_id_are_looked_at_one_by_one(spark):
    near = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, near), (1, "a text of its own that is like no other one here"), (2, near), (None, near), (None, "alone"), (None, "alone")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(docs).collect()) == [(0, "alone"), (1, "a text of its own that is like no other one here"), (1, near)]


def test_blocks_of_a_long_text(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(500)) + " " + "x" * 300 + "  y"
    whole = simhash.fingerprint(text.encode(), 4)
    assert whole == brute_fingerprint(text)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(simhash, "BLOCK", size)
        assert b"".join(simhash.blocks_of(text.encode())) == text.encode()
        assert simhash.fingerprint(text.encode(), 4) == whole


# ------------------------------------------------------------------------------------------------------- decontamination


def brute_overlap(doc, item):
    """(first token, tokens, agreeing) of the window with most agreeing tokens, the first of these, at any shift; or None."""
    window = min(20, len(item))
    need = window if window < 8 else np.ceil(0.8 * window - 1e-9)
    best = None
    for shift in range(-len(item), len(doc)) if item else ():
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        same = [doc[j + shift] == item[j] for j in range(a, b)]
        for k in range(len(same) - window + 1):
            if (n := sum(same[k : k + window])) >= need:
                best = max(best or (0, 0), (n, -(a + shift + k)))
    return best and (-best[1], window, best[0])


def tokens(text):
    import re

    return re.findall(r"[\u3000-\u9fff]|[a-z0-9\x80-\u2fff\ua000-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)] + ["the"] * 30
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([5, 8, 9, 10, 12, 15, 16, 18, 20, 33, 50])]
    items += [(90, None), (91, ""), (92, "Straße über, alles! wird gut; so oder so eben"), (93, "w1 w2"), (94, "seven words that are only here once"), (95, "東京都は日本の首都である"), (96, "?!")]
    items += [(97, "twice " * 8), (97, "the same id once more but other words here")]
    docs = [(999, "東京都は日本の首部である。"), (998, "x seven words that are only here once"), (997, "seven words that are only here twice"), (996, "twice " * 30)]
    for k in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if k % 2:
            own = tokens(rng.choice(items)[1])
            for j in range(len(own)):
                if rng.random() < 0.17:
                    own[j] = "other"
            text[10:10] = own[rng.randint(0, 4) :]
        docs.append((1000 + k, ", ".join(text).upper() if k % 3 == 0 else " ".join(text)))
    frame = odd_documents(spark, [t for _, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = sorted(tuple(r) for r in decontaminate.overlaps(frame, bench).collect())
    best = {}
    for n, r in enumerate(frame.collect()):
        for i, t in items:
            if over := brute_overlap(tokens(r.text), tokens(t)):
                best[n, r.doc_id, i] = max(best.get((n, r.doc_id, i), over), over, key=lambda o: (o[2], -o[0]))
    want = sorted((d, i, *over) for (_, d, i), over in best.items())
    assert got == want and len(want) > 20
    clean = decontaminate.remove_contaminated(frame, bench)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in frame.collect()} - {d for d, *_ in want}
    assert decontaminate.remove_contaminated(frame, bench.limit(0)).count() == frame.count()
    assert decontaminate.remove_contaminated(frame.limit(0), bench).count() == 0


def test_filter_that_lets_all_pass_loses_nothing(spark, monkeypatch, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(tuple(r) for r in decontaminate.overlaps(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 15)
    got = sorted(tuple(r) for r in decontaminate.overlaps(docs, bench).collect())
    assert got == want and want


def test_decontamination_query_matches_brute_force(spark, data):
    items = [(r.item_id, tokens(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = []
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        doc = tokens(r.text)
        have = set(doc)
        for i, t in items:
            if sum(x in have for x in t) >= 0.8 * min(20, len(t)) - 1e-9 and (over := brute_overlap(doc, t)):
                want.append((r.doc_id, i, *over))
    assert sorted(tuple(r) for r in decontaminate.op8(spark, data).collect()) == sorted(want) and want


@pytest.mark.parametrize("masks, cases", [(decontaminate.SHORT_MASKS, [(n, int(n * 0.2 + 1e-9)) for n in range(8, 16)]), (decontaminate.LONG_MASKS, [(n, int(n * 0.2 + 1e-9)) for n in range(16, 21)])])
def test_masks_hit_every_tolerated_window(masks, cases):
    for size, wrong in cases:
        places = [sum(1 << (at + i) for i, c in enumerate(m) if c == "1") for m in masks for at in range(size - len(m) + 1)]
        for bad in itertools.combinations(range(size), wrong):
            b = sum(1 << i for i in bad)
            assert any(not p & b for p in places)


# ----------------------------------------------------------------------------------------------------------------- quality


def test_quality_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 4 <> 0").select("doc_id", "quality")
    got = {r.doc_id: r for r in quality.score(docs, known).collect()}
    assert len(got) == docs.count()
    rest = [(got[r.doc_id].keep, r.quality) for r in labels.where("doc_id % 4 = 0").collect()]
    assert np.mean([keep == bool(q) for keep, q in rest]) >= 0.97
    kept = {r.doc_id for r in quality.keep_good(docs, known).collect()}
    assert kept == {d for d, r in got.items() if r.keep}


def test_quality_odd_rows(spark):
    docs = odd_documents(spark, ["clean words in a row, one after another. nothing odd here."] * 3)
    for labels in ("doc_id long, quality int", [(1, 1), (4, 0), (6, 0), (None, 1), (5, None), (100, 1), (101, 1)]):
        rows = spark.createDataFrame([] if isinstance(labels, str) else labels, "doc_id long, quality int")
        out = quality.score(docs, rows).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
        kept = quality.keep_good(docs, rows)
        assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in out)
        if isinstance(labels, str):
            assert {r.score for r in out} == {0.5}
    assert quality.score(docs.limit(0), rows).collect() == []
