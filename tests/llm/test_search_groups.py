"""Lexical search, embedding near-dedup and spelling variants, each beside a brute-force version."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.compare import connect, differences
from gridlens.llm import embed_dedup, lexical, spelling

from .odd import odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(lexical, "PART_DOCS", 3)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)


def test_search_over_odd_rows_is_that_of_scoring_all(spark, small_parts):
    docs = odd_documents(spark, ["quick fox", "Quick FOX fox", "über-fox_a1 a1", "A1\x00b 東京 fox", "the the the", "lazy lazy dog"])
    items = spark.createDataFrame([(1, "the quick fox"), (1, "lazy"), (2, None), (3, ""), (4, "nothing here matches zzz"), (None, "fox"), (5, "A1 東京 ÜBER über"), (6, "x" * 50_000), (7, "wörd7 of fox")], "item_id long, text string").withColumn("term", F.lit("clash")).withColumn("part", F.lit(1))
    own = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for k in (2, 50):
        got = sorted((tuple(r) for r in lexical.search(docs, items, k=k).collect()), key=str)
        assert got == brute_search(own, [tuple(r)[:2] for r in items.collect()], k)


def test_search_with_more_ties_than_ranks(spark, small_parts):
    docs = spark.createDataFrame([(900 - k, "copy of one text") for k in range(40)] + [(k, f"word{k % 7} text") for k in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one copy"), (2, "word3 text of")], "item_id long, text string")
    got = sorted((tuple(r) for r in lexical.search(docs.repartition(5), items, k=10).collect()), key=str)
    assert got == brute_search([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 10)


def test_bounds_hold_every_score():
    tf, n = np.meshgrid(np.arange(1, 400), np.array([1, 2, 50, 10_000, 10**7]))
    exact = lexical.impacts(tf.ravel(), n.ravel(), 1000, 90_000)
    byte = -(-exact // lexical.STEP)
    assert byte.max() <= 255 and (exact <= byte * lexical.STEP).all() and (exact > (byte - 1) * lexical.STEP).all()


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == []
    full = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lexical.search(full, items.where("false")).collect() == []
    assert lexical.search(full, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_queries_agree_with_sql(spark, data):
    assert differences(spark, connect(data), data, lexical.op11, lexical.OP11_SQL) == ""
    assert differences(spark, connect(data), data, embed_dedup.op12, embed_dedup.OP12_SQL) == ""


def brute_groups(rows, cosine):
    good = [k for k, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))
    count = [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for p, a in enumerate(good):
        for b in good[p + 1 :]:
            x, y = (np.array(rows[k][1], float) for k in (a, b))
            if len(x) == len(y) and x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= cosine:
                count[a] += 1
                count[b] += 1
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = []
    for own in groups.values():
        least = min((rows[k][0] for k in own if rows[k][0] is not None), default=None)
        out += [(rows[k][0], count[k], least, rows[k][0] == least) for k in own]
    return sorted(out, key=str)


def test_links_across_cells_and_blocks_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    monkeypatch.setattr(embed_dedup, "VISITORS", 5)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    near = [base[k % 40] + rng.normal(size=6) * s for k, s in zip(range(160), rng.uniform(0, 0.9, 160), strict=True)]
    hot = [base[0] + rng.normal(size=6) * 0.02 for _ in range(40)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(280), [*base, *near, *hot, *([base[1]] * 40)], strict=True)]
    rows += [(1000, None), (1001, [0.0] * 6), (1002, [math.nan] * 6), (1003, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0]), (None, rows[0][1]), (None, None), (rows[1][0], rows[1][1]), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, []), (1007, [None, 1.0])]
    for kind in ("float", "double"):
        vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("class", F.lit("clash")).withColumn("label", F.lit(None).cast("int"))
        for cell in (1000, 12):
            got = sorted((tuple(r) for r in embed_dedup.components(vectors, cell=cell).collect()), key=str)
            assert got == brute_groups(rows, 0.9)


def test_visits_reach_every_linked_pair():
    rng = np.random.default_rng(1)
    x = embed_dedup.unit(rng.normal(size=(600, 5)))
    home, visits = embed_dedup.assigned(x, embed_dedup.fit(x, 40), 0.9)
    i, j = np.nonzero(x @ x.T >= 0.9)
    apart = home[i] != home[j]
    assert apart.any() and (visits[i, home[j]] | visits[j, home[i]])[apart].all()


def test_spanning_links_connect_what_all_links_connect():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.02, 0.05, 0.6):
        mask = rng.random((30, 45)) < share
        i, j = embed_dedup.spanning(mask.copy())
        assert mask[i, j].all() and len(i) <= 75

        def groups(pairs):
            label = np.arange(75)
            for _ in range(75):
                for a, b in pairs:
                    label[[a, 30 + b]] = label[[a, 30 + b]].min()
            return label.tolist()

        assert groups(np.argwhere(mask)) == groups(list(zip(i, j, strict=True)))


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.components(none).collect() == []
    alone = embed_dedup.components(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, alone)) == [(1, 0, 1, True), (2, 0, 2, True)]


def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near, holes = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            if (less := w[:k] + w[k + 1 :]) in counts:
                near[w].add(less)
                near[less].add(w)
    for own in holes.values():
        for w in own:
            near[w] |= own - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def test_variants_of_odd_rows(spark):
    words = ["color colour colours coloured colouur", "Straße STRAßE strasse straße", "aaaaa aaaaaa aaaaaaa aaaaa", "naïve naive naıve", "ÀÉÎÕÜ ÀÉÎÕÜ àéîõü ×÷×÷×÷", "x" * 3000 + " " + "x" * 2999]
    docs = odd_documents(spark, words * 3 + ["colour aaaaa"] * 20)
    got = sorted(tuple(r) for r in spelling.variants(docs).collect())
    assert got == brute_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert spelling.variants(docs.where("false")).collect() == []


def test_variants_with_blocks_that_are_subdivided(spark):
    rng = np.random.default_rng(8)
    one = ["".join(rng.choice(list("abé"), rng.integers(4, 9))) for _ in range(700)]
    many = [w for w in one for _ in range(int(rng.integers(1, 9)))] + ["stem" + a + b for a in "abcdefgh" for b in "abcdefghij"] * 4
    rng.shuffle(many)
    docs = spark.createDataFrame([(k, " ".join(many[k * 50 : k * 50 + 50])) for k in range(len(many) // 50 + 1)], "doc_id long, text string")
    want = brute_variants([tuple(r) for r in docs.collect()])
    for block in (2, 48):
        assert sorted(tuple(r) for r in spelling.variants(docs, block=block).collect()) == want


def test_longest_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)], "word string, form string")
    assert {r[1] for r in spelling.rooted(forms).collect()} == {"w37"}
