import hashlib
import random
import re

from gridlens.llm import pii

from .odd import SCHEMA, odd_documents


def brute_base(text):
    def luhn(d):
        total = 0
        for k, c in enumerate(reversed(d)):
            v = int(c) * (2 if k % 2 else 1)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    only = lambda s: re.sub("[^0-9]", "", s)
    out = []
    for kind, pattern, fine in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(only(s)) <= 19 and luhn(only(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if fine(m[0])]
    return out


def check(rows, docs):
    got = []
    for r in rows:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE_KINDS]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in pii.BASE_KINDS]
        got.append((r.doc_id, base))
    assert sorted(got, key=repr) == sorted(((d, brute_base(t or "")) for d, t in docs), key=repr)


def test_query_matches_brute_force(spark, data):
    rows = pii.op6(spark, data).collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()])


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(4)
    texts = [
        "é a@b.c_d@e.f.. x@y @z a@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 1.2.3.x 99999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (988) 555-2485 +1+44 20 7946 0958. +12 ", "a@b" + ".c" * 5000, "1" * 20_000, "a" * 30_000 + "@b.c", "+1" + " " * 5000, "SSN 123-45-6789 IBAN DE89 3704 0044 0532 0130 00",
        *["".join(rng.choice(["a@b.co", "@", ".", "1", "12", "255", "+", "-", " ", "(", "é", "4111111111111111", "_"]) for _ in range(50)) for _ in range(60)],
    ]
    docs = odd_documents(spark, texts)
    monkeypatch.setattr(pii, "table", lambda *_: docs)
    rows = pii.op6(spark, "").collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert "ssn:4:15" in next(r.spans for r in rows if r.doc_id == 108)
    assert pii.scan(spark.createDataFrame([], SCHEMA))[0].collect() == []


def test_redact(spark):
    docs = odd_documents(spark, ["é mail me@x.org or +1 (988) 555-2485 now", "plain"])
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[100].text == "é mail <EMAIL> or <PHONE> now" and rows[100].n_chars == len(rows[100].text)
    assert rows[101].text == "plain" and rows[3].text is None and rows[2].n_chars is None
    assert pii.redact(docs).columns == docs.columns and len(rows) == docs.select("doc_id").distinct().count()


def test_plan_is_native(spark, data, capsys):
    pii.op6(spark, data).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_many_spans_in_one_text(spark):
    text = " ".join(f"a{k}@b.co, 10.0.0.{k % 256};" for k in range(1000))
    row = pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first()
    assert [f"{x.kind}:{x.start}:{x.end}" for x in row.spans] == brute_base(text)


def test_em_learns_who_is_right(spark):
    plain, odd = (1, 1, 1, 0, 2), (1, 3, 3, 4, 2)
    counts = [("email", plain, (1, 1, 1, 1), 900), ("email", odd, (-1, 0, 0, -1), 100), ("ssn", odd, (1, -1, 0, -1), 50), ("ssn", plain, (1, 1, 1, 1), 50)]
    model = pii.fit(counts)
    assert all(0.5 < a <= 1 for a, _ in model.reliability.values())
    score = lambda kind, shape, v: sum(model.weights.get(key, 0) for key in [("kind", kind), *zip(pii.SHAPES, shape, strict=True), *zip(pii.LABELERS, v, strict=True)])
    assert score("ssn", plain, (1, 1, 1, 1)) > 0 > score("email", odd, (-1, 0, 0, -1))
    # where no labeler has an opinion, the shape decides
    assert score("ssn", plain, (0, 0, 0, 0)) > score("ssn", odd, (0, 0, 0, 0))
    row = dict(zip([*pii.SHAPES, *pii.LABELERS], [*plain, 1, 1, 1, 1], strict=True)) | {"kind": "ssn"}
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([row], "kind string, " + ", ".join(f"{c} int" for c in [*pii.SHAPES, *pii.LABELERS])).select(F.struct("*").alias("x"))
    assert abs(frame.select(model.logit(F.col("x"))).first()[0] - score("ssn", plain, (1, 1, 1, 1))) < 1e-9
