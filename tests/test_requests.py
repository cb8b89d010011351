"""Manifests, requests and audits beside plain versions."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridlens.operators import requests as Q

MANIFEST = "row_id string, split string, group_id string, pos int"


def dumps(value):
    return json.dumps(value, ensure_ascii=True, sort_keys=True, separators=(",", ":"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows_take_split_and_place_from_a_manifest(spark):
    rows = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2"), ("d", "g3")], "row_id string, group_id string")
    fine = [("a", "train", "g1", None), ("b", "train", "", None), ("c", "test", None, 1), ("d", "test", "g3", 0)]
    out = Q.split_by_manifest(rows, spark.createDataFrame(fine, MANIFEST), "row_id", "group_id")
    assert sorted((r.row_id, r.split, r.pos) for r in out.collect()) == [("a", "train", None), ("b", "train", None), ("c", "test", 1), ("d", "test", 0)]
    bare = [(k, s, g, None) for k, s, g, _ in fine]
    assert Q.manifest_faults(rows, spark.createDataFrame(bare, MANIFEST), "row_id", "group_id").isEmpty()


@pytest.mark.parametrize(
    "wrong, fault",
    [
        ([("a", "holdout", "g1", None)], "no such split"), ([("", "train", "g1", None)], "no such split"), ([("a", None, "g1", None)], "no such split"), ([("a", "train", "g1", None)] * 2, "listed twice"), ([("x", "train", "", None), ("a", "train", "", None)], "not a row"),
        ([], "not listed"), ([("a", "train", "g9", None)], "other group"), ([("a", "validation", "g1", None)], "group in several splits"), ([("a", "train", "g1", 4)], "place outside test"),
    ],
)
def test_faults_of_a_manifest_are_named(spark, wrong, fault):
    rows = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2"), ("d", "g3")], "row_id string, group_id string")
    listed = spark.createDataFrame([*wrong, ("b", "train", "g1", None), ("c", "test", "g2", 0), ("d", "test", "g3", 1)], MANIFEST)
    assert fault in {r.fault for r in Q.manifest_faults(rows, listed, "row_id", "group_id").collect()}
    with pytest.raises(ValueError, match="differ"):
        Q.split_by_manifest(rows, listed, "row_id", "group_id")


def test_places_of_test_rows_are_whole_and_unique(spark):
    rows = spark.createDataFrame([("c", "g2"), ("d", "g3")], "row_id string, group_id string")
    faults = lambda *pos: {r.fault for r in Q.manifest_faults(rows, spark.createDataFrame([("c", "test", "g2", pos[0]), ("d", "test", "g3", pos[1])], MANIFEST), "row_id", "group_id").collect()}
    assert faults(0, None) == {"no place"}
    assert faults(1, 1) == {"place taken twice"}


TEXTS = ['say "hé" \\ \u001f\\u001F', "plain", "  漢 😀\n\ttwo\u007f ", ""]


def test_bodies_and_digests_are_those_of_canonical_json(spark):
    test = spark.createDataFrame([(f"r{k}", "strict", t, k) for k, t in enumerate(TEXTS)], "row_id string, label string, instruction string, pos int")
    targets = [("p", "é/m", "other", True), ("p", "a", Q.RESPONSES, True), ("p", "b", Q.MESSAGES, False), ("p", "c", Q.MESSAGES, True), ("p", "d", Q.CONTENTS, True), ("p", "e", Q.COMPLETION, True)]
    prompts = Q.prompt_records(test, "Be ünbiased.", "gen")
    out = Q.model_requests(prompts, spark.createDataFrame(targets, "provider string, model string, family string, sampling boolean"), temperature=0.0, top_p=0.95, max_tokens=64, effort="low", seed=3).collect()
    assert len(out) == len(TEXTS) * len(targets)
    for r in out:
        t, heat = TEXTS[r.pos], {"temperature": 0.0, "top_p": 0.95}
        messages = [{"role": "system", "content": "Be ünbiased."}, {"role": "user", "content": t}]
        prompt = "\n".join(["Be ünbiased.", "", Q.ABOVE, t.strip(), "", Q.BELOW])
        user = {"role": "user", "content": t}
        body = {
            Q.RESPONSES: {"model": r.model, "input": messages, "max_output_tokens": 64},
            Q.MESSAGES: {"model": r.model, "system": "Be ünbiased.", "messages": [user], "max_tokens": 64, "output_config": {"effort": "low"}, **(heat if r.model == "c" else {})},
            Q.CONTENTS: {"model": r.model, "system_instruction": {"parts": [{"text": "Be ünbiased."}]}, "contents": [{"role": "user", "parts": [{"text": t}]}], "generation_config": {**heat, "max_output_tokens": 64}},
            Q.COMPLETION: {"model": r.model, "prompt": prompt, "max_tokens": 64, **heat},
            "other": {"model": r.model, "messages": messages, "max_tokens": 64, "seed": 3, **heat},
        }[r.family]
        assert r.body == dumps(body)
        prompt_id = f"gen_{r.pos + 1:04d}"
        shown = {"prompt_id": prompt_id, "row_id": r.row_id, "prompt": prompt, "messages": messages}
        assert r.model_input_sha256 == sha(dumps(shown))
        assert r.prompt_record_sha256 == sha(dumps({**shown, "instruction": t, "label": "strict", "split": "test"}))
        assert r.request_sha256 == sha(dumps({"provider": "p", "api_model_id": r.model, "request_family": r.family, "body": body}))


ASKED = "model string, prompt_id string, request_sha256 string, model_input_sha256 string, prompt_record_sha256 string"
SAID = "model string, prompt_id string, at int, finish string, resolved string, request_sha256 string, model_input_sha256 string, prompt_record_sha256 string"


def test_audit_of_runs(spark):
    asked = [(m, p, f"r{p}", f"i{p}", f"p{p}") for m in ("whole", "torn", "silent") for p in "ab"]
    said = [("whole", p, 1, "stop", "v1", f"r{p}", f"i{p}", f"p{p}") for p in "ab"]
    said += [("torn", "a", 1, "stop", "v1", "ra", "other", None), ("torn", "a", 2, "Error", "v2", "ra", "ia", "pa"), ("torn", "z", 3, None, "", "rz", "iz", "pz"), ("stray", "a", 1, "stop", "v", "ra", "ia", "pa")]
    done = spark.createDataFrame([("whole", 2), ("torn", 2)], "model string, rows long")
    out = {r.model: r for r in Q.audit_runs(spark.createDataFrame(asked, ASKED), spark.createDataFrame(said, SAID), done, 2).collect()}
    assert set(out) == {"whole", "torn", "silent"}
    assert (out["whole"].status, out["whole"].finishes, out["whole"].resolved, out["whole"].mismatches) == ("complete", "stop:2", "v1", 0)
    t = out["torn"]
    assert (t.status, t.response_rows, t.answered, t.repeats, t.mismatches, t.errors, t.missing, t.finishes, t.resolved) == ("pending", 3, 2, 1, 3, 1, 1, "<missing>:1,Error:1", "v2")
    assert (out["silent"].status, out["silent"].answered, out["silent"].missing, out["silent"].finishes) == ("pending", 0, 2, "")
    few = Q.audit_runs(spark.createDataFrame(asked, ASKED), spark.createDataFrame(said, SAID), done, 3).collect()
    assert {r.status for r in few} == {"pending"}


def test_most_frequent_code_by_ties(spark):
    codes = ["b", "a", "c", "b", "a", None, None, None]
    train = spark.createDataFrame([(10 - k, c) for k, c in enumerate(codes)], "row_id int, code string")
    major = Q.majority_code(train, "code", "row_id")
    most = Counter(c for c in codes if c)
    assert [tuple(r) for r in major.collect()] == [(6, "a", most["a"])]
    test = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "row_id int, code string")
    assert sorted((r.row_id, r.exact) for r in Q.copied(test, "code", major).collect()) == [(1, True), (2, False), (3, False)]
    assert Q.majority_code(train.where(F.lit(False)), "code", "row_id").isEmpty()
