"""The in-flight marker as a stream, keys of nested bodies, canonical JSON and digests of files."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gridlens.operators import release
from gridlens.sources import readers, sinks
from gridlens.sources.file_digests import BLOCK
from gridlens.streaming import in_flight


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_open_attempts_become_uncertain_across_a_restart(spark, tmp_path):
    def arrive(n, rows):
        spark.createDataFrame(rows, in_flight.LOG).coalesce(1).write.parquet(f"{tmp_path}/log/{n}")

    def run():
        source = spark.readStream.schema(in_flight.LOG).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")
        q = in_flight.uncertain(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r.prompt_id, r.attempt, r.started, r.status, r.reason) for r in spark.read.schema(in_flight.OUT).parquet(f"{tmp_path}/out").collect())

    arrive(1, [(1, 1, "start", at(0)), (1, 1, "end", at(2)), (2, 1, "start", at(0)), (3, 1, "start", at(1)), (4, 1, "start", at(0)), (4, 2, "start", at(3)), (5, None, "start", at(1)), (None, 1, "start", at(1)), (6, 1, "end", at(1))])
    first = (4, 1, at(0), in_flight.UNCERTAIN, "another attempt started")
    assert run() == [first]
    arrive(2, [(3, 1, "acknowledge", at(20)), (2, 1, "start", at(0)), (4, 2, "end", at(30)), (7, 1, "start", at(60))])
    assert run() == [first]
    arrive(3, [(8, 1, "start", at(100))])  # the watermark passes the hour of prompt 2 only
    run()
    arrive(4, [(9, 1, "start", at(101))])
    late = (2, 1, at(0), in_flight.UNCERTAIN, "timeout")
    assert run() == sorted([first, late])
    held = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/check")
    assert sorted(r[0][0] for r in held.select("key").collect()) == [7, 8, 9]


@pytest.mark.parametrize("depth", [1, 9, 50])
def test_sensitive_names_at_any_depth(spark, depth):
    body = {"token": 1}
    path = "token"
    for k in range(depth):
        body, path = ({f"k{k}": body}, f"k{k}.{path}") if k % 2 else ({"l": [0, body]}, f"l[1].{path}")
    rows = [(1, json.dumps(body)), (2, json.dumps([body, [{"api_key": None}]])), (3, None), (4, "no json"), (5, '"token"'), (6, '{"text": "{\\"token\\": 1}", "tokens": 1}'), (7, "{}"), (8, '{"a.b": {"x-secret": []}}')]
    got = release.sensitive_keys(spark.createDataFrame(rows, "id long, body string"), "id", F.col("body")).collect()
    assert sorted(map(tuple, got)) == sorted([(1, path), (2, f"[0].{path}"), (2, "[1][0].api_key"), (8, "a.b.x-secret")])


def test_canonical_json_is_the_same_however_fields_are_arranged(spark, tmp_path):
    a = spark.sql("SELECT 1 AS b, named_struct('y', array(named_struct('q', 1, 'p', map('k2', 1, 'k1', null))), 'x', null) AS a, cast(null AS struct<v:int,u:int>) AS c")
    b = spark.sql("SELECT cast(null AS struct<u:int,v:int>) AS c, named_struct('x', null, 'y', array(named_struct('p', map('k1', null, 'k2', 1), 'q', 1))) AS a, 1 AS b")
    text = []
    for k, df in enumerate((a, b)):
        sinks.write_canonical_json(df, f"{tmp_path}/{k}")
        text.append("\n".join(r[0] for r in spark.read.text(f"{tmp_path}/{k}").collect()))
    assert text[0] == text[1] == '{"a":{"x":null,"y":[{"p":{"k1":null,"k2":1},"q":1}]},"b":1,"c":null}'


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_canonical_json(bad, f"{tmp_path}/out")
    assert not [p for p in (tmp_path / "out").rglob("part-*") if p.is_file()] if (tmp_path / "out").exists() else True


def test_digests_of_a_folder(spark, tmp_path):
    files = {"a.bin": b"", "deep/er/b.bin": b"x" * (2 * BLOCK + 7), "deep/c d.txt": "é".encode()}
    for name, data in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    want = sorted((n, len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items())
    for folder in (f"{tmp_path}/in", f"file://{tmp_path}/in/"):
        found = readers.digests(spark, folder)
        assert sorted(map(tuple, found.collect())) == want
    root = readers.inventory_root(found)
    assert root == readers.inventory_root(found.repartition(3))
    listed = spark.createDataFrame(want, "path string, bytes long, sha256 string")
    assert readers.verify(listed, found).collect() == []
    (tmp_path / "in/deep/er/b.bin").write_bytes(b"x" * (2 * BLOCK + 6) + b"y")
    changed = readers.digests(spark, f"{tmp_path}/in")
    assert readers.inventory_root(changed) != root
    assert [tuple(r) for r in readers.verify(listed, changed).collect()] == [("deep/er/b.bin", "content")]
    (tmp_path / "none").mkdir()
    assert readers.digests(spark, f"{tmp_path}/none").collect() == [] and readers.inventory_root(readers.digests(spark, f"{tmp_path}/none")) == hashlib.sha256(b"").hexdigest()


def test_settled_tables_are_deleted_once_results_are_stored(spark):
    import os

    from gridlens import staging

    folder = staging.shared_folder(spark).removeprefix("file://")
    staging.clear(spark)
    before = set(os.listdir(folder))
    kept = staging.settle(spark.range(5), "numbers")
    assert kept.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    assert staging.clear(spark) == 1 and set(os.listdir(folder)) == before and staging.clear(spark) == 0
