"""Readers: JSON lines with places of errors, report folders, CSV, manifests with digests, batch outputs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import require_empty
from .file_digests import FileDigests


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, check: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, and a line that is no object is an error that names file and line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    whole = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*whole.fields, T.StructField("_corrupt", T.StringType())])
    rows = lines.select("file", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value")
    if check:
        bad = rows.where(F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~F.ltrim("value").startswith("{"))
        if (first := bad.select("file", "value").first()) is not None:  # only now is that file read again, to number its lines
            numbered = spark.read.option("wholetext", True).text(first.file).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "text"))
            require_empty(numbered.where(F.col("text") == first.value).select(F.concat(F.lit(f"{first.file}:"), F.col("at") + 1).alias("at"), F.substring("text", 1, 80).alias("line")), "not a JSON object")
    return rows.select(*[F.col(f"r.{f.name}") for f in whole.fields])


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one row of a file that is a JSON object; anything else is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if rows.count() != 1:
        raise ValueError(f"{path} isn't one JSON object")
    return rows


#: A harness report: what an execution did and how its structure compares.
REPORT = "records array<struct<prompt_id string, execution struct<execution_success boolean, circuit_found boolean, error_type string, qasm3_export struct<success boolean>>, structural_checks struct<all_match boolean, ordered_match boolean, parameter_match boolean>>>"


def reports(spark: SparkSession, folder: str, models: dict[str, str] | None = None) -> DataFrame:
    """One row per record of folder/<model>/report.json; the model is the folder's name, or what models says for it, and then
    folders that it doesn't name are skipped."""
    read = spark.read.schema(REPORT).option("multiLine", True).json(f"{folder}/*/report.json")
    model = F.regexp_extract("_metadata.file_path", r"([^/]+)/report\.json(?:/[^/]+)?$", 1)
    if models is not None:  # a panel's models
        named = F.create_map(*[F.lit(x) for kv in models.items() for x in kv]) if models else F.create_map().cast("map<string,string>")
        model = F.try_element_at(named, model)
    named = read.select(model.alias("model"), "records").where("model is not null")
    return named.select("model", F.explode("records").alias("r")).select("model", "r.*")


def report_cells(records: DataFrame) -> DataFrame:
    """Evaluation cells of harness records: a run counts as executed only if a circuit was found, and nothing counts without it."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    e = yes("execution.execution_success") & yes("execution.circuit_found")
    m = e & yes("structural_checks.all_match")
    o = m & yes("structural_checks.ordered_match")
    return records.select(
        "model", "prompt_id", e.alias("execution"), (e & yes("execution.qasm3_export.success")).alias("assembly"), m.alias("signature"), o.alias("ordered"), (o & yes("structural_checks.parameter_match")).alias("parameter"), F.col("execution.error_type").alias("error_type"),
    )


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) from a TSV with exactly that header; paths must be relative, inside, and unique."""
    rows = spark.read.schema("path string, bytes long, sha256 string").option("header", True).option("sep", "\t").option("enforceSchema", False).csv(path)
    bad = F.col("path").isNull() | F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..") | F.col("bytes").isNull() | ~F.col("sha256").rlike("^[0-9a-f]{64}$")
    require_empty(rows.where(bad), "unsafe or malformed manifest row")
    require_empty(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "path listed twice")
    return rows


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, of any size: files are read in blocks, each by one task."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").load(folder)


def inventory_root(found: DataFrame) -> str:
    """One digest for (path, bytes, sha256) of any number of files: of each file's line, of the lines that share three, two and
    one hexadecimal digits of theirs, and of these. It changes with any path, size or content; no task sees all lines."""
    nodes = found.select(F.sha2(F.concat_ws("\0", "path", F.col("bytes").cast("string"), "sha256"), 256).alias("node"), F.sha2("path", 256).alias("name"))
    for digits in (3, 2, 1, 0):
        lines = F.array_sort(F.collect_list(F.struct("name", "node")))
        grouped = nodes.groupBy(F.substring("name", 1, digits).alias("name")).agg(lines.alias("lines"))
        nodes = grouped.select("name", F.sha2(F.array_join(F.transform("lines", lambda x: F.concat_ws("\0", x["name"], x["node"])), "\n"), 256).alias("node"))
    first = nodes.first()
    return first.node if first else hashlib.sha256(b"").hexdigest()


def verify(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, fault) of listed files that are missing, of another size, or of another content; the first that applies."""
    f = found.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    fault = F.when(F.col("b").isNull(), "missing").when(F.col("b") != F.col("bytes"), "size").when(F.col("s") != F.col("sha256"), "content")
    return listed.join(f, "path", "left").select("path", fault.alias("fault")).where("fault is not null")


BATCH = "custom_id string, error struct<message string>, response struct<status_code int, body struct<model string, status string, output array<struct<type string, content array<struct<type string, text string>>>>, error struct<message string>, usage struct<input_tokens long, prompt_tokens long, output_tokens long, completion_tokens long>>>"


def batch_responses(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request with its batch output: text parts joined, the first error that applies, tokens; none where there was no line."""
    r = lines.select(F.element_at(F.split("custom_id", "::"), -1).alias("prompt_id"), "error", "response")
    parts = F.flatten(F.transform(F.col("response.body.output"), lambda o: F.filter(o["content"], lambda c: c["text"].isNotNull())))
    error = F.coalesce("error.message", "response.body.error.message", F.when(F.col("response.status_code") >= 400, F.concat(F.lit("status "), F.col("response.status_code"))))
    out = r.select(
        "prompt_id", F.array_join(F.transform(parts, lambda c: c["text"]), "").alias("text"), error.alias("error"), F.col("response.body.model").alias("model"), F.coalesce("response.body.status", F.lit("unknown")).alias("finish"),
        F.coalesce("response.body.usage.input_tokens", "response.body.usage.prompt_tokens").alias("tokens_in"), F.coalesce("response.body.usage.output_tokens", "response.body.usage.completion_tokens").alias("tokens_out"),
    )
    return requests.join(out, "prompt_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("model").isNull(), "no response")))
