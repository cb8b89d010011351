"""Writers and renderers. Reports are small: they are formatted on the driver from tidy rows."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def sorted_keys(value: Column, kind: DataType) -> Column:
    """The value with the fields of structs and the keys of maps in order at every level."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[sorted_keys(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, MapType):
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), sorted_keys(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, by_key))
    return value


def write_canonical_json(df: DataFrame, path: str) -> None:
    """JSON lines, compact, keys in order at every level, nulls written; equal rows are equal bytes however their fields were
    arranged. Parts appear under their names when the job commits; a failed one leaves none."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    own = df.select(*[sorted_keys(df[f"`{f.name}`"], f.dataType).alias(f.name) for f in fields])
    own.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_delimited(df: DataFrame, path: str, fields: list[str], sep: str = ",", files: int | None = None) -> None:
    """Fields in their order, with a header in each part; files: how many parts, 1 for a report of bounded size."""
    own = df.select(*fields)
    (own.coalesce(files) if files else own).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_splits(rows: DataFrame, assignment: DataFrame, key: str, path: str) -> None:
    rows.join(assignment, key).write.mode("overwrite").partitionBy("split").parquet(path)


def splits_differ(spark, rows: DataFrame, assignment: DataFrame, key: str, path: str) -> DataFrame:
    """Rows that the written splits lack or have beyond what they should."""
    want = rows.join(assignment, key)
    have = spark.read.parquet(path).select(*[F.col(c).cast(want.schema[c].dataType) for c in want.columns])
    return want.exceptAll(have).withColumn("side", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("side", F.lit("extra")))


def number(value) -> str:
    return "N/A" if value is None else f"{value:.12g}" if isinstance(value, float) else str(value)


def percent(rate) -> str:
    return "N/A" if rate is None else f"{100 * rate:.2f}%"


#: Metric rows that are rendered at most; a report has a few dozen.
RENDERED = 10_000


def render(tidy: DataFrame, form: str = "text") -> str:
    """Tidy metric rows as text, markdown, csv or json; what is unavailable reads N/A, never 0. More than RENDERED is an error."""
    rows = [r.asDict() for r in tidy.select("section", "metric", "available", "count", "denominator", "rate").limit(RENDERED + 1).collect()]
    if len(rows) > RENDERED:
        raise ValueError(f"more than {RENDERED} rows to render")
    if form == "json":
        return json.dumps(rows, sort_keys=True, indent=2)
    cells = [[r["metric"], number(r["count"] if r["available"] else None), number(r["denominator"]), percent(r["rate"] if r["available"] else None)] for r in rows]
    head = ["metric", "count", "of", "rate"]
    if form == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([head, *cells])
        return out.getvalue()
    if form == "markdown":
        return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * 4, *cells]) + "\n"
    if form != "text":
        raise ValueError(f"unknown form {form}")
    width = [max(len(r[k]) for r in [head, *cells]) for k in range(4)]
    return "\n".join(" ".join([r[0].ljust(width[0]), *[r[k].rjust(width[k]) for k in (1, 2, 3)]]) for r in [head, *cells]) + "\n"
