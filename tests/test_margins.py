"""Margins over many equal rows, beside SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridlens.compare import differences
from gridlens.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def copies(spark, data, tmp_path_factory):
    """Line items 400 times, with shifted keys."""
    folder = str(tmp_path_factory.mktemp("copies"))
    rows = spark.read.parquet(f"{data}/lineitem.parquet")
    shift = rows.agg(F.max("l_orderkey")).first()[0] * 5  # keeps what is test
    rows.crossJoin(spark.range(400)).withColumn("l_orderkey", F.col("l_orderkey") + F.col("id") * shift).drop("id").write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["stress_margins", "false_positive_by_slice"])
def test_margins_of_many_equal_rows_agree_with_sql(spark, copies, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{copies}/lineitem.parquet/*.parquet')")
    assert differences(spark, con, copies, QUERIES[name], ORACLE_SQL[name]) == ""
