import pytest

from gridlens.compare import connect, differences
from gridlens.plans import models_queries, resample_queries
from gridlens.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, data, name, monkeypatch):
    if name in ORACLE_SQL:
        assert differences(spark, duck, data, QUERIES[name], ORACLE_SQL[name]) == ""
    else:  # run whole, with fewer draws; values are held to other versions in test_engine and test_models
        monkeypatch.setattr(models_queries, "MODEL_REPS", 20)
        monkeypatch.setattr(models_queries, "CV_REPS", 10)
        monkeypatch.setattr(resample_queries, "RANK_REPS", 20)
        assert QUERIES[name](spark, data).collect()


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 21
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
