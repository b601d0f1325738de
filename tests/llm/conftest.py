import os

import pytest

TABLES = "documents pages benchmark labels"


@pytest.fixture
def rows(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with operators' own."""

    def make(pairs):
        data = [(i, t, "x", None, i) for i, t in pairs]
        return spark.createDataFrame(data, "doc_id long, text string, start string, kept boolean, grp long")

    return make


@pytest.fixture(scope="session")
def read(spark, sf_dir):
    return lambda name: spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
