import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import SCHEMA, troubled  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return troubled()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Troubled documents with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    names = ("n", "id", "place", "class", "lang_pred", "score", "whole", "null_text", "count", "digest")
    return df.withColumns({c: F.lit(7) for c in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
