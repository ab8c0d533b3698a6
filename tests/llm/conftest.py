import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with further columns whose names operators use inside."""
    from conftest_llm import ODD
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(7) for c in ("n_words", "kept", "cls", "bucket", "label", "score", "start", "key", "size", "n_chars", "version", "block", "_id")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
