import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark
    return get_spark("local[8]", 8, app="tessera-tests")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (id, text) pairs, with other columns beside them."""
    def make(rows, extra=()):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOC)
        from pyspark.sql import functions as F
        return df.withColumns({c: F.lit(7) for c in extra})
    return make
