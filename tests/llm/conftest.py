import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from llm_helpers import DOC_COLUMNS, odd_texts  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with null and repeated ids, a repeated row, and columns whose
    names the operators use inside."""
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    rows += [(None, "a document without an id " * 4), (None, None), (7, rows[7][1]), (7, rows[7][1]), (8, "another text of the id 8")]
    full = [(i, t, None if (i or 0) % 3 else "en", None, len(t or ""), 1, 2, 3, 4, 5, "s", "l") for i, t in rows]
    return spark.createDataFrame(full, DOC_COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
