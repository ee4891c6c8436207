import importlib.util
from pathlib import Path

import pytest

_spec = importlib.util.spec_from_file_location("root_conftest", Path(__file__).resolve().parent.parent / "conftest.py")
_root = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_root)
SMALL = _root.SMALL


@pytest.fixture
def documents(spark):
    """Documents with nulls, empty texts, ties, repeated rows, a long text and columns whose
    names clash with those the operators use."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.selectExpr("doc_id", "text", "'x' AS key", "1 AS n", "2 AS t", "3 AS doc", "'en' AS lang")

    return make
