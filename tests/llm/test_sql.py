"""Queries of the training-data operators that SQL can express."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from sqlcheck import SF, connect, same  # noqa: E402

from panelforge.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(), queries.ORACLE[name])


def test_search_over_all_vectors_finds_all(spark):
    found = queries.op5_topk(spark, SF).collect()
    assert found and all(1 <= r["rank"] <= 10 for r in found)
