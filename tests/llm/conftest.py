from __future__ import annotations

import pytest


@pytest.fixture
def docs_of(spark):
    """Documents (doc_id, text) and two columns whose names operators use themselves."""

    def make(rows: list[tuple]):
        return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, kept int, fp string")

    return make
