import pytest


@pytest.fixture
def rows_of(spark):
    """Documents as a DataFrame with columns whose names clash with the operators' own."""

    def make(rows, parts=3):
        kind = "doc_id bigint, text string, lang string, source string, kept boolean, key bigint, owner string, v int, part int, size bigint, batch int, score double, digest string"
        return spark.createDataFrame([(*r[:2], *(r[2:4] if len(r) > 3 else (None, None)), *([None] * 9)) for r in rows], kind).repartition(parts)

    return make
