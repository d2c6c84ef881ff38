"""The toxicity chain on hardly any labels."""

import pytest

from fleetlake.llm import toxicity
from llm_rows import DOCS, hard_rows

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("labels", [[], [(6, 1, 0)], [(6, 1, 0), (10, 0, 1), (12, 1, 1)], [(99, 0, 1)], [(6, None, None)], [(1, 1, 1), (2, 0, 0)]])
def test_any_number_of_labels_gives_a_row_for_each_document(spark, hard, labels):
    got = toxicity.toxicity_query(hard, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(x[0]) for x in hard_rows())
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 and r.toxic == (r.p_toxic >= 0.25) for r in got)
    known = [(q, t) for i, q, t in labels if q is not None and i in {x[0] for x in hard_rows()}]
    if not known:
        assert {(r.p_low_quality, r.p_toxic, r.toxic) for r in got} == {(0.0, 0.0, False)}


def test_many_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i, f"same words in all {i % 3}") for i in range(40)], "doc_id long, text string")
    got = toxicity.toxicity_query(docs, spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS)).collect()
    assert len(got) == 40 and not any(r.toxic for r in got)


def test_no_documents(spark, nothing):
    assert toxicity.toxicity_query(nothing, spark.createDataFrame([], LABELS)).count() == 0
    assert toxicity.toxicity_query(nothing, spark.createDataFrame([(1, 0, 1)], LABELS)).count() == 0
    assert DOCS.names == nothing.columns
