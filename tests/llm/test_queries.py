import math
from collections import Counter

import pytest

from llm_cases import duck, nothing, odd, sf  # noqa: F401  fixtures
import __spark_entry__ as E
import corpus_pipeline
from ledgerflow.llm import queries as Q
from ledgerflow.llm.common import stored, table


def norm(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(norm(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_its_sql(spark, sf, duck, name):
    df = Q.queries()[name](spark, sf)
    want = duck.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.columns, df.collect()) == bag(columns, want.fetchall())


def test_all_operators_and_the_pipeline_are_registered():
    names = E.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names


def test_stages_keep_the_columns_of_documents_and_clean_rows(spark, sf):
    docs = first = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == first.columns and out.dtypes == first.dtypes
        if name == "language_id":
            assert out.count() >= 0.95 * docs.count()
        docs = out
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, sf).count() == docs.count()


def test_pipeline_of_odd_rows(spark, sf, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf), f"test-odd-{name}")
        assert "ids_crc32" in docs.columns
