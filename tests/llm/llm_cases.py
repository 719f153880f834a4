import os

import duckdb
import pytest

SF = os.environ.get("LEDGERFLOW_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


#: Null in every column, empty and blank texts, repeated rows, shared and null ids, a long text,
#: and columns named like the operators' own.
ODD_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              "size long, target double, part int, words string, block int, keys string, __row string, __digest string, __later long, "
              "__doc string, __spans string, spans string, uid long, row string, doc string, later string, __uid long, __place string, n long, grp string, "
              "place string, node string, leaf string, marks string, letters string, kind int, prefix string")


def odd_rows():
    text = "The quick brown fox jumps over the lazy dog. All rights reserved.\nNothing else, idiot!"
    tail = (1, 1.0, 1, "w", 1, "k", "r", "d", 9, "o", "s", "s", 3, "r", "d", "l", 4, "p", 5, "g", "p", "n", "l", "m", "l", 2, "p")
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, text + " more", "en", "a"), (2, None, "en", "a"), (3, "", None, None),
            (4, " \n\t ", "en", None), (None, text, "en", "b"), (None, None, None, None), (5, "word " * 30000, "en", "b"),
            (6, "été à l'école 日本語 😀 $$$ 123", "fr", "b"), (7, "123 456 ...", None, "c"), (8, "x", "de", "c")]
    return [r + (len(r[1] or ""),) + tail for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
