"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_matches_sql(spark, sql, name):
    frame = registered.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    answer = sql.sql(registered.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    place = [answer.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in place) for r in answer.fetchall()), key=repr)
    assert ours == theirs


ROWS_ONLY = sorted(set(registered.queries()) - set(registered.oracle_sql()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert registered.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert [r["rank"] for r in registered.entry(spark).collect()] == list(range(1, 11))


@pytest.mark.parametrize("library", ["sentencepiece", "regex", "xxhash", "public_tokenizers"])
def test_other_queries_stay_without_a_library(library):
    """A library that only the text operators need may be absent."""
    code = (
        f"import sys; sys.modules[{library!r}] = None\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert len(names) >= 55 and not any(n.startswith('op') or n == 'pipeline' for n in names)\n"
        "assert set(e.oracle_sql()) <= set(names)\n"
    )
    folder = os.path.dirname(os.path.abspath(registered.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=folder, timeout=120)
