"""The driver's contract: every query with an oracle matches DuckDB, and the optional part can be absent."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in rows)


def names():
    from strandline import catalog

    return sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", names())
def test_query_matches_its_oracle(spark, duck, name):
    from strandline import catalog

    got = catalog.queries()[name](spark, str(DATA))
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


ALONE = """
import sys; sys.path.insert(0, {repo!r})
import importlib.abc
class No(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ("strandline.llm", "corpus_pipeline"): raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
q = e.queries()
assert "pipeline" not in q and not any(k.startswith("op") for k in q) and set(e.oracle_sql()) <= set(q)
assert q["u14_ranges"](spark, {data!r}).count() == 25
"""


def test_the_rest_works_alone(tmp_path):
    """Without the llm folders and the pipeline, everything else imports and runs."""
    repo = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", ALONE.format(repo=str(repo), data=str(DATA))], check=True, cwd=tmp_path)


def test_broken_dependencies_are_not_hidden(tmp_path):
    """A module that the optional part needs and that is missing is an error."""
    repo = Path(__file__).resolve().parents[1]
    code = ALONE.format(repo=str(repo), data=str(DATA)).split("from pyspark")[0].replace('("strandline.llm", "corpus_pipeline")', '("xxhash",)')
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode != 0
