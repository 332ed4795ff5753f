import importlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import compare, connection  # noqa: E402

PLANS = [importlib.import_module(f"cepage.plans.{m}") for m in ("curation", "evaluation", "analytics", "corpus_queries", "extensions")]
QUERIES = {k: f for m in PLANS for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in PLANS for k, s in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, name):
    con = connection(data)
    compare(QUERIES[name](spark, data), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).collect() is not None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_cosine_search_meets_every_label(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    pairs = QUERIES["f14_cosine_to_all"](spark, data).count()
    assert pairs == vectors.where("vec_id % 50 = 0").count() * (vectors.count() - 1)
