import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import compare, connection  # noqa: E402

from cepage.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, name):
    compare(QUERIES[name](spark, data), connection(data), ORACLES[name])


def test_registered_by_the_entry_module():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
