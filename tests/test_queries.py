"""Every core query against its SQL."""

import pytest
from oracle import same, views

from lodestack.plans import registry

QUERIES = registry.core()


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert same(spark, con, QUERIES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["sha256", "n", "paths"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_stands_alone():
    """Nothing outside the llm subpackage imports it, but the entry, which does without."""
    from pathlib import Path

    root = Path(registry.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "lodestack.llm" not in f.read_text(), f
