"""Every query of the catalogue against its DuckDB text on the smallest tables."""

import pytest

from mnemo import plans

from .duck import connect, rows_of_duck, rows_of_spark

#: May have no row on so little data.
MAY_BE_EMPTY = {"statement_reserve", "paraphrase_pairs", "entity_cooccurrence", "topic_overlap_pairs", "purge_candidates", "eval_hit_at_k", "semantic_dedup_window", "filtered_list", "parent_boost", "forced_contradictions", "dormant_resurrection"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, con, name):
    cols, rows = rows_of_spark(plans.QUERIES[name](spark, sf))
    assert rows or name in MAY_BE_EMPTY
    if name in plans.ORACLES:
        want_cols, want = rows_of_duck(con, plans.ORACLES[name])
        assert cols == want_cols
        assert rows == want


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(plans.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
