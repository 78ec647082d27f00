import pytest

from tesela.llm import queries


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "p8_fill", "p9_shares", "p10_found"])
def test_runs_over_the_smallest_tables(spark, tiny, name):
    rows = queries.QUERIES[name](spark, tiny)
    assert rows.count() > 0
