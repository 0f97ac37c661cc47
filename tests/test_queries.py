import pytest
from conftest import compared

from meshloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, tables, name):
    assert compared(tables, ORACLES[name], QUERIES[name](spark, "/root/testdata/sf0.001")) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    rows = {r.mesh_id: r for r in e.entry(spark).collect()}
    assert rows["labyrinth"].n_cavities == 1 and rows["labyrinth"].volume == 75000
    assert rows["open_box"].open_edges == 4 and not rows["open_box"].watertight
