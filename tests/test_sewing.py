import pytest

from meshloom.operators import spatial


@pytest.mark.parametrize("order", [list(range(10)), [3, 7, 1, 9, 0, 5, 8, 2, 6, 4]])
def test_a_chain_of_ten_points_is_one_vertex(spark, order):
    """Ten corners in a row, each within the tolerance of the next only, each of a triangle of its own."""
    rows, tris = [], []
    for k, vid in enumerate(order):
        rows += [("m", vid, 0.004 * k, 0.0, 0.0), ("m", 100 + 2 * k, float(k), 5.0, 0.0), ("m", 101 + 2 * k, float(k), 9.0, 0.0)]
        tris.append(("m", k, vid, 100 + 2 * k, 101 + 2 * k))
    v = spark.createDataFrame(rows, "mesh_id string, vid long, x double, y double, z double")
    t = spark.createDataFrame(tris, "mesh_id string, tri long, i0 long, i1 long, i2 long")
    got = spatial.sewn(v, t).collect()
    assert len(got) == 10 and {r.i0 for r in got} == {0}
