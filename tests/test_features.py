import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import bodies, bores, kernels, outlines, topology
from meshloom.plans import api, options
from meshloom.sources import exchange, procedural, step


def test_outputs_and_options():
    assert options.outputs("all") == set(options.OUTPUTS) and options.outputs(" CAD, json ,none") == {"step", "summary"} and options.outputs("minimal") == {"step"}
    assert options.Options(representation="auto").kind(10) == "faceted" and options.Options().kind(10**7) == "tessellated"
    for wrong in ({"representation": "x"}, {"tier": "9k"}, {"heatmap": "x"}, {"simplify_to": 0}):
        with pytest.raises(ValueError):
            options.Options(**wrong)
    assert options.base_name("/a/b.c/part.v2.STL") == "part.v2" and options.watchdog_seconds(10) == 70 and options.watchdog_seconds(1000) == 300


def test_requests():
    asked = []

    def call(tool, given):
        asked.append((tool, given))
        return {"n": 1} if tool == "analyze" else 1 / 0

    lines = ['{"jsonrpc":"2.0","id":1,"method":"ping"}', "not json", '{"method":"ping"}', "", '{"id":2,"method":"tools/list"}', '{"id":3,"method":"tools/call","params":{"name":"analyze","arguments":{"path":"a.stl"}}}', '{"id":4,"method":"tools/call","params":{"name":"threads","arguments":{"path":"a.stl"}}}', '{"id":5,"method":"tools/call","params":{"name":"convert","arguments":{"path":" "}}}', '{"id":6,"method":"what"}', '{"id":7,"method":"tools/call","params":{"name":"none","arguments":{}}}']
    sent = []
    options.serve(lines, call, lambda s: sent.append(json.loads(s)))
    assert [s["id"] for s in sent] == [1, None, 2, 3, 4, 5, 6, 7] and sent[1]["error"]["code"] == -32700 and sent[6]["error"]["code"] == -32601
    assert {t["name"] for t in sent[2]["result"]["tools"]} == {"analyze", "threads", "verify", "convert"} and json.loads(sent[3]["result"]["content"][0]["text"]) == {"n": 1}
    assert all(sent[k]["result"]["isError"] for k in (4, 5, 7)) and asked == [("analyze", {"path": "a.stl"}), ("threads", {"path": "a.stl"})]


def test_loops_that_touch_are_parted():
    """Two squares with one corner in common: two loops, whichever edge the walk begins with."""
    xy = {k: np.array(p, float) for k, p in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (2, 1), (2, 2), (1, 2)])}
    loops = outlines.trace({0: [1], 1: [2], 2: [3, 4], 3: [0], 4: [5], 5: [6], 6: [2]}, xy)
    assert sorted(map(sorted, loops)) == [[0, 1, 2, 3], [2, 4, 5, 6]]


def test_a_bored_face_has_a_hole(spark):
    f = topology.facets(*procedural.tables(spark, {"m": procedural.bored_block(), "w": procedural.wedge()}))
    rows = api.boundary_faces(f).where("error IS NULL").select("mesh_id", "cluster_id", "loop_id", "area", "parent").distinct().collect()
    holes = [r for r in rows if r.area < 0]
    outer = {(r.mesh_id, r.cluster_id, r.loop_id) for r in rows if r.area > 0}
    assert len(holes) == 2 and all((r.mesh_id, r.cluster_id, r.parent) in outer for r in holes)
    assert sum(r.mesh_id == "w" for r in rows) == 7


def test_scanned_bore(spark):
    v, t = procedural.tables(spark, {"m": procedural.bored_block()})
    h = api.scanned_holes(v, topology.facets(v, t)).collect()
    assert all(r.bore == pytest.approx(5, abs=1e-3) for r in h)


def test_folding_bodies(spark):
    rows = [("m", i, 10.0, x, 0.0, 0.0, x + 5, y, 5.0) for i, (x, y) in enumerate([(0.0, 100.0), (20.0, 100.0), (10.0, 30.0)])]
    b = spark.createDataFrame(rows, "mesh_id string, id long, signed_volume double, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    h = spark.createDataFrame([("m", 1, 5.0, 5.0, 0.0), ("m", 2, 5.0, 90.0, 0.0)], "mesh_id string, no long, x double, y double, z double")
    assert {r.id: (r.role, r.strategy) for r in bodies.classified(b, h).collect()} == {0: ("arm", "folding"), 1: ("base", "folding"), 2: ("strut", "folding")}


def test_tapped_pair_and_counterbore(spark):
    axis = (0.0, 0.0, 1.0)
    rows = [("m", 0, 0.0, 0.0, 0.0, *axis, 2.5, 10.0), ("m", 1, 0.1, 0.0, 0.0, *axis, 3.0, 10.0), ("m", 2, 50.0, 0.0, 0.0, *axis, 40.0, 8.0), ("m", 3, 50.0, 0.0, 0.0, *axis, 60.0, 3.0), ("m", 4, 99.0, 0.0, 0.0, *axis, 45.0, 3.0)]
    c = spark.createDataFrame(rows, "mesh_id string, id long, x double, y double, z double, ax double, ay double, az double, radius double, height double")
    got = {r.members: (r.kind, r.diameter, r.designation) for r in bores.paired_bores(c).collect()}
    assert got == {"0,1": ("tapped", 5.0, "M6x1.0"), "2,3": ("counterbore", 80.0, None), "4": ("single", 90.0, None)}


def test_exchange_file(spark):
    v, t = procedural.tables(spark, {"lab": procedural.labyrinth()})
    label = topology.shell_labels(t)
    shell = topology.shells(topology.facets(v, t), label)
    body = spark.createDataFrame([("lab", 0, "it's", 0.1, 0.2, 0.3, 0.5, "glass", 2.23)], "mesh_id string, shell_id long, name string, r double, g double, b double, transparency double, material string, density double")
    thread = spark.createDataFrame([("lab", "M6x1.0")], "mesh_id string, designation string")
    text = exchange.solids(v, t, label, shell, "faceted", body, thread).first().text
    for part in ("LENGTH_UNIT()", "LENGTH_MEASURE(1.0E-05)", "BREP_WITH_VOIDS('it''s'", "SURFACE_STYLE_TRANSPARENT(0.5000)", "MATERIAL_DESIGNATION('glass'", "'2.2300'", "THREADS_M6x1.0", "SHAPE_DEFINITION_REPRESENTATION", "STYLED_ITEM"):
        assert part in text, part
    e = step.parse(spark.createDataFrame([("lab", text)], "file_id string, text string"))
    kinds = {r.entity_type: r["count"] for r in e.groupBy("entity_type").count().collect()}
    assert kinds["CLOSED_SHELL"] == 2 and kinds["FACE_SURFACE"] == 24 and kinds["PRODUCT"] == 1 and kinds["CARTESIAN_POINT"] == 16
    with pytest.raises(ValueError):
        exchange.solids(v, t, label, shell, "other")


def test_holes_of_a_mesh(spark):
    f = topology.facets(*procedural.tables(spark, {"m": procedural.bored_block()}))
    h = api.holes(f, kernels.segment(f)).collect()
    assert [(r.id, r.designation) for r in h] == [(1, "M6x1.0")] and h[0].depth == pytest.approx(20)


def test_discovered_files(spark, tmp_path):
    from meshloom.sources.stl import discovered, formats

    for name, data in (("b.STL", b"solid x facet"), ("a.stl", b"\0" * 90), ("c.txt", b"")):
        (tmp_path / name).write_bytes(data)
    ok, files = discovered(spark, str(tmp_path))
    assert ok and [f.rsplit("/", 1)[-1] for f in files] == ["a.stl", "b.STL"]
    assert discovered(spark, str(tmp_path / "c.txt")) == (False, []) and discovered(spark, str(tmp_path / "none")) == (False, [])
    assert {r.path.rsplit("/", 1)[-1]: r.format for r in formats(spark, str(tmp_path)).collect()} == {"a.stl": "binary", "b.STL": "ascii"}


def test_documents(spark):
    holes = spark.createDataFrame([("m", 1, 5.0, 20.0, "M6x1.0")], "mesh_id string, id long, diameter double, depth double, designation string")
    blends = spark.createDataFrame([("m", 4, "fillet", 1.5)], "mesh_id string, surface_id long, kind string, size double")
    hinge = spark.createDataFrame([("m", 1, "s", "p", 0.3)], "mesh_id string, no long, socket string, pin string, clearance double")
    d = json.loads(bores.feature_documents(holes, blends, hinge).first().document)
    assert d["holes"][0]["designation"] == "M6x1.0" and d["fillets"] == [{"surface_id": 4, "size": 1.5}] and d["chamfers"] == [] and d["hinges"][0]["pin"] == "p"


def test_repeated_batches_write_once(spark, tmp_path):
    from meshloom.streaming.manifest import append, progress

    m = spark.createDataFrame([("a", True)], "file_path string, success boolean")
    for batch in (0, 1, 1):
        append(m, str(tmp_path / "m"), batch)
    assert spark.read.json(str(tmp_path / "m")).count() == 2 and progress("read", 1, 4, 9) == {"stage": "read", "percent": 25.0, "elapsed_ms": 9}


def test_widened_limits(spark):
    from meshloom.operators import verify

    a = spark.createDataFrame([("m", 0, 0, 0, 2, 1, 0, 100.0)], "mesh_id string, open_edges long, non_manifold_edges long, inverted_edges long, chi long, n_shells long, n_degenerate long, volume double")
    cover, joint = spark.createDataFrame([("m", 10, 10)], "mesh_id string, covered long, n long"), spark.createDataFrame([], "mesh_id string, gap double")
    off = spark.createDataFrame([("m", 0.5, 3.0, 0.1)], "mesh_id string, h99 double, hmax double, rmse double")
    last = lambda *more: {r.gate: r.status for r in verify.gates(a, cover, joint, off, None, *more).collect()}
    terms = spark.createDataFrame([("m", 0.9, 0.0, 1)], "mesh_id string, curvature double, tolerance double, threads long")
    assert last()["differential"] == "failed" and last(terms)["differential"] == "passed"
    assert last(terms, spark.createDataFrame([("m",)], "mesh_id string"))["solid"] == "failed"


def test_debris(spark):
    s = spark.createDataFrame([("a", 0, 100, 5.0), ("a", 1, 7, 9.0), ("a", 2, 10, 0.5), ("b", 0, 9, 0.5), ("b", 1, 9, 0.01), ("c", 0, 4, 0.1), ("c", 1, 5, 0.1)], "mesh_id string, shell_id long, n_tri long, signed_volume double")
    assert sorted((r.mesh_id, r.shell_id) for r in topology.debris_free(s).collect()) == [("a", 0), ("b", 0), ("c", 0), ("c", 1)]


def test_hypothesis_of_parallel_normals(spark):
    from meshloom.functions.geometry import cylinder_through

    at = lambda *c: tuple(F.lit(float(x)) for x in c)
    axis, centre, r = cylinder_through(at(3, 0, 1), at(1, 0, 0), at(0, 3, 5), at(0, 1, 0))
    none = cylinder_through(at(3, 0, 1), at(1, 0, 0), at(-3, 0, 5), at(-1, 0, 0))[2]
    row = spark.range(1).select(r.alias("r"), axis[2].alias("z"), centre[0].alias("x"), none.alias("none")).first()
    assert row.r == pytest.approx(3) and abs(row.z) == pytest.approx(1) and row.x == pytest.approx(0) and row.none is None and math.isfinite(row.r)
