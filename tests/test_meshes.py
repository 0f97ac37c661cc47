import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import geometry, text
from meshloom.operators import features, kernels, matching, spatial, topology
from meshloom.plans import api
from meshloom.sources import glb, procedural, step, stl


@pytest.fixture(scope="module")
def mesh(spark):
    v, t = procedural.tables(spark)
    return v.cache(), t.cache(), topology.facets(v, t).cache()


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


#: vertices, edges, faces, Euler characteristic, shells, open edges
EXPECT = {"unit_cube": (8, 18, 12, 2, 1, 0), "labyrinth": (16, 36, 24, 4, 2, 0), "hinge": (16, 36, 24, 4, 2, 0), "prismatic_m6": (128, 384, 256, 0, 1, 0), "saddle": (578, 1728, 1152, 2, 1, 0), "open_box": (8, 17, 10, 1, 1, 4)}


def test_analysis(mesh):
    v, t, _ = mesh
    e = {r.mesh_id: r.e for r in topology.euler(t).collect()}
    for r in api.analyze(v, t).collect():
        assert (r.n_vertices, e[r.mesh_id], r.n_tri, r.chi, r.n_shells, r.open_edges) == EXPECT[r.mesh_id]
        if r.mesh_id == "prismatic_m6":
            assert r.volume == pytest.approx(32000 - 20 * 16 * 6.25 * math.sin(math.pi / 16), abs=1e-3)
        if r.mesh_id == "saddle":
            assert r.volume == pytest.approx(15360) and r.area == pytest.approx(4403.7162, abs=1e-3)


def test_mass_of_the_cube(mesh):
    m = {r.mesh_id: r for r in topology.mass_properties(mesh[2]).collect()}["unit_cube"]
    assert m.volume == pytest.approx(1) and (m.com_x, m.com_y, m.com_z) == pytest.approx((0.5, 0.5, 0.5)) and m.i_xx == pytest.approx(1 / 6) and m.i_xy == pytest.approx(0)


def test_weld_reads_back_the_mesh(mesh):
    soup = mesh[2].drop("i0", "i1", "i2")
    v, t = topology.weld(soup)
    assert {r.mesh_id: r.n for r in v.groupBy("mesh_id").agg(F.count("*").alias("n")).collect()} == {k: e[0] for k, e in EXPECT.items()}
    assert {r.mesh_id: r.open_edges for r in topology.edge_audit(t).collect()} == {k: e[5] for k, e in EXPECT.items()}


def test_sewing_closes_a_crack(spark):
    m = procedural.box(1, 1, 1)
    m.points.append((1.001, 1.0, 1.0))
    m.faces = [tuple(8 if i == 6 and f in m.faces[2:4] else i for i in f) for f in m.faces]
    v, t = procedural.tables(spark, {"m": m})
    assert topology.edge_audit(t).first().open_edges > 0
    assert topology.edge_audit(spatial.sewn(v, t)).first().open_edges == 0


def test_segmentation_and_threads(mesh):
    v, t, f = mesh
    kinds = {(r.mesh_id, r.type): r["count"] for r in kernels.surfaces(kernels.segment(f)).groupBy("mesh_id", "type").count().collect()}
    assert kinds["labyrinth", "plane"] == 12 and ("labyrinth", "cylinder") not in kinds
    assert kinds["prismatic_m6", "cylinder"] == 1 and kinds["prismatic_m6", "plane"] == 6
    h = api.detect_threads(v, t).collect()
    assert [(x.mesh_id, x.designation) for x in h] == [("prismatic_m6", "M6x1.0")] and h[0].diameter == pytest.approx(5, abs=1e-3) and h[0].depth == 20


def test_gates(mesh):
    g = {(r.mesh_id, r.gate): r.status for r in api.verify_meshes(mesh[0], mesh[1], 200).collect()}
    assert g["unit_cube", "solid"] == "passed" and g["open_box", "solid"] == "failed"
    assert g["hinge", "kinematics"] == "passed" and g["prismatic_m6", "differential"] == "passed"


def test_simplified_saddle_stays_closed(mesh):
    f = kernels.simplify(mesh[2].where("mesh_id = 'saddle'"), 700)
    rows = f.collect()
    assert rows[0].error is None and len(rows) <= 720
    audit = topology.edge_audit(f.select("mesh_id", "tri", "i0", "i1", "i2")).first()
    assert audit.open_edges == audit.non_manifold_edges == audit.inverted_edges == 0


def test_stl_round_trip_and_bad_files(spark, mesh, tmp_path):
    for r in stl.encoded(mesh[2]).collect():
        (tmp_path / f"{r.mesh_id}.STL").write_bytes(bytes(r.content))
    cube = (tmp_path / "unit_cube.STL").read_bytes()
    (tmp_path / "cut.stl").write_bytes(cube[:-30])
    (tmp_path / "short.stl").write_bytes(b"\0" * 40)
    (tmp_path / "text.stl").write_text("solid a\r\n facet normal 0 0 1\r\n outer loop\r\n vertex 0 0 0\r\n vertex 1e0 0 0\r\n vertex 0 1.5 0\r\n endloop\r\nendfacet\r\n vertex 1 1 1\nendsolid")
    got = {r.n: (r.tri, r.error) for r in stl.read_stl(spark, str(tmp_path)).groupBy(F.regexp_extract("mesh_id", r"([^/]+)\.\w+$", 1).alias("n")).agg(F.count("tri").alias("tri"), F.max("error").alias("error")).collect()}
    assert got["saddle"] == (1152, None) and got["cut"] == (11, None) and got["text"] == (1, None) and got["short"][0] == 0 and got["short"][1]


def test_exchange_file_audit(spark, mesh):
    text_ = step.faceted_solids(mesh[0], mesh[1], topology.shell_labels(mesh[1]))
    got = {r.file_id: r for r in step.audit(step.parse(text_.withColumnRenamed("mesh_id", "file_id"))).collect()}
    for k, e in EXPECT.items():
        assert (got[k].vertices, got[k].edges, got[k].faces, got[k].open_edges) == (e[0], e[1], e[2], e[5])


def test_statements_respect_quotes_and_comments(spark):
    t = "DATA;\n#1 = A('x;''y', #2); /* #9 = B(;) */\n#2=CARTESIAN_POINT('',(0.,1.,2.));ENDSEC;"
    rows = step.parse(spark.createDataFrame([("f", t)], "file_id string, text string")).collect()
    assert [(r.entity_id, r.entity_type, r.rhs) for r in rows] == [("#1", "A", "'x;''y', #2"), ("#2", "CARTESIAN_POINT", "'',(0.,1.,2.)")]


def test_glb_is_aligned(spark, mesh):
    r = glb.heat_maps(mesh[2].where("mesh_id = 'unit_cube'"), mesh[2].select("mesh_id", "tri", F.lit(0.25).alias("deviation"))).first()
    magic, version, size = struct.unpack_from("<4sII", bytes(r.content))
    assert (magic, version, size) == (b"glTF", 2, len(r.content)) and size % 4 == 0
    assert glb.ramp(np.array([0.0, 0.5, 1.0])).tolist() == [[0, 0, 1], [0, 1, 0], [1, 0, 0]]


def test_bolt_circle(spark):
    rows = [("m", i, 50 * math.cos(math.radians(60 * i)), 50 * math.sin(math.radians(60 * i)), 0.0, 0.0, 0.0, 1.0, 8.0, 20.0) for i in range(6)] + [("m", 6, 5.0, 3.0, 0.0, 0.0, 0.0, 1.0, 8.0, 20.0), ("m", 7, 200.0, 3.0, 0.0, 0.0, 0.0, 1.0, 3.0, 20.0)]
    h = spark.createDataFrame(rows, "mesh_id string, id long, x double, y double, z double, ax double, ay double, az double, diameter double, depth double")
    p = kernels.bolt_circles(h).collect()
    assert len(p) == 1 and p[0].n == 6 and p[0].pcd == pytest.approx(100) and p[0].step_deg == pytest.approx(60) and p[0].equispaced


def test_loops_and_bands(mesh):
    assert [r.n for r in kernels.loops(topology.boundary_half_edges(mesh[1])).groupBy("loop_id").agg(F.count("*").alias("n")).collect()] == [4]
    ring = lambda n: np.column_stack([np.cos(np.arange(n) * 2 * math.pi / n), np.sin(np.arange(n) * 2 * math.pi / n)])
    tri = kernels.band(ring(8), ring(5))
    assert len(tri) == 13 and {i for t in tri for i in t} == set(range(13))


def test_a_bad_mesh_is_a_row(spark):
    def kernel(pdf):
        if pdf["mesh_id"].iloc[0] == "bad":
            raise ValueError("no")
        return pdf[["mesh_id"]]

    got = {r.mesh_id: r.error for r in kernels.grouped(spark.createDataFrame([("bad",), ("good",)], "mesh_id string"), kernel, "mesh_id string").collect()}
    assert got == {"bad": "ValueError: no", "good": None}


def test_scalars(spark):
    v = lambda *x: tuple(F.lit(float(c)) for c in x)
    r = one(
        spark,
        half=geometry.rounded(F.lit(-2.5), 0), axis=geometry.snapped_axis(v(0, -0.98, 0)), none=geometry.snapped_axis(v(0.5, 0.5, 0.5)), cylinder=geometry.cylinder_distance(v(0, 0, 5), v(0, 0, 0), v(0, 0, 1), F.lit(10.0), F.lit(20.0)),
        torus=geometry.torus_distance(v(0, 0, 0), v(0, 0, 0), v(0, 0, 1), F.lit(20.0), F.lit(5.0)), halton=geometry.halton(F.lit(7), 2), n0=text.step_number(F.lit(-0.0)), n1=text.step_number(F.lit(15.0)), n2=text.step_number(F.lit(12.5)),
        size=text.thread_size(F.lit("M6x1.0")), pitch=text.thread_pitch(F.lit("M6x1.0")), overlap=geometry.interval_overlap(F.lit(0.0), F.lit(2.0), F.lit(1.5), F.lit(4.0)),
    )
    assert r.half == -2 and r.axis == "-Y" and r.none is None and r.cylinder == 10 and r.torus == 15 and r.halton == 0.875
    assert (r.n0, r.n1, r.n2) == ("0.", "15.", "12.5") and (r.size, r.pitch, r.overlap) == (6, 1, 0.5)


def test_materials(spark):
    want = {"pyrex": "glass", "carb": "carbon_fiber", "polycarb": "polycarbonate", "plate": "steel", "slab": "steel", "Structural Carbon Steel (AISI 1020)": "mild_steel", "POM / Polyacetal (Delrin)": "pom", None: "steel", "": "steel"}
    rows = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r.name: r.material_id for r in matching.resolve_materials(rows, "name").collect()} == want


def test_blends_and_counterbores(spark):
    s = spark.createDataFrame([("m", 1, "plane", 0.7, 0.7, 0.1, None, 100.0, 0.0), ("m", 2, "cylinder", 0.0, 0.0, 1.0, 3.0, 10.0, 90.0), ("m", 3, "plane", 0.0, 0.0, 1.0, None, 10.0, 0.0)], "mesh_id string, surface_id long, type string, ax double, ay double, az double, radius double, area double, span double")
    assert {(r.surface_id, r.kind, r.size) for r in features.blends(s).collect()} == {(1, "chamfer", 3.5), (2, "fillet", 3.0)}
    h = spark.createDataFrame([("m", "a", 5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("m", "b", 9.0, 0.1, 0.0, 0.0, 0.0, 0.0, 1.0), ("m", "c", 9.0, 30.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "mesh_id string, id string, diameter double, x double, y double, z double, ax double, ay double, az double")
    assert [(r.bore, r.counterbore) for r in features.counterbores(h).collect()] == [("a", "b")]


def test_drop_folder_stream(spark, mesh, tmp_path):
    from meshloom.streaming.manifest import drop_folder

    (tmp_path / "in").mkdir()
    for r in stl.encoded(mesh[2]).collect():
        (tmp_path / "in" / f"{r.mesh_id}.stl").write_bytes(bytes(r.content))
    for _ in range(2):  # a second run finds nothing new
        drop_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert len(rows) == 6 and all(r.success for r in rows) and sum(r.triangles for r in rows) == sum(e[2] for e in EXPECT.values())


def test_convert_writes_files(spark, mesh, tmp_path):
    api.convert(mesh[0], mesh[1], str(tmp_path / "o")).count()
    assert spark.read.json(str(tmp_path / "o/summary")).count() == 6 and len(list((tmp_path / "o/step").glob("mesh_id=*"))) == 6


def test_replicated_load(spark):
    v, t = procedural.replicated(*procedural.tables(spark, {"c": procedural.box(1, 1, 1)}), 50)
    assert topology.edge_audit(t).where("open_edges = 0 AND n_edges = 18").count() == 50


def test_material_spec():
    from meshloom.operators.polygons import material_spec

    assert list(material_spec("0=steel,1=,,,2=pom,=glass")) == [("index", "0", 0, "steel"), ("index", "2", 4, "pom")]
    assert list(material_spec("auto")) == [] and list(material_spec("steel")) == [("all", "", 0, "steel")]
    assert list(material_spec("steel,,pom,cover=abs")) == [("index", "0", 0, "steel"), ("index", "2", 2, "pom"), ("role", "cover", 3, "abs")]


def test_crossed_polygon(spark):
    from meshloom.operators import polygons

    rows = [(1, 1, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (2, 2), (2, 0), (0, 2)])] + [(1, 2, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])]
    got = {r.loop_id: r.n for r in polygons.crossings(spark.createDataFrame(rows, "g long, loop_id long, ord long, x double, y double"), ["g"]).collect()}
    assert got == {1: 1, 2: 0}


def test_distance_from_a_triangle():
    from meshloom.operators.polygons import triangle_distances

    t = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]]] * 5, float)
    p = np.array([[0.2, 0.2, 3], [-3, -4, 0], [0.5, -2, 0], [2, 0, 0], [1, 1, 0]], float)
    assert triangle_distances(p, t) == pytest.approx([3, 5, 2, 1, math.sqrt(0.5)])
