import inspect
import math

import pytest

from meshloom.operators import kernels, topology, verify
from meshloom.plans import api
from meshloom.sources import procedural


def test_a_mesh_is_held_against_its_source(spark):
    made, source = (procedural.tables(spark, {"m": procedural.box(10, 10, h)}) for h in (10, 13))
    alone = {r.gate: r.status for r in api.verify_meshes(*made).collect()}
    held = {r.gate: r.status for r in api.verify_meshes(*made, source=source).collect()}
    same = {r.gate: r.status for r in api.verify_meshes(*made, source=made).collect()}
    assert alone["differential"] == same["differential"] == "passed" and held["differential"] == "failed"
    assert inspect.signature(api.verify_meshes).parameters["n"].default == 3000


def test_chords_reach_the_drift(spark, monkeypatch):
    v, t = procedural.tables(spark)
    monkeypatch.setattr(verify, "gates", lambda *a: a[4])
    other = {r.mesh_id: r.other for r in api.verify_meshes(v, t, 50).collect()}
    volume = {r.mesh_id: r.volume for r in topology.analyze(v, t).collect()}
    bore = kernels.surfaces(kernels.segment(topology.facets(v, t))).where("type = 'cylinder'").first()
    chord = bore.area * 2 / 3 * bore.radius * (1 - math.cos(math.pi / max(8, min(128, bore.n_tri // 2))))
    assert other["prismatic_m6"] == pytest.approx(volume["prismatic_m6"] - chord) and other["unit_cube"] == volume["unit_cube"]
