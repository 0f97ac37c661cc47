"""Coloured meshes as binary glTF 2.0."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ramp(t: np.ndarray) -> np.ndarray:
    """Blue, cyan, green, yellow, red at 0, 1/4 .. 1."""
    stops = np.array([[0, 0, 1], [0, 1, 1], [0, 1, 0], [1, 1, 0], [1, 0, 0]], float)
    return np.column_stack([np.interp(np.clip(t, 0, 1), np.linspace(0, 1, 5), stops[:, k]) for k in range(3)])


def encode(points: np.ndarray, colors: np.ndarray, indices: np.ndarray) -> bytes:
    p, c, i = points.astype("<f4"), colors.astype("<f4"), indices.astype("<u4").ravel()
    parts, views, at = [p.tobytes(), c.tobytes(), i.tobytes()], [], 0
    for k, b in enumerate(parts):
        views.append({"buffer": 0, "byteOffset": at, "byteLength": len(b), "target": 34963 if k == 2 else 34962})
        at += len(b)
    doc = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "COLOR_0": 1}, "indices": 2}]}], "buffers": [{"byteLength": at}], "bufferViews": views,
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "count": len(p), "type": "VEC3", "min": p.min(axis=0).tolist(), "max": p.max(axis=0).tolist()},
            {"bufferView": 1, "componentType": 5126, "count": len(c), "type": "VEC3"},
            {"bufferView": 2, "componentType": 5125, "count": len(i), "type": "SCALAR"},
        ],
    }
    head = json.dumps(doc, separators=(",", ":")).encode()
    head += b" " * (-len(head) % 4)
    body = b"".join(parts)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(head) + len(body)) + struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(body), b"BIN\0") + body


def heat_maps(facet: DataFrame, deviation: DataFrame, full: float = 0.5) -> DataFrame:
    """(mesh_id, content): each mesh coloured by the mean deviation (mesh_id, tri, deviation) of the facets at a vertex, over `full`."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf[["i0", "i1", "i2"]].to_numpy(np.int64)
        vid, face = np.unique(ids, return_inverse=True)
        face = face.reshape(-1, 3)
        pts = np.zeros((len(vid), 3))
        pts[face.ravel()] = pdf[[f"{c}{k}" for k in range(3) for c in "xyz"]].to_numpy(float).reshape(-1, 3)
        total, n = np.zeros(len(vid)), np.bincount(face.ravel(), minlength=len(vid))
        np.add.at(total, face.ravel(), np.repeat(pdf["deviation"].fillna(0).to_numpy(float), 3))
        return pd.DataFrame({"mesh_id": [pdf["mesh_id"].iloc[0]], "content": [encode(pts, ramp(total / np.maximum(n, 1) / full), face)]})

    return facet.join(deviation, ["mesh_id", "tri"], "left").groupBy("mesh_id").applyInPandas(one, "mesh_id string, content binary")


def two_colours(facet: DataFrame) -> DataFrame:
    """(mesh_id, content): each mesh in green, with the vertices of facets marked `free` in orange."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        vid, face = np.unique(pdf[["i0", "i1", "i2"]].to_numpy(np.int64), return_inverse=True)
        face = face.reshape(-1, 3)
        pts = np.zeros((len(vid), 3))
        pts[face.ravel()] = pdf[[f"{c}{k}" for k in range(3) for c in "xyz"]].to_numpy(float).reshape(-1, 3)
        colour = np.tile([0.2, 0.8, 0.2], (len(vid), 1))
        colour[face[pdf["free"].to_numpy(bool)].ravel()] = [1.0, 0.55, 0.1]
        return pd.DataFrame({"mesh_id": [pdf["mesh_id"].iloc[0]], "content": [encode(pts, colour, face)]})

    return facet.groupBy("mesh_id").applyInPandas(one, "mesh_id string, content binary")
