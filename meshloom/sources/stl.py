"""STL files as facet tables, and back. A bad file is a row with an error, never a failed job."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACET = "mesh_id string, tri long, x0 float, y0 float, z0 float, x1 float, y1 float, z1 float, x2 float, y2 float, z2 float, error string"
_RECORD = np.dtype([("normal", "<f4", 3), ("points", "<f4", 9), ("attribute", "<u2")])
_NUMBER = rb"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_VERTEX = re.compile(rb"vertex\s+" + _NUMBER + rb"\s+" + _NUMBER + rb"\s+" + _NUMBER, re.I)


def kind(data: bytes) -> str:
    """binary or ascii: by the length that the header's count implies, else by words in the first 4096 bytes, else by
    bytes that are no text in the first 512; binary in doubt."""
    if len(data) >= 84 and abs(len(data) - (84 + 50 * int.from_bytes(data[80:84], "little"))) <= 2:
        return "binary"
    head = data[:4096].lower()
    if b"solid" in head and b"facet" in head:
        return "ascii"
    odd = sum(1 for b in data[:512] if b < 9 or 13 < b < 32 or b > 126)
    return "ascii" if odd <= 2 and b"solid" in head else "binary"


def triangles(data: bytes) -> np.ndarray:
    """(n, 9) single-precision corners. A cut-off file gives its whole facets; normals and attributes are ignored."""
    if kind(data) == "binary":
        if len(data) < 84:
            raise ValueError("shorter than the 84 bytes of a header")
        n = min(int.from_bytes(data[80:84], "little"), (len(data) - 84) // 50)
        return np.frombuffer(data, _RECORD, n, 84)["points"].copy()
    found = np.array([tuple(map(float, m)) for m in _VERTEX.findall(data)], np.float32).reshape(-1, 3)
    return found[: len(found) // 3 * 3].reshape(-1, 9)


def parse_files(files: DataFrame) -> DataFrame:
    """Facets of files (path, content); one row with an error and no facet for a file that can't be read."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FACET.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                error, pts = None, np.zeros((0, 9), np.float32)
                try:
                    pts = triangles(content.as_py())
                    if not len(pts):
                        error = "no facets"
                except ValueError as e:
                    error = str(e)
                for at in range(0, max(len(pts), 1), 65536):
                    p = pts[at : at + 65536]
                    n = max(len(p), 1)
                    cols = [pa.array([path] * n, pa.string()), pa.array(np.arange(at, at + len(p)) if len(p) else [None], pa.int64())]
                    cols += [pa.array(p[:, k] if len(p) else [None], pa.float32()) for k in range(9)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([error] * n, pa.string())], names=names)

    return files.select("path", "content").mapInArrow(kernel, FACET)


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """Facets of a file or of a folder's *.stl files (any case, not below it), by path."""
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][tT][lL]").option("recursiveFileLookup", "false").load(path))


def encode_binary(points: np.ndarray) -> bytes:
    """A binary file of (n, 9) corners, with normals computed anew."""
    p = points.astype(np.float64).reshape(-1, 3, 3)
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    out = np.zeros(len(p), _RECORD)
    out["normal"] = np.where(size > 1e-12, n / np.where(size > 1e-12, size, 1), [0, 0, 1])
    out["points"] = points.reshape(-1, 9)
    return b"\0" * 80 + len(p).to_bytes(4, "little") + out.tobytes()


def encoded(facet: DataFrame) -> DataFrame:
    """(mesh_id, content): each mesh as the bytes of a binary STL file, facets in order of tri."""
    import pandas as pd

    cols = [f"{c}{k}" for k in range(3) for c in "xyz"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = pdf.sort_values("tri")[cols].to_numpy(np.float32)
        return pd.DataFrame({"mesh_id": [pdf["mesh_id"].iloc[0]], "content": [encode_binary(pts)]})

    return facet.select("mesh_id", "tri", *cols).groupBy("mesh_id").applyInPandas(one, "mesh_id string, content binary")


def formats(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, length) of each file, by what kind() looks at, on the JVM side."""
    head, front = F.lower(F.decode(F.substring("content", 1, 4096), "ISO-8859-1")), F.decode(F.substring("content", 1, 512), "ISO-8859-1")
    count = sum((F.conv(F.hex(F.substring("content", 81 + k, 1)), 16, 10).cast("long") * (1 << 8 * k) for k in range(4)), F.lit(0))
    exact = (F.col("length") >= 84) & (F.abs(F.col("length") - (84 + 50 * count)) <= 2)
    odd = F.length(F.regexp_replace(front, r"[\x09-\x0D\x20-\x7E]", ""))
    name = F.when(exact, "binary").when(F.contains(head, F.lit("solid")) & F.contains(head, F.lit("facet")), "ascii").when(odd > 2, "binary").when(F.contains(head, F.lit("solid")), "ascii").otherwise("binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][tT][lL]").load(path)
    return files.select("path", name.alias("format"), "length")


def discovered(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    """(valid, files): an .stl file itself, or a folder's *.stl files (any case, not below it) in order of name. A path that is not
    there, or a file of another kind, is not valid and has none; other errors are raised. Listing is the file system's."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return False, []
    if fs.getFileStatus(where).isFile():
        return (True, [path]) if path.lower().endswith(".stl") else (False, [])
    found = [s.getPath() for s in fs.listStatus(where) if s.isFile()]
    return True, [str(p) for p in sorted((p for p in found if p.getName().lower().endswith(".stl")), key=lambda p: p.getName())]
