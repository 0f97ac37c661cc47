"""python -m meshloom.cli analyze|threads|verify|convert PATH [--out FOLDER] [--emit step,summary,..] [--tier 4k|8k|32k|128k]
[--representation auto|faceted|tessellated] [--heatmap failed-only|always|none] [--material SPEC] [--simplify-to N] [--y-up]
python -m meshloom.cli serve   answers JSON-RPC requests on standard input, one a line."""

from __future__ import annotations

import argparse
import sys


def _number(text: str) -> float | int:
    return float(text) if "." in text else int(text)


def call(spark, tool: str, parameters: dict[str, str]) -> object:
    """A tool over one path; its rows, or what it wrote."""
    from meshloom.plans import api
    from meshloom.plans.options import Options, outputs
    from meshloom.sources.stl import read_stl

    v, t = api.indexed(read_stl(spark, parameters["path"]))
    if tool == "convert":
        o = Options(out=parameters.get("out"), tier=parameters.get("tier", "8k"), emit=outputs(parameters.get("emit", "standard")))
        return [r.asDict() for r in api.converted(v, t, o).select("mesh_id", "tokens").collect()]
    run = {"analyze": api.analyze, "threads": api.detect_threads, "verify": api.verify_meshes}[tool]
    return [r.asDict(True) for r in run(v, t).collect()]


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from meshloom.plans import api, options
    from meshloom.sources.stl import read_stl

    p = argparse.ArgumentParser(prog="meshloom")
    p.add_argument("mode", choices=["analyze", "threads", "verify", "convert", "serve"])
    p.add_argument("path", nargs="?")
    p.add_argument("--out")
    p.add_argument("--emit", default="standard")
    p.add_argument("--tier", default="8k")
    p.add_argument("--representation", default="auto")
    p.add_argument("--heatmap", default="failed-only")
    p.add_argument("--material", default="auto")
    p.add_argument("--simplify-to", type=_number)
    p.add_argument("--y-up", action="store_true")
    a = p.parse_args(argv)
    try:
        o = options.Options(a.out, options.outputs(a.emit), a.tier, a.representation, a.heatmap, a.material, a.simplify_to, a.y_up)
    except ValueError as e:
        p.error(str(e))
    spark = SparkSession.builder.appName("meshloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.mode == "serve":
        options.serve(sys.stdin, lambda tool, given: call(spark, tool, given), lambda s: (sys.stdout.write(s), sys.stdout.flush()))
        return 0
    if not a.path:
        p.error("a path is needed")
    mesh = api.indexed(read_stl(spark, a.path))
    run = {"analyze": api.analyze, "threads": api.detect_threads, "verify": api.verify_meshes, "convert": lambda v, t: api.converted(v, t, o)}
    df = run[a.mode](*mesh)
    if a.out and a.mode != "convert":
        df.write.mode("overwrite").json(a.out)
    else:
        df.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
