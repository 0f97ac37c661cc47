"""The manifest of conversions: batch and streaming totals, windows of throughput, and the append-only sink.

The functions take batch or streaming frames alike; on a stream, give `late` to bound the state by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "file_path string, success boolean, elapsed_ms long, triangles long, step_path string, error string, ts timestamp"


def totals(manifest: DataFrame, keys: list[str]) -> DataFrame:
    return manifest.groupBy(*keys).agg(F.count("*").alias("processed"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("errors"), F.sum("triangles").alias("triangles"))


def _timed(rows: DataFrame, ts: str, late: str | None) -> DataFrame:
    rows = rows.withColumn("_ts", F.col(ts).cast("timestamp"))
    return rows.withWatermark("_ts", late) if late else rows


def tumbling(rows: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    w = _timed(rows, ts, late).groupBy(F.window("_ts", width), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(rows: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    w = _timed(rows, ts, late).groupBy(F.session_window("_ts", gap), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def append(manifest: DataFrame, path: str, batch: int | None = None) -> None:
    """Adds records as JSON lines. A batch of a stream has a folder of its own, which a repeated batch replaces."""
    if batch is None:
        manifest.write.mode("append").json(path)
    else:
        manifest.write.mode("overwrite").json(f"{path}/batch={batch}")


def progress(stage: str, done: int, of: int, elapsed_ms: int) -> dict:
    """One progress record: the stage, how much of it is done, and the time so far."""
    return {"stage": stage, "percent": round(100.0 * done / of, 1) if of else 100.0, "elapsed_ms": elapsed_ms}


class Progress(StreamingQueryListener):
    """Hands a record to `tell` at each step of a streaming query: rows read and rows a second."""

    def __init__(self, tell) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"query": str(event.id), "stage": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"query": str(p.id), "stage": "progress", "batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"query": str(event.id), "stage": "ended", "error": event.exception})


def drop_folder(spark, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Watches a folder of STL files: each file's counts are added to a manifest, a file once, over restarts and repeated batches.
    elapsed_ms is from the file's modification to its record."""
    from meshloom.sources.stl import parse_files

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[sS][tT][lL]").load(folder)

    def one(batch: DataFrame, number: int) -> None:
        good = parse_files(batch).groupBy("mesh_id").agg(F.count("tri").alias("triangles"), F.max("error").alias("error"))
        good = good.join(batch.select(F.col("path").alias("mesh_id"), "modificationTime"), "mesh_id")
        took = F.greatest(F.lit(0), F.unix_millis(F.current_timestamp()) - F.unix_millis("modificationTime"))
        rows = good.select(F.col("mesh_id").alias("file_path"), F.col("error").isNull().alias("success"), took.alias("elapsed_ms"), "triangles", F.lit(None).cast("string").alias("step_path"), "error", F.current_timestamp().alias("ts"))
        append(rows, out, number)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
