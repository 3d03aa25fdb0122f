"""Helpers shared by the operators: tables on the shared folder and batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvio.session import scratch_path
from fluvio.sources.tables import table

__all__ = ["table", "write_table", "input_bytes", "chunks", "map_arrow", "need", "send_package", "WORD"]

#: A word: a run of anything but ASCII white space (Java and DuckDB syntax).
WORD = r"[^\x20\x09-\x0D]+"

#: Spark removes a finished job's shuffle files when this is on.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, name: str, path: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return the reread table.

    This cuts the lineage (a lost executor costs no earlier stage), and the
    shuffle files of the job go when it ends.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    for key, most in _BATCHES.items():
        if not sc.getConf().contains(key):
            spark.conf.set(key, str(most))
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix=f"{root.name}-package-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = Path(folder, f"{root.name}-{sc.applicationId}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(name))
    _SENT.add(sc.applicationId)


#: Bounds of the batches that Spark hands to a Python worker, set where the session has Spark's own.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 2_000}


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors and batches of a few megabytes."""
    send_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def need(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under internal names (``doc_id="id"`` takes column ``id`` as ``doc_id``).

    Further columns of the input, whatever their names, play no part.
    """
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """About the stored bytes of ``df``: file sizes for a scan, else a third of the bytes of ``text``."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 56:
        return size
    return (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 3  # nothing is known of the size


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` (binary) holds about ``limit`` bytes, one row at least."""
    import numpy as np

    for batch in batches:
        if batch.num_rows == 0:
            continue
        a = batch.column(batch.schema.get_field_index(column))
        off = np.frombuffer(a.buffers()[1], dtype=np.int32, count=len(a) + 1 + a.offset)[a.offset:].astype(np.int64)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
