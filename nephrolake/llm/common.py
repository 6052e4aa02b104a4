"""Helpers shared by the training-data operators: session set-up, written
intermediate tables in the shared folder, and byte-level text views."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes in one Arrow batch. Documents can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: Rows of a few numbers in one file, and files that are always allowed.
FILE_ROWS, FEW_FILES = 100_000, 8

_written: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env, known = spark.sparkContext.environment, spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):  # workers import the operators by name; a cluster ships the package with --py-files
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="nephrolake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stash(df: DataFrame, label: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage so
    that a lost executor costs one task and not the plan behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, narrow and of so many rows at most, to be written in as many files
    as they fill. Without Hadoop's native library each file, its checksum and
    its folder cost a local file system a ``chmod`` process each."""
    return df.coalesce(max(FEW_FILES, -(-rows // FILE_ROWS)))


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that no later step reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _discard_all() -> None:
    for spark, path in list(_written):
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then
            return


def tidied(fn):
    """``fn`` for ``mapInArrow``, after which a worker gives back the memory
    that it no longer uses: idle workers wait beside those of the next stage."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def n_parts(spark: SparkSession, at_least: int = 1) -> int:
    """Shuffle partitions as the session has them."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A key for joins back to rows: rows that repeat an id with another text
    stay apart, rows repeated whole share all their results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def fixed(df: DataFrame, columns: dict) -> DataFrame:
    """``df`` with columns that are computed once for each row.

    A projection can be copied into whatever uses it (a filter pushed down, the
    body of a lambda), and an array expression would then run once for each
    element. A one-row generator keeps its columns' values.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*(F.col(f"`{c}`") for c in keep), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
