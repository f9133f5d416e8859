"""What the operators need of a session: the shared scratch folder and the package on the workers."""

from __future__ import annotations

import ctypes
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one where that is unset on a local master, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into the shared folder and read back: its lineage is cut and survives executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system; Python workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: Bytes of rows that go to a Python worker at a time; its kernels need a few times as much.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable on the Python workers, once an application, and bound what they get at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    path = f"{scratch_dir(spark)}/lectern-{uuid.uuid4().hex}.zip"
    fs, p = file_system(spark, path)
    out = fs.create(p)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    fs.deleteOnExit(p)
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path
