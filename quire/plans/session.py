"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: dict[str, SparkSession] = {}


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session's executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    handle, path = tempfile.mkstemp(prefix=f"{top.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys over as many tasks as a shuffle has and no fewer than keep the cores busy.

    What is small as rows may be large as packages or cost much in Python. So how many bytes the rows have must not decide
    how many tasks there are: only a number that is given keeps adaptive execution from joining partitions.
    """
    session = rows.sparkSession
    return rows.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism), *keys)


def cut_off(df: DataFrame) -> DataFrame:
    """df, worked out and written under spark.checkpoint.dir, which a cluster's driver and executors share. Where it is unset, local sessions get a folder of their own.

    Written as compressed columns, so that each of its readers reads only the columns and rows that it needs. The tables
    stay until the end of the driver program, as results may read them.
    """
    path = f"{_shared_folder(df.sparkSession)}/quire-cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_delete_written)
    _written[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_folder(session: SparkSession) -> str:
    context = session.sparkContext
    if not context.getCheckpointDir():
        folder = session.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="quire-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            folder = f"file://{own}"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def _delete_written() -> None:
    for path, session in _written.items():
        with suppress(Exception):  # at the end of the program its JVM may be gone already
            found = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
