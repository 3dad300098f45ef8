"""The folder that the driver and all executors share, and this package for their Python workers."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, tuple[SparkSession, str]] = {}
_STORED: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """URI of ``spark.checkpoint.dir``. On one machine a temporary folder is made where none is set;
    a cluster has to name one, since a local folder would not reach the others."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lotloom-"))
        there = spark.sparkContext.getCheckpointDir()
    return (there if "://" in there or there.startswith("file:/") else "file://" + there).rstrip("/")


def removed(spark: SparkSession, uri: str) -> None:
    """Remove a file or folder of the shared folder, if the session still lives."""
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(uri)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again; it goes when the process ends.

    Lines are normalised once, when they come in; what reads them often reads plain columns.
    """
    path = f"{shared_folder(df.sparkSession)}/lotloom/{name}-{uuid.uuid4().hex}"
    _STORED.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """What ``stored`` gave goes before the process ends, as nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for spark, uri in [x for x in _STORED if x[1].rsplit("/", 1)[1] == path.rsplit("/", 1)[1]]:
            _STORED.remove((spark, uri))
            removed(spark, uri)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where it is on the driver's path only.

    Each function that runs Python in tasks calls this first. One archive for each application; it
    is removed when the process ends.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    uri = f"{shared_folder(spark)}/lotloom-{context.applicationId}.zip"
    where = context._jvm.org.apache.hadoop.fs.Path(uri)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(made.getvalue()))
    out.close()
    context.addPyFile(uri)
    _SHIPPED[context.applicationId] = (spark, uri)


@atexit.register
def _at_exit() -> None:
    for spark, uri in [*_SHIPPED.values(), *_STORED]:
        try:
            removed(spark, uri)
        except Exception:  # noqa: BLE001  the session may be gone
            pass
