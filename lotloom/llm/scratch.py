"""Tables and files that an operator keeps for a while, in the folder all executors share.

The folder is ``spark.checkpoint.dir``. Every table is written by Spark's own committer; files written
by Python tasks carry a name of their own per attempt, and only the names that reach the manifest
of the task's output count, so a lost executor or a second attempt leaves nothing wrong behind.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import removed, shared_folder, ship

_KEPT: list[tuple[SparkSession, str]] = []
_OF_STAGE: list[tuple[SparkSession, str]] = []
_now = _KEPT


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one use, removed when the process ends or the next stage begins."""
    path = f"{shared_folder(spark)}/lotloom/{name}-{uuid.uuid4().hex}"
    _now.append((spark, path))
    return path


def table(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it again: cuts the lineage, so nothing above it is done twice."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove what ``table`` wrote for ``df``, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        removed(df.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many marks before it as no column of ``df`` begins with."""
    mark = "__"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return mark + name


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Make ready for Python tasks: whole texts go to them this many at a time, unless the session asks for fewer."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def _deleted(kept: list[tuple[SparkSession, str]]) -> None:
    for spark, path in kept:
        removed(spark, path)
    kept.clear()


@contextlib.contextmanager
def stage():
    """While a stage of the pipeline plans its work: what the stages before kept goes first.

    A stage reads its predecessor's output, which is written by then, so nothing needs their
    scratch tables any more; its own stay until the next stage begins.
    """
    global _now
    _deleted(_OF_STAGE)
    _now = _OF_STAGE
    try:
        yield
    finally:
        _now = _KEPT


@atexit.register
def _at_exit() -> None:
    try:
        _deleted(_OF_STAGE)
        _deleted(_KEPT)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, for tasks that write or read raw bytes."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)
