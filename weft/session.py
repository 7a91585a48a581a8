"""Session helpers: the shared folder and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("weft")
    settings = {
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.

    Where that is unset a local session (tests, the bench) takes a temporary
    folder; on a cluster executors wouldn't see it, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def small_batches(spark: SparkSession, mb: int = 4):
    """Within it what runs sends at most `mb` MB to a Python worker at once; afterwards the session is as it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(mb << 20))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back.

    It cuts lineage like checkpoint(), computes each row once, survives the loss
    of any executor, and keeps columns pruned and compressed.
    The tables go when the driver exits, or with `release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weft-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _written[path] = spark
    return _read(spark, df, [path])


def grown(table: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of two written tables as one, without writing any again."""
    return _read(table.sparkSession, table, [*table.weft_paths, *new.weft_paths])


def _read(spark: SparkSession, like: DataFrame, paths: list[str]) -> DataFrame:
    out = spark.read.schema(like.schema).parquet(*paths)
    out.weft_paths = paths
    return out


def release(*frames: DataFrame) -> None:
    """Remove the tables behind frames that `materialise` gave and that nothing reads any longer."""
    for frame in frames:
        for path in getattr(frame, "weft_paths", ()):
            if path in _written:
                _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_materialised() -> None:
    """Remove every table written so far; frames that read them are unusable afterwards."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            return


atexit.register(drop_materialised)
