"""Session helpers: reading tables, cutting lineage safely, keeping what several queries share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table *name* below *sf_dir*."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    A cluster must name it; only for a local master (tests, one machine) a folder of this process is made and set
    where ``spark.checkpoint.dir`` is unset. That folder is removed when the process ends.
    """
    conf = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="folioscope-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(CHECKPOINT_KEY, "file://" + folder)
    return "file://" + folder


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/folioscope/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of this application in the shared folder that nothing else uses."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write *df* once to the shared folder and read it back.

    Unlike a cache the copy survives the loss of executors, and unlike re-evaluation it is computed once
    even when several branches of a plan read it.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _status(spark: SparkSession, path: str) -> tuple | None:
    """(path, time of change, length) of a file or folder, by any file system the session knows; None if absent."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    if not fs.exists(p):
        return None
    st = fs.getFileStatus(p)
    return path, st.getModificationTime(), st.getLen()


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at *path*?"""
    return _status(spark, path) is not None


def discard(spark: SparkSession) -> None:
    """Remove everything this application wrote to the shared folder; frames read from there are gone."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))  # noqa: SLF001
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001
    _MADE.clear()


_MADE: dict[tuple, object] = {}


def once(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], object]) -> object:
    """What *make* returns, made once per application and state of the *inputs* (paths of tables).

    A result that is a path is made anew when the path is gone.
    """
    key = (spark.sparkContext.applicationId, name, *[_status(spark, x) for x in inputs])
    held = _MADE.get(key)
    if held is None or (isinstance(held, str) and _status(spark, held) is None):
        held = _MADE[key] = make()
    return held
