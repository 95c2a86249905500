"""Intermediate tables that survive the loss of executors.

They are written to the shared folder named by ``spark.checkpoint.dir``. Only when that setting is
absent on a single machine (tests) a temporary folder is made and used; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_written: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or a folder of our own where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="rollmill-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def written(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it (lineage ends here).

    ``drop_shuffles`` has Spark delete the write's shuffle files as it ends; a collection of garbage may find the last job still referred to.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rollmill/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written`, once nothing reads them any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = file.rpartition("/")[0]
        _delete(spark, path)
        own = _written.get(spark.sparkContext.applicationId, set())
        own.difference_update({p for p in own if p.rpartition("/")[2] == path.rpartition("/")[2]})


def stored_bytes(df: DataFrame) -> int:
    """Size of the files behind a table made by :func:`written`."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
        return int(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength())
    return 0


def tidy(spark: SparkSession) -> None:
    """Have the driver drop what it no longer refers to, so that executors delete the shuffle files of finished jobs now rather than when
    the driver's memory runs short. For use between jobs that shuffle much."""
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> int:
    """Delete every table that this application wrote and hasn't discarded; results that read them are void then. Returns their number."""
    paths = _written.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        _delete(spark, path)
    return len(paths)
