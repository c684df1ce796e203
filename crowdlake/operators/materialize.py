"""Results that several later steps read are written once to the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_used: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="crowdlake-")
    return _local_dirs[app]


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/crowdlake-{spark.sparkContext.applicationId}"
    if folder not in _used:
        _used.add(folder)
        atexit.register(_drop, spark, folder)
    return folder


def _drop(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here, executors may be lost, and later
    steps still prune columns and see true sizes."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Like :func:`materialize`, but in ``parts`` buckets of ``key``, so that later joins on it need no exchange.

    ``df`` should be partitioned by ``key`` into as many parts: then each task writes one file, without sorting. The
    table's name leaves the catalog at once; the files stay as long as those of :func:`materialize`.
    """
    spark, name = df.sparkSession, f"crowdlake_{uuid.uuid4().hex}"
    conf = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(conf, "0")
    spark.conf.set(conf, "8")
    try:
        df.write.bucketBy(parts, key).option("path", f"{_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(conf, before)
    written = spark.table(name)
    spark.sql(f"drop table {name}")
    return written


def release(df: DataFrame) -> None:
    """Delete the files of a table of :func:`materialize` or :func:`materialize_by` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """Within this block, the shuffle files of a step go when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
