"""Tables written to the folder that all executors share, and read again: lineage ends there."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own, for a session on this machine alone; on a cluster
    an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
        _made[base] = spark
    return base


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    except Exception:  # at exit the JVM may be gone; the folder is scratch space
        pass


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        _remove(spark, path)
    _made.clear()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{work_dir(spark)}/tidemark-{uuid.uuid4().hex}-{name}"
    _made[path] = spark
    return path


#: Spark's setting that removes a query's shuffle files when it ends, where a version has it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(spark: SparkSession, df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and a lost executor costs
    no more than the tasks since. The shuffle files of the write go when it ends. free also lets go of those of other
    queries that nothing refers to any more, after large ones."""
    path = folder(spark, name)
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    del df
    if free:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def drop_stage(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a staged table that no plan reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for known in [k for k in _made if k.endswith(path.rsplit("/", 1)[1])]:
            _remove(spark, known)
            _made.pop(known, None)
