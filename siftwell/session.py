"""Session helpers: building one, reading tables, cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import itertools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_counter = itertools.count()
_roots: dict[str, str] = {}
#: Set while a step is written: its shuffle files go as soon as it is, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "siftwell", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller's session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, a temporary one under a local master and an error under any other."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="siftwell-")
            spark.conf.set("spark.checkpoint.dir", base)
        _roots[app] = f"{base.rstrip('/')}/siftwell-{uuid.uuid4().hex[:12]}"
        atexit.register(discard, spark, _roots[app])
    return _roots[app]


def _write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{next(_counter)}"
    _write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftwell_path = path  # so that release() finds it
    return out


def observed(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """materialise(df) and the aggregates `metrics` over its rows, taken while they are written: no job of their own."""
    watch = Observation()
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{label}-{next(_counter)}"
    _write(df.observe(watch, *[v.alias(k) for k, v in metrics.items()]), path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftwell_path = path
    return out, watch.get


def qualified(df: DataFrame) -> str:
    """The URI of what materialise() wrote for df, for tasks that read its files themselves."""
    where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._siftwell_path)
    return where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()


def release(df: DataFrame) -> None:
    """Deletes what materialise() wrote for df; nothing may read it afterwards."""
    path = getattr(df, "_siftwell_path", None)
    if path:
        discard(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system that Spark can read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def discard(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass
