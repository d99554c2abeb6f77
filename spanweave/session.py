"""Session factory and the shared-folder helper."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on; `conf` keys use `__` for dots."""
    b = SparkSession.builder.master(master).appName("spanweave")
    extra = {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in (CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster names it. Where it is unset
    (single-process tests) a local folder is set, which is refused on any other master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanweave-"))
    return sc.getCheckpointDir()


#: Tables written by this session, for release().
_WRITTEN: list[str] = []


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING: list[str | None] = []
_LOCK = threading.Lock()


@contextmanager
def _shuffles_end_with_the_job(spark: SparkSession) -> Iterator[None]:
    """What a job shuffled is deleted at its end, not when the driver happens to collect its garbage."""
    with _LOCK:
        _WRITING.append(_WRITING[0] if _WRITING else spark.conf.get(_CLEANUP, None))
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            was = _WRITING.pop()
            if not _WRITING:
                spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: survives lost executors, unlike localCheckpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanweave-{uuid.uuid4().hex}"
    with _shuffles_end_with_the_job(spark):
        df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that cut_lineage wrote in this session and tells how many there were. Call it between jobs:
    frames that read from them, and graphs kept by the queries, cannot be read afterwards."""
    n = 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(p.getFileSystem(conf).delete(p, True))
    for forget in _ON_RELEASE:
        forget()
    return n


#: What else must be forgotten when written tables go.
_ON_RELEASE: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
