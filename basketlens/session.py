"""Session creation and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("basketlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session may invent one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="basketlens-checkpoint-"))
    else:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can read"
        )


def durable_folder(spark: SparkSession) -> str:
    """Where written intermediate tables go: the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


_written: list[str] = []


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    The result has no lineage back to the raw tables, so a lost executor costs
    a re-read of this (much smaller) table and nothing else.  Being a columnar
    table, it also tells the optimizer its size and is read column by column.
    """
    spark = df.sparkSession
    path = f"{durable_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def _delete(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True))


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`durable` returned and nothing reads any more."""
    for table in tables:
        path = table._written_to
        if path in _written:
            _written.remove(path)
            _delete(table.sparkSession, path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Every query ended inside deletes its shuffle files at its end, not whenever the
    driver collects garbage; what is written meanwhile must be durable."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def clean_up(spark: SparkSession) -> int:
    """Delete the tables :func:`durable` wrote in this process, once nothing reads
    them any more; returns how many there were."""
    removed = 0
    while _written:
        removed += _delete(spark, _written.pop())
    return removed
