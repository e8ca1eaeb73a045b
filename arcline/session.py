"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows of one key (or one rank bucket) that a single task may have to sort.
# Keys holding more are split into ordered slices, see operators/skew.py.
SLICE_ROWS_CONF = "arcline.slice.rows"
DEFAULT_SLICE_ROWS = 4_000_000
# Bytes of files that one task reads where its rows are dealt to many partitions.
READ_BYTES = 32 << 20
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    app: str = "arcline",
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create a session with adaptive execution and skew handling on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: they come from
    spark-submit, and AQE coalesces the shuffle partitions it finds too small.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def slice_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SLICE_ROWS_CONF, str(DEFAULT_SLICE_ROWS)))


def joins_within_keys(spark: SparkSession) -> None:
    """Let a join by several keys use rows that are dealt by some of them already.

    Spark would otherwise deal both sides anew by all keys. Results do not depend on it.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def small_reads(spark: SparkSession) -> None:
    """Let a task read at most ``READ_BYTES`` of files.

    A task that deals rows to more than some 200 partitions holds what it read until all is dealt, so
    its memory follows the files it reads. Results do not depend on it.
    """
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(READ_BYTES))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is planned and run inside go when it ends.

    Otherwise they stay until the driver happens to collect its garbage. Results do not depend on it.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by the cluster; a temporary one only where unset (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="arcline-checkpoint-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the checkpoint folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written_once(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Rows written as Parquet below the checkpoint folder and read back: derived once, packed by column.

    ``by`` names columns that get a folder per value.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
