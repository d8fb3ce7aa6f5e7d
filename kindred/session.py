"""Session building and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
SPLIT_BYTES = 8 << 20  # of files that a task reads where what it makes of them stays in its memory; several times that of texts
#: Options of tables of texts and terms: row groups that many tasks can share, and fewer bytes.
TEXTS = {"parquet.block.size": SPLIT_BYTES, "compression": "zstd"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LISTS = "spark.sql.parquet.pushdown.inFilterThreshold"
_PARTS = "spark.sql.shuffle.partitions"
_SPLIT = "spark.sql.files.maxPartitionBytes"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kindred", shared: str | None = None) -> SparkSession:
    """A single-JVM session for tests and benchmarks; ``shared`` is its ``spark.checkpoint.dir``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach.

    ``spark.checkpoint.dir`` names it. Where that is unset, written tables go to
    a folder of this session in the warehouse, which executors share as well; it
    is removed when the JVM ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _own_roots[app] = root
    return _own_roots[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def dropping_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Let Spark remove the shuffle files of each query as soon as it has run."""
    return setting(spark, _CLEANUP, "true")


def pushing_lists(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Let filters by lists of up to ``most`` values reach Parquet files as they are, not as a range."""
    return setting(spark, _LISTS, str(most))


def _bytes(size: str) -> int:
    """A size as sessions name it, like ``134217728b`` or ``128m``."""
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


@contextmanager
def in_pieces(spark: SparkSession, parts: int) -> Iterator[None]:
    """For what runs inside: shuffles into ``parts`` at least, and tasks that read at most ``SPLIT_BYTES``, or less where the session names less.

    Memory of a task then depends on the piece, not on the table.
    """
    parts = max(parts, int(spark.conf.get(_PARTS)))
    split = min(_bytes(spark.conf.get(_SPLIT, None) or str(SPLIT_BYTES)), SPLIT_BYTES)
    with setting(spark, _PARTS, str(parts)), setting(spark, _SPLIT, str(split)):
        yield


def written(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``options`` are those of Parquet files.

    Cuts the lineage with a table that outlives any executor, and unlike
    ``checkpoint()`` keeps column pruning for the passes that follow.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with dropping_shuffles(spark):
        df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(table: DataFrame) -> None:
    """Remove a table that ``written`` returned and that nothing will read again."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
