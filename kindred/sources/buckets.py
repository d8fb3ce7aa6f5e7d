"""Tables stored in hash buckets of a key, so that joins on the key move no rows of theirs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from kindred.session import TEXTS


def _name(path: str) -> str:
    return f"kindred_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, placed: bool = False) -> None:
    """Write ``df`` to ``path``, a file for each bucket of ``key``, in the order of the key.

    ``placed`` says that the rows of a task are of one bucket already, as after ``repartition`` by the key into a
    multiple of ``buckets``; they are not shuffled again, and each task writes a file of its own.

    Replaces what ``path`` holds; ``path`` with ``-schema`` after it names the columns. The key should be close to unique, as rows of
    one key share a bucket. The catalogue entry is only a name for the folder:
    ``read_bucketed`` makes its own in any session.
    """
    # a table without rows has no files that could tell its columns
    df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}-schema")
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    # the exchange places rows as the buckets do, so each task writes one file
    rows = df if placed else df.repartition(buckets, key)
    rows.write.mode("overwrite").format("parquet").options(**TEXTS).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_name(path))


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """The table that ``write_bucketed`` left at ``path`` with the same key and number of buckets.

    Spark finds a row's bucket by the name of its file, which the number of
    buckets has to match; files of other buckets are an error.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}-schema").schema)
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    spark.sql(
        f"CREATE TABLE {_name(path)} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(_name(path))
