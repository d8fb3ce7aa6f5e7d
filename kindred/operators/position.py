"""Dense row positions, exact samples and exact prefixes without a global sort task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.topk import top_rows

_MOST_PARTS = 4096  # the bound on what dense_index broadcasts
_DRAWN = 32  # rows of the sample for each part
_HEX_DIGITS = 4  # 65,536 ordered hash buckets: the bound on every broadcast below


def _bounds(df: DataFrame, order_by: list[str]) -> tuple[Column, int]:
    """(array of keys that cut the order into about even parts, their number).

    The keys are quantiles of the rows with the smallest hashes, so every job that draws them
    gets the same ones. Two parts for each shuffle partition of the session, ``_MOST_PARTS`` at most.
    """
    spark = df.sparkSession
    parts = min(_MOST_PARTS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(F.struct(*order_by).alias("key"), F.xxhash64(*order_by).alias("hash"))
    drawn = top_rows(keys, [F.asc("hash"), F.asc("key")], _DRAWN * parts)
    number = F.row_number().over(Window.orderBy("key"))
    cut = drawn.select("key", number.alias("n")).filter(F.col("n") % _DRAWN == 0)
    found = cut.agg(F.to_json(F.array_sort(F.collect_list("key"))).alias("keys"), F.count("*").alias("n")).first()
    kind = df.select(F.array(F.struct(*order_by)).alias("keys")).schema["keys"].dataType
    return F.from_json(F.lit(found["keys"]), kind), found["n"]


def dense_index(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_by``, nulls first.

    ``order_by`` has to identify rows. Quantiles of a sample that is drawn once are the fixed bounds
    of parts; a second pass over these columns counts the rows of each part, and the last one
    numbers rows inside their part and adds what stands before it. Nothing is stored, so ``df`` is read
    three times and must give the same rows each time.
    """
    bounds, n = _bounds(df, order_by)
    key = F.struct(*order_by)
    # Number of bounds that are not above the key, by halving; past the last bound there is null.
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    reach = lambda low, step: F.when(F.get(bounds, low + step - 1) <= key, low + step).otherwise(low)
    marked = df.withColumn("_part", F.aggregate(steps, F.lit(0), reach) if n else F.lit(0))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))
    # An outer join, since an inner one works the part out again to ask whether it is null.
    placed = marked.withColumn("_within", within).join(F.broadcast(offsets), "_part", "left")
    return placed.withColumn(name, F.col("_offset") + F.col("_within") - 1).drop("_part", "_within", "_offset")


def shuffle_key(key: str | Column, seed: int) -> Column:
    """Reproducible pseudo-random order of rows, independent of partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key))


def hash_position(df: DataFrame, key: str, seed: int, name: str, below: int | None = None) -> DataFrame:
    """Add each row's 0-based position in the hash order of the unique ``key``.

    The first hex digits of the hash are an ordered bucket. A first pass counts
    buckets, which needs the key column only; a second ranks rows inside each
    bucket. With ``below``, buckets past that position are dropped before any
    row is shuffled, and only the last bucket kept is cut.
    """
    hashed = df.withColumn("_hash", shuffle_key(key, seed))
    bucket = F.substring("_hash", 1, _HEX_DIGITS)
    sizes = hashed.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    if below is not None:
        offsets = offsets.filter(F.col("_offset") < below)
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key))
    placed = (
        hashed.withColumn("_bucket", bucket)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + rank - 1)
        .drop("_hash", "_bucket", "_offset")
    )
    return placed if below is None else placed.filter(F.col(name) < below)


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all rows if there are fewer."""
    return hash_position(df, key, seed, "_position", below=n).drop("_position")


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest values of the unique ``key``, in one pass."""
    return top_rows(df.filter(F.col(key).isNotNull()), [F.asc(key)], n)
