"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.words import hash_unit
from kindred.session import written

WEIGHTS = (3, 1, 2)
KEY_BUCKETS = 4096  # ordered slices of a source's keys; one of them is ranked


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: int) -> DataFrame:
    """Words that each source gives: shares of ``budget`` times all words, by weight.

    ``sizes`` has one row per source (``source``, ``source_size``). No target is
    above ``most`` times its source; what a source cannot give goes to the others
    by weight. Sources take their weights in code point order, null last. The
    fill level is found in closed form: sources in the order of the level at
    which they are exhausted, and the first that still holds the level sets it.
    One row per source passes through one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    level = Window.orderBy("ratio", "source")
    earlier = level.rowsBetween(Window.unboundedPreceding, -1)
    later = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(budget)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("fill", (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later))
        .withColumn("fill", F.min(F.when(F.col("fill") <= F.col("ratio"), F.struct("ratio", "source", "fill"))).over(everything)["fill"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce("fill", F.col("cap")) * F.col("weight")))
        .select("source", "source_size", "target")
    )


def mix(
    docs: DataFrame, size: Column, quality: Column, budget: float = 1.5, most: int = 2,
    weights: tuple[int, ...] = WEIGHTS, seed: int = 7,
) -> DataFrame:
    """Words that the mix takes from each document.

    ``docs`` has ``doc_id`` and ``source``; ``size`` counts a document's words
    (null: 0) and ``quality`` is its positive sampling weight (null or not
    positive: 1). Returns ``doc_id``, ``size``, ``source``, ``source_size``,
    ``target`` and ``taken``, one row per input row.

    A source first gives as many complete epochs as fit its target. The rest is
    drawn without replacement: each document has the key -ln(u)/quality, u from
    a hash of its id, and documents are taken in key order until the words run
    out; the one at the edge gives only the words still wanted. Keys are cut into
    ordered slices whose sums give the running total, so only documents of one
    slice are ever ranked together, however large the source.

    Null sources form one source. Rows with the same id, source and size are
    alike: any of them may come first. No rows: no rows.
    """
    weight = F.when(quality > 0, quality).otherwise(F.lit(1.0))
    sized = docs.select(
        "doc_id", "source", F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        (-F.log(hash_unit(F.col("doc_id"), seed)) / weight).alias("key"),
    )
    slot = F.least(F.floor((1 - F.exp(-F.col("key"))) * KEY_BUCKETS), F.lit(KEY_BUCKETS - 1))
    sized = written(sized.withColumn("slot", slot.cast("int")), "mix-sizes")

    slots = sized.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    targets = source_targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, budget, most)
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn(
        "rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    )
    order = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(order), F.lit(0)))
    plan = _same_source(slots, targets, F.lit(True))

    ranked = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    drawn = _same_source(sized, plan, F.col("l.slot") == F.col("r.slot"), drop=["slot"])
    reached = F.col("before") + F.coalesce(F.sum("size").over(ranked), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - reached))
    return drawn.withColumn("taken", F.col("epochs") * F.col("size") + extra).select(
        "doc_id", "size", "source", "source_size", "target", "taken"
    )


def _same_source(left: DataFrame, right: DataFrame, also: Column, drop: list[str] = []) -> DataFrame:  # noqa: B006
    """Inner join on a source that may be null."""
    found = left.alias("l").join(right.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")) & also)
    keep = [f"l.{c}" for c in left.columns] + [f"r.{c}" for c in right.columns if c not in ("source", *drop)]
    return found.select(*keep)


def labelled_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with ``quality_weight``: 2 if labelled good, 0.5 if labelled bad, else 1."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return docs.join(known, "doc_id", "left").withColumn("quality_weight", weight)
