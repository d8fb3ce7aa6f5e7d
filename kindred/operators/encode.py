"""Text to dense vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from kindred.functions.vectors import l2_normalize
from kindred.operators.terms import gather, tokens


def encode_with(
    docs: DataFrame, key: str, text_col: str, make_encoder: Callable, batch_size: int = 64, normalize: bool = True
) -> DataFrame:
    """(key, embedding) from a user's model, loaded once per Python worker.

    ``make_encoder`` returns a function from an array of texts to a matrix.
    """
    encode = predict_batch_udf(make_encoder, return_type=ArrayType(FloatType()), batch_size=batch_size)
    encoded = docs.select(key, encode(F.col(text_col)).alias("_vector"))
    vector = l2_normalize(F.col("_vector")) if normalize else F.col("_vector")
    return encoded.select(key, vector.cast("array<float>").alias("embedding"))


def _slot_and_sign(word: Column, dim: int) -> tuple[Column, Column]:
    """Place and sign of a word, from its hash."""
    digest = F.md5(word)
    slot = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    return slot, F.when(F.substring(digest, 9, 1) < "8", 1.0).otherwise(-1.0)


def hashed_vectors(
    docs: DataFrame, key: str, text_col: str, dim: int = 64, plain: bool = True, parts: int | None = None
) -> DataFrame:
    """(key, embedding) by signed feature hashing of words, unit length.

    The encoder that needs no model. One shuffle on the key, into ``parts`` if they
    are given; both aggregations follow from it in place. A text without words, or whose words
    cancel out, has the zero vector.
    """
    words = gather(docs, key, text_col, parts).select(key, F.explode_outer(tokens(F.col(text_col), plain)).alias("_word"))
    slot, sign = _slot_and_sign(F.col("_word"), dim)
    slots = words.groupBy(key, slot.alias("slot")).agg(F.sum(sign).alias("value"))
    # a text without words has one row without a slot, which the list leaves out
    entries = F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "value")))
    sums = slots.groupBy(key).agg(
        F.struct(
            F.map_from_entries(entries).alias("_sums"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm")
        ).alias("_text")
    )
    # inline keeps the map from being built again for each slot that is looked up
    unit = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.try_divide(F.try_element_at("_sums", i), F.col("_norm")), F.lit(0.0)).cast("float"),
    )
    return sums.select(key, F.inline(F.array("_text"))).select(key, unit.alias("embedding"))
