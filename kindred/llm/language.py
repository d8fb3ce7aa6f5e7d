"""Language ID: string kernels with Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kindred.llm.bytehash import blocks, parts, small_batches

FIT_ROWS = 1024  # bound of the labelled rows that are read for the fit, all languages together
LANDMARKS = 192
RIDGE = 1e-3
ORDERS = (1, 2, 3, 4)
WIDTH = 1 << 14  # hashed n-grams
SHARPNESS = 4.0
SPREAD = 64  # parts in which the rows of a language are cut down before they meet
_ROWS = 128  # texts whose presence bits are held at once
_FIT_ROWS = 16  # of the labelled rows, and slots, that the fit holds as numbers at once
_FIT_SLOTS = 1 << 10
#: Bytes that are no letters count as one space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = np.where(np.char.isalpha(np.array([chr(i) for i in range(128)])), _FOLD[:128], 32)


@dataclass
class LanguageModel:
    """One weight vector over n-grams for each language; small whatever the corpus."""

    languages: list[str]
    weights: np.ndarray  # WIDTH x languages


def presence(texts: list[str]) -> Iterator[np.ndarray]:
    """Presence bits of the n-grams of each text, ``_ROWS`` texts at a time."""
    for at in range(0, len(texts), _ROWS):
        part = [t.lower() for t in texts[at : at + _ROWS]]
        bits = np.zeros((len(part), WIDTH), bool)
        flat = bits.reshape(-1)
        for row, offsets, data in blocks(pa.array(part, pa.large_string())):
            data = _FOLD[data].astype(np.int64)
            doc = np.repeat(np.arange(row, row + len(offsets) - 1), np.diff(offsets))
            left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
            code = np.zeros(len(data), np.int64)
            for n in range(1, max(ORDERS) + 1):
                code = code[: len(data) - n + 1] << 8 | data[n - 1 :]
                if n in ORDERS:
                    keep = left[: len(code)] >= n
                    slot = ((code * 0x9E3779B1 + n) * 0x85EBCA6B >> 13) & (WIDTH - 1)
                    flat[(doc[: len(code)] * WIDTH + slot)[keep]] = True
        yield bits


def _unit(bits: np.ndarray) -> np.ndarray:
    """Rows of presence bits, packed or not, at unit length: four bytes for each bit, so of some rows at a time."""
    x = (np.unpackbits(bits, axis=1) if bits.dtype == np.uint8 else bits).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return x


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """One-versus-rest kernel ridge regression on Nystroem features.

    The kernel of two texts is the number of n-grams of all orders that both
    hold, over the geometric mean of what each holds. Landmarks are spread evenly
    over the rows, which come sorted by language. ``bits`` may come packed to bytes, and are
    unpacked a few rows at a time, as this runs in the driver. As the kernel is linear in the
    bits, regression and landmarks fold into one weight vector per language.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((WIDTH, 0), np.float32))
    marks = _unit(bits[np.unique(np.linspace(0, len(bits) - 1, min(landmarks, len(bits))).astype(int))])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])
    near = [_unit(bits[at : at + _FIT_ROWS]) @ marks.T for at in range(0, len(bits), _FIT_ROWS)]
    features = np.concatenate(near).astype(np.float64) @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    # Each language counts alike, however many rows it has.
    share = np.array([1 / labels.count(k) for k in labels])[:, None]
    gram = features.T @ (features * share) + ridge * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (target * share))
    folded = root @ solved
    weights = [(marks[:, at : at + _FIT_SLOTS].T @ folded).astype(np.float32) for at in range(0, WIDTH, _FIT_SLOTS)]
    return LanguageModel(languages, np.concatenate(weights))


def learn(docs: DataFrame, rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on at most ``rows`` of the labelled rows of ``docs`` (``doc_id``, ``text``, ``lang``).

    Every language gives as many, first in the order of a hash of their text, so
    the choice does not depend on the layout of the table; of more languages than
    rows, those whose first hash is smallest give one each. Null or empty texts
    and null languages teach nothing, repeated ones teach once; without rows the
    model knows no language.
    """
    small_batches(docs.sparkSession)
    labelled = docs.filter("lang IS NOT NULL AND text <> ''").select("lang", "text", F.xxhash64("text").alias("place"))
    narrow = labelled.select("lang", "place")
    known = narrow.select("lang").distinct().count()
    if not known:
        return fit(np.zeros((0, WIDTH), bool), [])
    most = max(1, rows // known)
    spread = F.pmod(F.col("place"), F.lit(SPREAD))
    wanted = narrow.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang", spread).orderBy("place"))).filter(F.col("rank") <= most)
    wanted = wanted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).filter(F.col("rank") <= most)
    # At most `rows` rows, and for each no more than a hash.
    wanted = F.broadcast(wanted.orderBy("rank", "place", "lang").limit(rows).select("lang", "place"))
    chosen = labelled.join(wanted, ["lang", "place"]).dropDuplicates(["lang", "place"]).select("lang", "place", "text")

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [np.packbits(row).tobytes() for part in presence(batch["text"].to_pylist()) for row in part]
            yield pa.record_batch([batch["lang"], batch["place"], pa.array(found, pa.binary())], ["lang", "place", "bits"])

    sample = chosen.mapInArrow(bits_of, "lang string, place bigint, bits binary").collect()
    sample.sort(key=lambda r: (r["lang"], r["place"]))
    bits = np.frombuffer(b"".join(r["bits"] for r in sample), np.uint8).reshape(len(sample), -1)
    return fit(bits, [r["lang"] for r in sample])


def predict(docs: DataFrame, model: LanguageModel, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns, ``lang_pred`` and ``score`` (0 to 1) of each row.

    Texts are scored in blocks, each by one matrix product. A null text, one
    without a letter, and any text under a model without languages is ``und``
    with score 0. Of equal scores the language first by name wins. Repeated rows
    are scored each, an empty table gives an empty one, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    languages, weights = np.array([*model.languages, "und"]), model.weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [t or "" for t in batch[text].to_pylist()]
            best, high = [np.zeros(0, int)], [np.zeros(0)]
            for bits in presence(texts) if len(languages) > 1 else ():
                held = np.sqrt(np.maximum(bits.sum(1), 1))[:, None]
                raised = np.exp(SHARPNESS * (bits.astype(np.float32) @ weights / held))
                best.append(raised.argmax(1))
                high.append(raised.max(1) / raised.sum(1))
            best, high = np.concatenate(best), np.concatenate(high)
            none = np.array([not any(map(str.isalpha, t)) for t in texts], bool)
            if not len(best):
                best, high, none = np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool)
            best[none], high[none] = len(languages) - 1, 0.0
            kept = [batch[c] for c in key]
            yield pa.record_batch([*kept, pa.array(languages[best].tolist(), pa.string()), pa.array(high, pa.float64())], names)

    names = [*key, "lang_pred", "score"]
    out = StructType([*(docs.schema[c] for c in key), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*dict.fromkeys([*key, text])).mapInArrow(score, out)


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing and measure the accuracy."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
