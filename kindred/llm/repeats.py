"""Exact substring dedup: distributed prefix doubling over sampled positions.

The suffixes of a corpus are ranked by ever longer prefixes until they are
unique or the prefix reaches the threshold. Ranking every byte would move more
than sixteen times the corpus, so three things are done without losing a match:

* Only sampled positions are ranked by their first ``SEED`` bytes: in each
  stretch of ``size`` bytes the one whose seed has the least hash. Equal
  stretches hold the same sampled position, about one byte in eighteen.
* Sampled positions with all they can be part of, ``size`` bytes to both sides,
  in common with a smaller document are settled as a whole. Most repeats are.
* Only where seeds agree and surroundings differ are ranks doubled: first to the
  half that every stretch on one side shares, then to whole stretches. Ranks
  that are unique after a round drop out.

A rank is a 64-bit hash of its prefix, so a round is one sort by pairs of ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.bytehash import Prefixes, blocks, mixed
from kindred.session import written

SEED = 16
_PLACE = 40  # bits of a place in a text; above them stands the tag of its row
_SETTLED = 1 << 62  # marks a place that its own batch has settled
_LAST = 2**63 - 1
_NEVER = np.uint64(2**64 - 1)


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """Bytes of each text that a document with a smaller id repeats, removed.

    Every byte covered by a stretch of ``size`` bytes (33 or more) that also
    starts in a document with a smaller ``doc_id`` goes; stretches are judged on
    the input. Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept`` (the bytes left) and ``kept_sha256``, one row per input row.

    Null text counts as empty. Rows with a null id come after all others. Rows
    of the same id do not remove from each other; where ids repeat, their texts
    are told apart by 22 more bits of hash.
    """
    narrow = docs.select("doc_id")
    repeated = not narrow.groupBy("doc_id").count().filter("count > 1").isEmpty()
    tag = F.xxhash64("text").bitwiseAND(F.lit((1 << 22) - 1)) if repeated else F.lit(0).cast("long")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(_LAST)).cast("long").alias("doc"), tag.alias("tag"), "text")

    seeds = rows.select("doc", "tag", "text").mapInArrow(_sampled(size), "seed long, around long, doc long, place long")
    alone = Window.partitionBy("seed")
    same = Window.partitionBy("seed", "around")
    ranked = seeds.withColumns(
        {"first": F.min("doc").over(same), "low": F.min("around").over(alone), "high": F.max("around").over(alone)}
    )
    settled = (F.col("place") >= _SETTLED) | (F.col("doc") > F.col("first"))
    found = ranked.withColumn("settled", settled).filter(F.col("settled") | (F.col("low") < F.col("high")))
    found = found.select("doc", F.col("place").bitwiseAND(F.lit(_SETTLED - 1)).alias("place"), "settled")
    found = written(found, "repeats-seeds")

    open_ = _gathered(found.filter("NOT settled"))
    halves = rows.join(open_, "doc").select("doc", "tag", "text", "places").mapInArrow(
        _halves(size), "rank long, doc long, place long, late boolean"
    )
    halves = written(_shared(halves).select("doc", F.expr("place * 2 + int(late)").alias("place")), "repeats-halves")

    whole = rows.join(_gathered(halves), "doc").select("doc", "tag", "text", "places").mapInArrow(
        _stretches(size), "rank long, doc long, place long"
    )
    first = F.min("doc").over(Window.partitionBy("rank"))
    starts = written(whole.withColumn("first", first).filter("doc > first").select("doc", "place"), "repeats-stretches")

    gone = found.filter("settled").select("doc", F.expr("place * 2").alias("place")).unionByName(
        starts.select("doc", F.expr("place * 2 + 1").alias("place"))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(_gathered(gone), "doc", "left").select("doc_id", "tag", "text", "places").mapInArrow(
        _cut(size), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )


def _gathered(places: DataFrame) -> DataFrame:
    """Places by document; no more of them than the document has bytes."""
    return places.groupBy("doc").agg(F.collect_list("place").alias("places"))


def _shared(ranks: DataFrame) -> DataFrame:
    """Rows whose rank more than one document has."""
    same = Window.partitionBy("rank")
    both = ranks.withColumns({"low": F.min("doc").over(same), "high": F.max("doc").over(same)})
    return both.filter("low < high").drop("low", "high")


def _sliding(x: np.ndarray, width: int, better: Callable) -> np.ndarray:
    """Best of each ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = better(x[:-done], x[done:])
        done *= 2
    return better(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _sampled(size: int) -> Callable:
    """Sampled positions of whole texts, by seed and surroundings.

    Of those that agree in both inside one batch only the smallest document is
    sent on to be ranked; the others are marked as settled, and dealt out at
    random. So a group of copies sends one row from each batch to be ranked.
    """
    starts = size - SEED + 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2]
            docs, tags = batch["doc"].to_numpy(), batch["tag"].to_numpy()
            for row, offsets, data in blocks(batch["text"]):
                n = len(data)
                if n < size:
                    continue
                prefixes = Prefixes(data)
                at = np.arange(n)
                of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                end = offsets[1:][of]
                seed = prefixes.every(SEED)
                seed[at[: len(seed)] + SEED > end[: len(seed)]] = _NEVER
                least = _sliding(seed, starts, np.minimum)
                least[at[: len(least)] + size > end[: len(least)]] = 0
                edge = np.zeros(starts - 1, np.uint64)
                pick = np.flatnonzero(seed == _sliding(np.concatenate([edge, least, edge]), starts, np.maximum))
                low = np.maximum(offsets[of[pick]], pick - starts + 1)
                high = np.minimum(end[pick], pick + size)
                around = prefixes.hash(low, high) + (pick - low).astype(np.uint64)
                place = tags[row + of[pick]] << _PLACE | pick - offsets[of[pick]]
                parts.append((seed[pick], around, docs[row + of[pick]], place))
            seed, around, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((doc, around))
            seed, around, doc, place = seed[order], around[order], doc[order], place[order]
            new = np.ones(len(doc), bool)
            new[1:] = around[1:] != around[:-1]
            later = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else new
            seed[later] = mixed(around[later] ^ mixed(doc[later].view(np.uint64)))
            place[later] |= _SETTLED
            yield pa.record_batch(
                [pa.array(seed.view(np.int64)), pa.array(around.view(np.int64)), pa.array(doc), pa.array(place)],
                ["seed", "around", "doc", "place"],
            )

    return sample


def _places(batch: pa.RecordBatch, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, lowest ``shift`` bits) of all places that belong to their row's text."""
    lists = batch["places"]
    row = np.repeat(np.arange(len(lists)), np.nan_to_num(np.array(lists.value_lengths().fill_null(0))).astype(int))
    code = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    place = code >> shift
    own = place >> _PLACE == batch["tag"].to_numpy()[row]
    return row[own], place[own] & ((1 << _PLACE) - 1), code[own] & ((1 << shift) - 1)


def _by_block(batch: pa.RecordBatch, shift: int) -> Iterator[tuple]:
    row, place, extra = _places(batch, shift)
    for first, offsets, data in blocks(batch["text"]):
        low, high = np.searchsorted(row, [first, first + len(offsets) - 1])
        r = row[low:high] - first
        yield first, offsets, data, r, place[low:high] + offsets[r], extra[low:high]


def _halves(size: int) -> Callable:
    """The two halves around each place: what all stretches that start early, or late, share."""
    middle = (size - SEED + 1) // 2

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = batch["doc"].to_numpy(), batch["tag"].to_numpy()
            for first, offsets, data, r, at, _ in _by_block(batch, 0):
                prefixes = Prefixes(data)
                out = []
                for late, low, high in ((True, at, at + size - middle), (False, at - middle, at + SEED)):
                    fits = (low >= offsets[r]) & (high <= offsets[r + 1])
                    place = tags[first + r[fits]] << _PLACE | at[fits] - offsets[r[fits]]
                    out.append((prefixes.hash(low[fits], high[fits]).view(np.int64), docs[first + r[fits]], place, np.full(fits.sum(), late)))
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rank", "doc", "place", "late"])

    return rank


def _stretches(size: int) -> Callable:
    """All stretches on the live side of each place, ranked by the pair of their two overlapping halves."""
    starts = size - SEED + 1
    middle = starts // 2
    half = size - size // 2

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = batch["doc"].to_numpy(), batch["tag"].to_numpy()
            for first, offsets, data, r, at, late in _by_block(batch, 1):
                prefixes = Prefixes(data)
                steps = np.arange(starts)[None, :]
                begin = at[:, None] - steps
                keep = np.where(late[:, None] == 1, steps <= middle, steps >= middle)
                keep &= (begin >= offsets[r][:, None]) & (begin + size <= offsets[r + 1][:, None])
                code = np.unique(begin[keep])  # neighbours share most of their stretches
                of = np.searchsorted(offsets, code, "right") - 1
                left, right = prefixes.hash(code, code + half), prefixes.hash(code + size - half, code + size)
                pair = (left * np.uint64(3) + right).view(np.int64)
                place = tags[first + of] << _PLACE | code - offsets[of]
                yield pa.record_batch([pa.array(pair), pa.array(docs[first + of]), pa.array(place)], ["rank", "doc", "place"])

    return rank


def _cut(size: int) -> Callable:
    """Texts without what the places cover: surroundings (even codes) and stretches (odd ones)."""
    starts = size - SEED + 1
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data, r, at, stretch in _by_block(batch, 1):
                low = np.where(stretch == 1, at, np.maximum(at - starts + 1, offsets[r]))
                high = np.minimum(at + size, offsets[r + 1])
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, low, 1)
                np.add.at(step, high, -1)
                gone = np.cumsum(step[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = offsets[1:-1][offsets[1:-1] < len(data)]
                begins[inner] = gone[inner]
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])  # noqa: B023, E731
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.record_batch(
                    [
                        batch["doc_id"][first : first + len(kept)], pa.array(np.diff(offsets)), pa.array(total(gone)), pa.array(total(begins)),
                        pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    ],
                    names,
                )

    return cut
