"""Benchmark decontamination: windows of documents within a small edit distance of an item.

A random walk (CGK) copies a window symbol by symbol and, at each step, moves on
or stays by a random bit of the symbol it copies. Two windows that few edits tell
apart fall into step again after each edit, so their copies differ in few places
and a sample of places often agrees in full. Windows are of the size of the item
they look for; walks and samples are repeated until drawn items with all the edits
allowed reach a target recall, and what agrees is verified by its exact edit distance.
Symbols are words in lower case, or characters in scripts that put no spaces.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kindred.llm.bytehash import Prefixes, blocks, mixed, parts, small_batches, words

LEAST_WORDS = 8  # shorter items are phrases, looked for without edits
PERCENT = 20  # edits allowed, of the words of an item
RECALL = 0.95  # that the walks of each span must reach on drawn items with all the edits allowed
STRIDES = {4: 1, 8: 2, 16: 4, 32: 8}  # span: documents are walked from every so many words, items from as many offsets
MOST_WALKS, SAMPLES, PLACES = 16, 5, 4
TRIALS = 200  # drawn items that a recall is measured on
ITEM_BYTES = 8 << 20  # items that one pass over the documents takes along

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SEEDS = np.random.default_rng(23)
_WALK = _SEEDS.integers(1, 1 << 62, MOST_WALKS, dtype=np.uint64)
_PHRASE = _SEEDS.integers(1, 1 << 62, LEAST_WORDS, dtype=np.uint64) | np.uint64(1)
_PAD = np.uint64(0x5851F42D4C957F2D)
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
#: Scripts written without spaces, by the first word of their characters' names (fixed values).
_UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN")


def _steps(span: int) -> int:
    return span + span // 2


_GAP = _steps(max(STRIDES))  # room after each text, so that a walk never enters the next one


def _plan(span: int, walk: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps and their factors. The first sample of all stays inside the span, so no exact copy is missed."""
    places = np.sort(_SEEDS.choice(_steps(span) if walk or sample else span, PLACES, replace=False))
    return places, _SEEDS.integers(1, 1 << 62, PLACES, dtype=np.uint64) | np.uint64(1)


_PLAN = {span: [[_plan(span, w, s) for s in range(SAMPLES)] for w in range(MOST_WALKS)] for span in STRIDES}


class _Symbols(dict):
    """What stands for a character: itself in a word, alone in a script without spaces, else a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        alone = unicodedata.name(c, "").split(" ")[0].split("-")[0] in _UNSPACED
        kind = unicodedata.category(c)[0]
        self[code] = " " if kind not in "LMN" else f" {c} " if alone else c
        return self[code]


_SYMBOLS = _Symbols()


def plain(text: str | None) -> str | None:
    """Lower case, with spaces around whatever is a symbol of its own and in place of other signs beyond ASCII."""
    if text is None or text.isascii():
        return text and text.lower()
    return _FOREIGN.sub(lambda run: run[0].translate(_SYMBOLS), text.lower())


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of plain texts: letters, marks and digits; the rest separates."""
    start, end, of = words(data, offsets, _SEPARATOR)
    return Prefixes(data).hash(start, end), of


def laid_out(word: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(words with room after each text, place of each word among them)."""
    place = np.arange(len(word)) + _GAP * of
    room = np.full(len(word) + _GAP * (texts + 1), _PAD)
    room[place] = word
    return room, place


def walk_keys(room: np.ndarray, begin: np.ndarray, span: int, walks: range) -> Iterator[np.ndarray]:
    """Keys of the windows that start at ``begin``, for each walk and sample."""
    for walk in walks:
        bits = mixed(room ^ _WALK[walk])
        plan = _PLAN[span][walk]
        keys = [np.full(len(begin), (walk * SAMPLES + s) * 64 + span, np.uint64) for s in range(SAMPLES)]
        at = begin.copy()
        for step in range(max(int(places[-1]) for places, _ in plan) + 1):
            hits = [(s, factors[places == step]) for s, (places, factors) in enumerate(plan) if step in places]
            if hits:
                symbol = room[at]
                for s, factor in hits:
                    keys[s] += symbol * factor
            at += (bits[at] >> np.uint64(step & 63) & np.uint64(1)).astype(at.dtype)
        yield from keys


def _windows(n: int, span: int) -> list[int]:
    """Offsets an item of ``n`` words is walked from: pieces overlap by half, the last reaches its end."""
    last = n - span - STRIDES[span] + 1
    return sorted({piece + o for piece in {*range(0, last + 1, span // 2), last // 2, last} for o in range(STRIDES[span])})


def span_of(n: int) -> int:
    """The longest span that fits an item of ``n`` words from each offset."""
    return max(s for s, stride in STRIDES.items() if s <= n - stride + 1)


@cache
def walks_needed(span: int, target: float = RECALL) -> int:
    """Least walks that find the target share of drawn items, whatever the edits are.

    Items of the shortest, a middle and the longest length of the span get all edits
    that are allowed: substitutions, insertions and deletions, spread or gathered.
    """
    lengths = [n for n in range(LEAST_WORDS, 2 * max(STRIDES) + 8) if span_of(n) == span]
    needed = 1
    for n in (lengths[0], lengths[len(lengths) // 2], lengths[-1]):
        for kind in ("substitute", "mix", "gather"):
            needed = max(needed, _walks_for(span, n, kind, target))  # one after the other: draws of all at once take 60 MB of the driver
    return needed


def _walks_for(span: int, n: int, kind: str, target: float) -> int:
    """Least walks that find the target share of drawn items of ``n`` words with one kind of edits; ``MOST_WALKS`` if none do."""
    draw = np.random.default_rng([n, len(kind)])
    items = draw.integers(1, 1 << 62, (TRIALS, n), dtype=np.uint64)
    copies = [edited(item, n * PERCENT // 100, kind, draw) for item in items]
    index, found = ItemIndex.of_words(list(items), {span: MOST_WALKS}), np.zeros(TRIALS, bool)
    of = np.repeat(np.arange(TRIALS), [len(c) for c in copies])
    for walk in range(MOST_WALKS):
        text, item, _ = index.candidates(np.concatenate(copies), of, TRIALS, range(walk, walk + 1)).T
        found[text[text == item]] = True
        if found.mean() >= target:
            return walk + 1
    return MOST_WALKS


def edited(item: np.ndarray, edits: int, kind: str, draw: np.random.Generator) -> np.ndarray:
    """A copy between other words, so many edits away: ``substitute``, ``mix`` (spread) or ``gather`` (in one run)."""
    copy, n = list(item), len(item)
    first = draw.integers(0, n - edits + 1)
    places = range(first, first + edits) if kind == "gather" else np.sort(draw.choice(n, edits, replace=False))
    for at in reversed(list(places)):
        act = draw.integers(3) if kind == "mix" else 0
        copy[at : at + (act != 1)] = draw.integers(1, 1 << 62, int(act != 2), dtype=np.uint64)
    around = draw.integers(1, 1 << 62, 60, dtype=np.uint64)
    return np.concatenate([around[: draw.integers(20)], np.array(copy, np.uint64), around[20:]])


@dataclass
class ItemIndex:
    """Items of one pass: their words, and the sorted keys of their windows."""

    ids: list
    words: list[np.ndarray]
    walks: dict[int, int]  # of each span in use
    keys: np.ndarray
    owner: np.ndarray  # item and offset of each key
    offset: np.ndarray
    near: np.ndarray  # one bit for each key, to turn most windows away early
    shift: np.uint64
    phrases: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted keys of short items, and the items

    @classmethod
    def build(cls, ids: list, texts: list[str]) -> ItemIndex:
        kept, lists = [], []
        for name, text in zip(ids, texts, strict=True):
            data = np.frombuffer((plain(text) or "").encode(), np.uint8)
            word, _ = text_words(data, np.array([0, len(data)]))
            if len(word):
                kept.append(name)
                lists.append(word)
        spans = {span_of(len(w)) for w in lists if len(w) >= LEAST_WORDS}
        return cls.of_words(lists, {s: walks_needed(s) for s in sorted(spans)}, kept)

    @classmethod
    def of_words(cls, lists: list[np.ndarray], walks: dict[int, int], ids: list | None = None) -> ItemIndex:
        by_span, short = defaultdict(list), defaultdict(list)
        for i, word in enumerate(lists):
            if len(word) < LEAST_WORDS:
                short[len(word)].append(i)
            else:
                span = span_of(len(word))
                by_span[span] += [(i, o) for o in _windows(len(word), span)]
        keys, owner, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        of = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
        room, place = laid_out(np.concatenate([np.zeros(0, np.uint64), *lists]), of, len(lists))
        starts = np.searchsorted(of, np.arange(len(lists)))
        for span, windows in by_span.items():
            i, o = np.array(windows).T
            for key in walk_keys(room, place[starts[i]] + o, span, range(walks[span])):
                keys.append(key)
                owner.append(i)
                offset.append(o)
        keys, owner, offset = np.concatenate(keys), np.concatenate(owner), np.concatenate(offset)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        bits = min(max(20, len(keys).bit_length() + 3), 26)
        shift = np.uint64(64 - bits)
        near = np.zeros(1 << bits, bool)
        near[(keys >> shift).astype(np.int64)] = True
        phrases = {}
        for n, own in short.items():
            key = (np.array([lists[i] for i in own]) * _PHRASE[:n]).sum(axis=1, dtype=np.uint64)
            by_key = np.argsort(key, kind="stable")
            phrases[n] = key[by_key], np.array(own)[by_key]
        return cls(ids or list(range(len(lists))), lists, walks, keys, owner[order], offset[order], near, shift, phrases)

    def candidates(self, word: np.ndarray, of: np.ndarray, texts: int, walks: range | None = None) -> np.ndarray:
        """Distinct (text, item, place) where an item may stand; the place is that of its first word."""
        found = [np.zeros((0, 3), np.int64)]
        starts = np.searchsorted(of, np.arange(texts))
        in_text = np.arange(len(word)) - starts[of]
        room, place = laid_out(word, of, texts)
        for span, most in self.walks.items():
            begin = np.flatnonzero(in_text % STRIDES[span] == 0)
            for key in walk_keys(room, place[begin], span, walks or range(most)):
                hit = np.flatnonzero(self.near[(key >> self.shift).astype(np.int64)])
                hit, entry = _equal(key, hit, self.keys)
                at = begin[hit]
                found.append(np.unique(np.stack([of[at], self.owner[entry], at - self.offset[entry]], 1), axis=0))
        for n, (keys, items) in self.phrases.items():
            if len(word) < n:
                continue
            own = np.zeros(len(word) - n + 1, np.uint64)
            for j in range(n):
                own += word[j : len(own) + j] * _PHRASE[j]
            hit, entry = _equal(own, np.flatnonzero(of[: len(own)] == of[n - 1 :]), keys)
            pairs = np.stack([of[hit], items[entry]], 1)
            pairs, first = np.unique(pairs, axis=0, return_index=True)
            found.append(np.column_stack([pairs, hit[first]]))
        return np.unique(np.concatenate(found), axis=0)


def _equal(own: np.ndarray, these: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``own``, place in the sorted ``keys``) of all equal pairs, for the places ``these``."""
    low, high = np.searchsorted(keys, own[these], "left"), np.searchsorted(keys, own[these], "right")
    times = high - low
    hit, low = np.repeat(these, times), np.repeat(low, times)
    return hit, low + np.arange(len(low)) - np.repeat(np.cumsum(times) - times, times)


def edit_distances(item: np.ndarray, word: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 4096) -> np.ndarray:
    """Least word edits that turn ``item`` into some stretch of each ``word[low:high]``."""
    best = np.full(len(low), len(item), np.int64)
    steps = np.arange(len(item) + 1)
    for a in range(0, len(low), most):
        lo, hi = low[a : a + most], high[a : a + most]
        row = np.broadcast_to(steps, (len(lo), len(steps))).copy()
        for j in range(int((hi - lo).max(initial=0))):
            inside = lo + j < hi
            symbol = word[np.where(inside, lo + j, 0)]
            fresh = np.empty_like(row)
            fresh[:, 0] = 0
            fresh[:, 1:] = np.minimum(row[:, :-1] + (item[None, :] != symbol[:, None]), row[:, 1:] + 1)
            fresh = np.minimum.accumulate(fresh - steps, axis=1) + steps
            row = np.where(inside[:, None], fresh, row)
            np.minimum(best[a : a + most], row[:, -1], out=best[a : a + most])
    return best


def _stretches(text: np.ndarray, place: np.ndarray, n: int, slack: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, low, high) that hold all windows of an item of ``n`` words; sorted places close together share one."""
    first = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(place // n) != 0)))
    last = np.append(first[1:], len(place)) - 1
    text = text[first]
    return text, np.maximum(place[first] - slack, edges[text]), np.minimum(place[last] + n + 2 * slack, edges[text + 1])


def _shares(item: np.ndarray, word: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, width: int) -> np.ndarray:
    """Whether some ``width`` neighbours in ``word[low:high]`` hold ``least`` words of the item, as all within reach do."""
    long = high - low
    start = np.cumsum(long) - long
    flat = np.arange(long.sum()) + np.repeat(low - start, long)
    own = np.unique(item)
    seen = own[np.minimum(np.searchsorted(own, word[flat]), len(own) - 1)] == word[flat]
    total = np.append(0, np.cumsum(seen))
    ends = np.minimum(np.arange(len(flat)) + width, np.repeat(start + long, long))
    return np.maximum.reduceat(total[ends] - total[:-1], start) >= least


def leaks(docs: DataFrame, benchmark: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs of documents and benchmark items that stand in them, up to a few edits.

    ``docs`` has the ``key`` columns and ``text``, ``benchmark`` has ``item_id`` and
    ``text``. An item of n words stands in a text if some stretch of
    the text turns into it by at most n/5 insertions, deletions and substitutions
    of words; items under 8 words must stand as they are. Returns the key, ``item_id``,
    ``item_words`` and ``distance``, one row for each row of ``docs`` and item that meet;
    every row is verified, and exact copies are never missed. Walks are repeated until edited
    copies reach ``RECALL`` on drawn items.

    Null and empty texts, and texts without a word, hold and match nothing; empty tables give no rows. Repeated
    rows are reported each, repeated items each as well, though equal texts are searched
    once. Items are taken along to the documents in portions
    of at most ``ITEM_BYTES``, as many passes as that needs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids = benchmark.select(F.sha2("text", 256).alias("item_digest"), "item_id")
    texts = benchmark.select(F.sha2("text", 256).alias("digest"), "text").dropna().dropDuplicates(["digest"])
    size = texts.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    portions = max(1, -(-size // ITEM_BYTES))
    out = StructType([
        *(docs.schema[c] for c in key), StructField("item_digest", StringType()),
        StructField("item_words", LongType()), StructField("distance", LongType()),
    ])
    found = spark.createDataFrame([], out)
    for portion in range(portions):
        # No more than about ITEM_BYTES of items.
        items = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(portions)) == portion).collect()
        index = spark.sparkContext.broadcast(ItemIndex.build([r["digest"] for r in items], [r["text"] for r in items]))
        found = found.unionByName(docs.select(*key, "text").mapInArrow(_search(index, key), out))
    return found.join(ids, "item_digest").select(*key, "item_id", "item_words", "distance")


def _search(index, key: tuple[str, ...]) -> Callable:  # noqa: ANN001
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = index.value
        for batch in parts(batches):
            lowered = pa.array([plain(t) for t in batch["text"].to_pylist()], pa.large_string())
            for first, offsets, data in blocks(lowered):
                word, of = text_words(data, offsets)
                if not len(word) or not items.ids:
                    continue
                limits = np.cumsum(np.bincount(of, minlength=len(offsets) - 1))
                text, item, place = items.candidates(word, of, len(offsets) - 1).T
                best: dict[tuple[int, int], int] = {}
                for i in np.unique(item):
                    wanted = items.words[i]
                    slack = PERCENT * len(wanted) // 100 if len(wanted) >= LEAST_WORDS else 0
                    t, low, high = _stretches(text[item == i], place[item == i], len(wanted), slack, np.concatenate([[0], limits]))
                    likely = _shares(wanted, word, low, high, len(wanted) - slack, len(wanted) + slack)
                    t, low, high = t[likely], low[likely], high[likely]
                    for k, d in zip(t.tolist(), edit_distances(wanted, word, low, high).tolist(), strict=True):
                        if d <= slack:
                            best[k, i] = min(d, best.get((k, i), d))
                rows = sorted(best.items())
                yield pa.record_batch(
                    [
                        *(batch[c].take(pa.array([first + k for (k, _), _ in rows], pa.int64())) for c in key),
                        pa.array([items.ids[i] for (_, i), _ in rows], pa.string()),
                        pa.array([len(items.words[i]) for (_, i), _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.int64()),
                    ],
                    [*key, "item_digest", "item_words", "distance"],
                )

    return search
