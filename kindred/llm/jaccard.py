"""N-gram Jaccard join with token-combination prefixes.

Sets are sorted by a hash of their tokens. Two sets that reach the threshold
differ in few tokens, so among their first ones some two neighbours are common to
both and neighbours in both; how many are enough follows from the threshold alone
(``_prefix_length``). Each token of such a prefix is indexed by itself while it is
rare, and by the combination with its neighbour once it is frequent. Sets that
combinations still bring together in crowds are indexed anew among themselves, by
their rarest tokens and with the places of these, so that near copies just below
the threshold, which differ by tokens of their own, no longer meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.bytehash import Prefixes, blocks, lower_ascii, mixed, parts, small_batches, words
from kindred.llm.components import components
from kindred.llm.words import WORD
from kindred.session import forget, written

FREQUENT = 16  # a token that so many sets show in their prefix is indexed in combinations
WIDE = 64  # the sets of an entry of more are indexed anew before pairs are formed
LEAST_PERCENT = 70  # below this, a combination of two may not fit a set
BITS = 512  # of the parity map of a set
_LONGS = BITS // 64
_FIRST = -(2**63)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_WHOLE = "id long, n long, set array<long>, brief array<short>"


def jaccard_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of ``jaccard_groups``."""
    return jaccard_groups(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Groups of documents that chains of links connect.

    ``docs`` has ``doc_id`` and ``text``. A text's set holds its distinct
    ``size``-word shingles, A-Z in lower case; with fewer words the whole
    sequence is the only one, without words the set is empty. Two documents link
    if 100 times the common shingles reach ``percent`` times all of both; it is
    ``LEAST_PERCENT`` or more. Returns ``doc_id``, ``n_shingles``, ``component_id`` (smallest id of the
    group), ``digest`` (hash of the text) and ``label`` (a number of the group,
    null for an empty set), one row per input row.

    Texts with equal sets are one node, so copies are never compared. Candidates
    are first compared with one hub of their index entry; what the hubs connect
    needs no further comparison, and only pairs that are still apart are compared
    directly. No candidate is left out.

    Null text counts as empty; empty sets link with nothing. Rows with the same
    id and different texts are separate nodes, rows with the same id and text are
    copies. Null ids take part; a group that has no other id gets null. An empty
    table gives an empty one.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent lies between {LEAST_PERCENT} and 100")
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(_FIRST)).cast("long").alias("doc"), "text", F.xxhash64("text").alias("digest"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = rows.mapInArrow(_prefixes(size, percent), f"doc_id {kind}, doc long, digest long, n long, mark binary, prefix array<long>, sketch array<int>, bits array<long>")
    seen = written(seen, "jaccard-prefixes")
    sets = seen.filter("prefix IS NOT NULL").groupBy("mark").agg(F.min(F.struct("doc", "digest", "n", "prefix", "sketch", "bits")).alias("s"))
    prefixes = written(sets.select("mark", "s.*", F.monotonically_increasing_id().alias("id")), "jaccard-prefixes")
    with_prefixes, seen = seen, written(seen.drop("doc", "prefix", "sketch", "bits"), "jaccard-rows")
    forget(with_prefixes)
    entries = _index(prefixes)
    sets = written(prefixes.drop("prefix"), "jaccard-sets")
    forget(prefixes)

    links = _hub_links(entries, sets, rows, size, percent)
    groups = written(components(links).withColumnRenamed("node", "id").withColumnRenamed("component", "label"), "jaccard-groups")
    apart = _still_apart(entries, sets, groups, rows, size, percent)
    more = _verified(apart, sets, rows, size, percent)
    forget(entries)
    if not more.isEmpty():
        groups = components(links.unionByName(more)).withColumnRenamed("node", "id").withColumnRenamed("component", "label")

    least = seen.filter("n > 0").groupBy("mark").agg(F.min("doc_id").alias("own"))
    nodes = sets.select("mark", "id").join(groups, "id", "left").select("mark", F.coalesce("label", "id").alias("label"))
    nodes = written(nodes.join(least, "mark"), "jaccard-nodes")
    roots = nodes.groupBy("label").agg(F.min("own").alias("component_id"))
    found = nodes.join(roots, "label").select("mark", "label", "component_id")
    full = seen.filter("n > 0").join(found, "mark").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "digest", "label")
    empty = seen.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "digest", F.lit(None).cast("long").alias("label"))
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: of the smallest id, then of the smallest hash of its text.

    Texts without words stay, as they link with nothing. Rows with the same id
    and text are copies of each other; the one whose other columns have the
    smallest hash stays. All columns are kept, whatever their names.
    """
    groups = jaccard_groups(docs, size, percent).filter("label IS NOT NULL")
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(_FIRST)).cast("long").alias("doc"), "digest")
    first = groups.groupBy("label").agg(F.min(place).alias("f")).select("f.*")
    row = F.struct("*")
    marked = docs.select(row.alias("row"), F.coalesce(F.col("doc_id"), F.lit(_FIRST)).cast("long").alias("doc"), F.xxhash64("text").alias("digest"))
    has_words = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    kept = marked.filter(has_words).join(first, ["doc", "digest"], "left_semi")
    kept = kept.groupBy("doc", "digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*").unionByName(marked.filter(~has_words).select("row.*"))


def _index(sets: DataFrame) -> DataFrame:
    """Index entries (``key``, ``id``, size ``n``, place ``at``) of tokens that at least two sets have, and how common their tokens are.

    All tokens of all prefixes are shuffled, so they take along no more than
    their place; what only few of them need comes from the sets afterwards.
    """
    tokens = sets.select("id", F.posexplode("prefix").alias("at", "token"))
    shared = written(tokens.groupBy("token").count().filter("count > 1"), "jaccard-tokens")
    held = written(tokens.join(shared, "token").select("id", "at", "token", "count"), "jaccard-held")
    whole = held.join(sets.select("id", "n", "prefix"), "id")
    following = F.get("prefix", F.col("at") + 1)
    pair = F.when(following.isNotNull(), F.xxhash64("token", following))
    key = F.when(F.col("count") < FREQUENT, F.col("token")).otherwise(pair)
    entries = written(whole.select(key.alias("key"), "id", "n", "at", "count").filter("key IS NOT NULL"), "jaccard-index")
    forget(held)
    return entries


def _hub_links(entries: DataFrame, sets: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the hub of each entry and its other sets.

    The hub is the set whose tokens are the most common: of near copies, the one
    with the fewest words of its own.
    """
    common = written(entries.groupBy("id").agg(F.sum("count").alias("common")), "jaccard-common")
    weighed = entries.join(common, "id").select("key", "id", "n", "common")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("common", "id", "n")).alias("hub"), F.count("*").alias("times"))
    hubs = hubs.filter("times > 1").select("key", "hub")
    alike = _sizes_allow("n", "hub.n", percent)
    pairs = entries.join(hubs, "key").filter("id <> hub.id").filter(alike)
    pairs = pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
    return _verified(pairs.distinct(), sets, rows, size, percent)


def _still_apart(entries: DataFrame, sets: DataFrame, groups: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of sets with a common entry that no chain of links connects yet.

    Entries of many sets are those of widely shared passages and of large groups
    of near copies. Their sets are indexed anew, among themselves.
    """
    info = sets.select("id", "bits").join(groups, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "bits")
    info = written(info, "jaccard-info")
    held = entries.groupBy("key").count().filter("count > 1").select("key")
    placed = written(entries.join(held, "key").join(info.drop("bits"), "id").select("key", "id", "n", "at", "label"), "jaccard-labelled")
    split = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("times"))
    labelled, placed = placed, written(placed.join(split.filter("low < high").select("key", "times"), "key"), "jaccard-apart")
    forget(labelled)
    few = placed.filter(F.col("times") <= WIDE)
    many = placed.filter(F.col("times") > WIDE).select("id").distinct()
    rare = _rarest(sets.join(many, "id", "left_semi"), rows, size, percent)
    return _met(few, info, percent, _within_combinations).union(_met(rare, info, percent, _within_rarest)).distinct()


def _rarest(sets: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Index entries of some sets among themselves: the tokens a set may lack and one more, the rarest first.

    Tokens that no other of these sets has are the rarest and need no entry, only
    their number: a set with more of them than it may lack links with no other.
    """
    whole = written(_texts(sets, rows).mapInArrow(_whole(size), _WHOLE).select("id", "n", "set"), "jaccard-crowd")
    lacking = F.expr(f"n - ({percent} * n + 99) DIV 100")
    alone = whole.select("id", F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("times"), F.min("id").alias("id")).filter("times = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("own"))
    near = whole.join(alone, "id", "left").filter(F.coalesce("own", F.lit(0)) <= lacking).select("id", "n", "set")
    crowd, whole = whole, written(near, "jaccard-near")
    forget(crowd)
    tokens = whole.select("id", "n", F.explode("set").alias("token"))
    common = tokens.groupBy("token").count().filter("count > 1")
    shared = tokens.join(common, "token").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("count", "token"))).alias("shared"))
    own = F.col("n") - F.size("shared")
    prefix = F.slice("shared", 1, F.greatest(lacking - own + 1, F.lit(0)).cast("int"))
    entries = shared.select("id", "n", own.alias("own"), F.posexplode(prefix).alias("at", "t"))
    entries = written(entries.select(F.col("t.token").alias("key"), "id", "n", (F.col("at") + F.col("own")).alias("at")), "jaccard-rarest")
    forget(whole)
    return entries


def _met(entries: DataFrame, info: DataFrame, percent: int, within: Callable[[int], Column]) -> DataFrame:
    """Pairs of sets of different groups that an entry brings together, unless places or parity maps rule them out.

    A bit of a parity map tells whether an odd number of the tokens that fall on
    it is there, so maps differ in no more bits than sets in tokens.
    """
    bits = (F.col("bits")[i].alias(f"b{i}") for i in range(_LONGS))
    entries = entries.select("key", "id", "n", "at").join(info.select("id", "label", *bits), "id")
    differ = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(_LONGS)), F.lit(0))
    apart = F.expr("x.key = y.key AND x.label <> y.label AND x.id < y.id") & _sizes_allow("x.n", "y.n", percent)
    met = entries.alias("x").join(entries.alias("y"), apart & within(percent) & _few_enough(differ, percent))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _few_enough(differ: Column, percent: int) -> Column:
    """Whether two sets that differ in so many tokens at least can reach the threshold."""
    return differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)


def _within_rarest(percent: int) -> Column:
    """Places of a token that can be the first common one.

    What stands before it is not common, and of what follows one set has more by the difference.
    """
    i, j, more = F.col("x.at"), F.col("y.at"), F.col("x.n") - F.col("y.n")
    return _few_enough(2 * i - more, percent) & _few_enough(2 * j + more, percent)


def _within_combinations(percent: int) -> Column:
    """Places of an entry that can be the first common one.

    A common token before it is frequent, and is followed by one that is not
    common before the next: two in three tokens before it at the most are common,
    and no more than the fewer of both.
    """
    i, j = F.col("x.at"), F.col("y.at")
    after = F.abs((F.col("x.n") - i) - (F.col("y.n") - j))
    return _few_enough((i + j) / 3 + after, percent) & _few_enough(F.abs(i - j) + after, percent)


def _prefix_length(n: int, percent: int) -> int:
    """Tokens after which two sets that reach the threshold have two neighbours in common.

    Bounds the tokens of one set that the other lacks, and those of both. What is
    common, in order, is cut by the latter into as many runs and one more; if
    none is longer than one token, there are too few.
    """
    return n - -(-percent * n // 100) + (100 - percent) * n // percent + 2


def _sizes_allow(x: str, y: str, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs that reach the threshold: by their first tokens, by parts of all tokens, then by whole sets."""
    pairs = written(_compared(pairs, sets.select("id", "n", F.col("sketch").alias("set")), _possible(percent)), "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = _texts(sets.join(wanted, "id", "left_semi"), rows)
    whole = written(texts.mapInArrow(_whole(size), _WHOLE), "jaccard-whole")
    likely = written(_compared(pairs, whole.select("id", "n", F.col("brief").alias("set")), _likely(percent)), "jaccard-likely")
    links = written(_compared(likely, whole, _reached(percent)), "jaccard-links")
    forget(whole)
    return links


def _texts(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of some sets, with the marks and ids of what is wanted of them: each text once, however often its row repeats."""
    wanted = sets.groupBy("doc", "digest").agg(F.collect_list(F.struct("mark", "id")).alias("marks"))
    found = rows.select("doc", "digest", "text").join(wanted, ["doc", "digest"])
    return found.dropDuplicates(["doc", "digest"]).select("text", "marks")


def _compared(pairs: DataFrame, lists: DataFrame, passes: Callable) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            pairs = zip(_arrays(batch["sa"]), _arrays(batch["sb"]), batch["na"].to_pylist(), batch["nb"].to_pylist(), strict=True)
            good = [passes(*pair) for pair in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = pairs.join(lists.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa")), "a")
    both = first.join(lists.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(compare, "a long, b long")


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    """The lists of a column without nulls, as views of its values."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _held(x: np.ndarray, y: np.ndarray) -> int:
    """Number of elements of ``x`` that ``y``, which is sorted, has too."""
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def _possible(percent: int) -> Callable:
    """Whether the first tokens leave room for the threshold: they may not differ by more than whole sets may.

    Tokens are cut to their upper half here, which can only make sets look more alike.
    """
    def passes(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
        ends = [s[-1] for s, n in ((x, nx), (y, ny)) if len(s) < n]
        if ends:
            x, y = x[: np.searchsorted(x, min(ends))], y[: np.searchsorted(y, min(ends))]
        common = _held(x, y)
        return (100 + percent) * (len(x) + len(y) - 2 * common) <= (100 - percent) * (nx + ny)

    return passes


def _likely(percent: int) -> Callable:
    """Whether whole sets reach the threshold as far as 16 bits of each token can tell, which is never too few."""
    seen = np.zeros(1 << 16, bool)

    def held(x: np.ndarray, y: np.ndarray) -> int:
        seen[y] = True
        common = np.count_nonzero(seen[x])
        seen[y] = False
        return common

    def passes(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
        x, y = x.view(np.uint16), y.view(np.uint16)
        common = min(held(x, y), held(y, x))
        return 100 * common >= percent * (nx + ny - common)

    return passes


def _reached(percent: int) -> Callable:
    def passes(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
        common = _held(x, y)
        return 100 * common >= percent * (nx + ny - common)

    return passes


def _shingles(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text."""
    for first, offsets, data in blocks(batch["text"]):
        data = lower_ascii(data)
        prefixes = Prefixes(data)
        start, end, of = words(data, offsets)
        word = prefixes.hash(start, end)
        count = np.bincount(of, minlength=len(offsets) - 1)
        total = np.zeros(len(word), np.uint64)
        odd = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
        last = np.cumsum(count)[of]  # index after the last word of the same text
        for j in range(size):
            there = np.flatnonzero(np.arange(len(word)) + j < last)
            total[there] += word[there + j] * odd[j]
        at = np.arange(len(word))
        keep = (at + size <= last) | ((at == last - count[of]) & (count[of] < size))
        token = mixed(total[keep]).view(np.int64)
        of = of[keep]
        order = np.lexsort((token, of))
        token, of = token[order], of[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
        token, of = token[new], of[new]
        cuts = np.searchsorted(of, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            yield first + i, token[cuts[i] : cuts[i + 1]]


def _mark(tokens: np.ndarray) -> bytes:
    """Hash of a set, of 128 bits."""
    token = tokens.view(np.uint64)
    sums = np.array([mixed(token).sum(dtype=np.uint64), mixed(token ^ _OTHER).sum(dtype=np.uint64)])
    return mixed(sums + np.uint64(len(token))).tobytes()


def _parity(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount(tokens & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(size: int, percent: int) -> Callable:
    """Size, mark and prefix of each text's set; sets that a task repeats come with their prefix once."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set()
        for batch in parts(batches):
            sizes, marks, prefixes, sketches, bits = [], [], [], [], []
            for _, tokens in _shingles(batch, size):
                n, mark = len(tokens), _mark(tokens)
                fresh = n and mark not in known
                sizes.append(n)
                marks.append(mark)
                prefixes.append(tokens[: _prefix_length(n, percent)] if fresh else None)
                sketches.append((tokens[: 16 + n * (100 - percent) // 120] >> 32).astype(np.int32) if fresh else None)
                bits.append(_parity(tokens) if fresh else None)
                known.add(mark)
            yield pa.record_batch(
                [
                    batch["doc_id"], batch["doc"], batch["digest"], pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64())),
                ],
                ["doc_id", "doc", "digest", "n", "mark", "prefix", "sketch", "bits"],
            )

    return read


def _whole(size: int) -> Callable:
    """Whole sets of the wanted marks."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in parts(batches):
            wanted = [{m["mark"]: m["id"] for m in row} for row in batch["marks"].to_pylist()]
            out = []
            for i, tokens in _shingles(batch, size):
                number = wanted[i].get(_mark(tokens))
                if number is not None and number not in done:
                    done.add(number)
                    out.append((number, len(tokens), tokens, tokens.astype(np.int16)))
            number, n, found, brief = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch(
                [pa.array(number, pa.int64()), pa.array(n, pa.int64()), pa.array(list(found), pa.list_(pa.int64())), pa.array(list(brief), pa.list_(pa.int16()))],
                ["id", "n", "set", "brief"],
            )

    return read
