"""Token counts of a byte-level BPE, with a shortcut for whole tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CACHE = 200_000  # pre-tokens whose merged counts a worker remembers
CACHED_LENGTH = 64

#: White space, and the split of a text before merges.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


class TokenCounter:
    """Counts tokens as the tokenizer file does, special strings included.

    The file has to describe a byte-level BPE without normalizer, prefix space,
    truncation or padding; anything else is refused.
    """

    def __init__(self, tokenizer_json: str) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(tokenizer_json)
        split = spec["pre_tokenizer"] or {}
        plain = all(spec.get(k) is None for k in ("normalizer", "truncation", "padding", "post_processor"))
        if not plain or spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special strings that match by their surroundings are not supported")
        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._split = regex.compile(SPLIT)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._counts = _Counts(self.merge)
        self._counts.update(dict.fromkeys(self.whole_tokens(), 1))
        self._whole = len(self._counts)

    def whole_tokens(self) -> list[str]:
        """Vocabulary strings proven to come out as one token when they stand alone.

        Not every entry does: some cannot be reached by merges, and some are cut
        before merging. Each is encoded once, and kept if it is one pre-token
        that gives back its own id.
        """
        vocab = self._tokenizer.get_vocab(with_added_tokens=False)
        spelled = {v: k for k, v in _byte_letters().items()}
        found = []
        for piece, number in vocab.items():
            try:
                text = bytes(spelled[c] for c in piece).decode()
            except (UnicodeDecodeError, KeyError):
                continue
            if self._split.findall(text) == [text] and [t.id for t in self._tokenizer.model.tokenize(piece)] == [number]:
                found.append(text)
        return found

    def merge(self, word: str) -> int:
        """Tokens of one pre-token by merging."""
        spelled = self._spell.pre_tokenize_str(word)
        return sum(len(self._tokenizer.model.tokenize(piece)) for piece, _ in spelled)

    def count(self, text: str) -> int:
        if len(self._counts) > self._whole + CACHE:
            fresh = _Counts(self.merge)
            fresh.update(dict.fromkeys(self.whole_tokens(), 1))
            self._counts = fresh
        if self._special is None:
            return sum(map(self._counts.__getitem__, self._split.findall(text)))
        parts = self._special.split(text)
        return len(parts) - 1 + sum(sum(map(self._counts.__getitem__, self._split.findall(p))) for p in parts)


class _Counts(dict):
    """Counts by pre-token; what is missing is merged, and remembered unless long."""

    def __init__(self, merge) -> None:  # noqa: ANN001
        super().__init__()
        self._merge = merge

    def __missing__(self, word: str) -> int:
        n = self._merge(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = n
        return n


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte.

    Printable bytes stand for themselves, the others follow from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``) of each row.

    ``tokenizer_json`` is the content of a tokenizer file, whose size bounds what
    is broadcast; executors need no copy of the file. Null text counts as empty,
    with 0 tokens. Whole texts are counted, one row out for each row in.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = sent.value
        if spec not in _counters:
            _counters[spec] = TokenCounter(spec)
        counter = _counters[spec]
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
            n_tokens = np.array([counter.count(t) for t in texts], np.int64)
            yield pa.record_batch(
                [batch["doc_id"], pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
