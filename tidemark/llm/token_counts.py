"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a linked list of byte symbols, the last with the end-of-word mark. A heap holds its adjacent pairs
by merge rank, then place; the lowest is popped, and joined if both neighbours still stand as they stood. The count
is the number of first symbols less the number of merges; no identifiers are put out.

The vocabulary file says how text becomes words: strings of added tokens are cut out of the raw text and count as
one token each, what is left is normalised (composed, white space to one space, lower case character by character)
and split by a pattern. For texts below U+0530 this is done here in bulk; for others the file's own normaliser and
splitter are asked, since libraries differ in their Unicode versions. Words come back often, so a worker remembers
counts of short ones; the memory is bounded and results do not depend on it.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results, an empty table none; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import byte_characters
from tidemark.llm.common import PLAIN_SPACE, BoundedCache, is_plain, per_text, plain_class

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS, CACHE_CHARS = 500_000, 64

_L, _N = plain_class("L"), plain_class("N")
#: Splits plain texts as the vocabulary's pattern does, with classes spelt out, which is faster.
_WORDS = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{PLAIN_SPACE}{_L}{_N}]+")
_PIECES = re.compile("[^ \t\n\r\f\v]+")


class HeapBpe:
    """Counts tokens of one worker's texts."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        library, model = Tokenizer.from_str(vocabulary), spec["model"]
        self._normal, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        ids, shown, end = model["vocab"], byte_characters(), model["end_of_word_suffix"] or ""
        self._inner, self._last = [ids[c] for c in shown], [ids[c + end] for c in shown]
        self._byte = {c: b for b, c in enumerate(shown)}
        # Two adjacent symbols a, b are the number a * size + b; it leads to their rank, the rank to what they become.
        self._size = len(ids)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._rank = {ids[a] * self._size + ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self._joined = [ids[a + b] for a, b in pairs]
        self._words = BoundedCache(lambda word: self.merged_count(word.encode()), CACHE_WORDS, CACHE_CHARS)
        self._pieces = BoundedCache(self._piece, CACHE_WORDS, CACHE_CHARS)

    def merged_count(self, word: bytes) -> int:
        """Tokens of one word: its bytes less the merges."""
        rank, size = self._rank.get, self._size
        symbols = [self._inner[b] for b in word]
        symbols[-1] = self._last[word[-1]]
        count = end = len(symbols)
        heap = [
            found << 32 | i
            for i, pair in enumerate(zip(symbols, symbols[1:]))
            if (found := rank(pair[0] * size + pair[1])) is not None
        ]
        if not heap:
            return count
        heapq.heapify(heap)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while heap:
            lowest = heapq.heappop(heap)
            i, lowest = lowest & 0xFFFFFFFF, lowest >> 32
            j = after[i]
            # The entry holds only if the pair that stands here now is still the one it was made for.
            if symbols[i] < 0 or j == end or rank(symbols[i] * size + symbols[j]) != lowest:
                continue
            joined = symbols[i] = self._joined[lowest]
            symbols[j] = -1
            count -= 1
            k = after[i] = after[j]
            if k != end:
                before[k] = i
                if (found := rank(joined * size + symbols[k])) is not None:
                    heapq.heappush(heap, found << 32 | i)
            h = before[i]
            if h >= 0 and (found := rank(symbols[h] * size + joined)) is not None:
                heapq.heappush(heap, found << 32 | h)
        return count

    def _piece(self, piece: str) -> int:
        """A piece without ASCII white space, by the file's own normaliser and splitter."""
        words = (shown for shown, _ in self._split(self._normal(piece)) if shown)
        return sum(self.merged_count(bytes(map(self._byte.__getitem__, shown))) for shown in words)

    def _part(self, text: str) -> int:
        # A capital sigma's lower case depends on its neighbours in Python alone.
        composed = unicodedata.normalize("NFC", text)
        if is_plain(composed) and "\u03a3" not in composed:
            return sum(map(self._words.__getitem__, _WORDS.findall(composed.lower())))
        return sum(map(self._pieces.__getitem__, _PIECES.findall(text)))

    def count(self, text: str) -> int:
        parts = self._added.split(text) if self._added else [text]
        return len(parts) - 1 + sum(self._part(part) for part in parts if part)


_workers: dict[str, HeapBpe] = {}


def worker(vocabulary: str) -> HeapBpe:
    """The worker's counter, built once for each vocabulary; only the last one is kept."""
    if vocabulary not in _workers:
        _workers.clear()
        _workers[vocabulary] = HeapBpe(vocabulary)
    return _workers[vocabulary]


def token_counts(documents: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    The vocabulary is read on the driver and sent to the workers: its size does not depend on the data.
    """
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        vocabulary = documents.sparkSession.sparkContext.broadcast(file.read())

    def make():
        counter = worker(vocabulary.value)
        return lambda text: (len(text.encode()), counter.count(text))

    run = per_text(["doc_id"], make, ["n_bytes", "n_tokens"], [pa.int64(), pa.int64()])
    kind = dict(documents.dtypes)["doc_id"]
    counted = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
