"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file lists the vocabulary in order of merging. A tokenizer is built from it once: bytes are mapped to
characters, every token's last merge is found by merging its own bytes with the earlier ranks, and the splitting
pattern cuts a text into matches that are encoded separately. A text is handed to the library in chunks, each a match
of the pattern where its characters are plain, otherwise ending before a space that follows a visible character: no
match crosses such a place. So chunks are encoded as they would be within the text, and equal ones only once.

Ids are kept packed, as little-endian unsigned 32-bit integers. Decoding looks every id up in a table of bytes and
joins the bytes before any character is formed, so characters that are split over tokens come out whole.

Null and empty texts encode to no ids. Rows stay as they are: repeated rows give repeated results, an empty table
none, and columns other than the ones named are ignored. Text that is one match of any length goes to the library as one chunk.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PLAIN_SPACE, BoundedCache, is_plain, plain_class, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Chunks of a worker whose ids are remembered, and the longest chunk that is.
CACHE_CHUNKS, CACHE_CHARS = 400_000, 64

_CHUNK_END = re.compile(r"(?<=\S)(?= )")
_L, _N = plain_class("L"), plain_class("N")
#: Splits plain texts as public_tokenizers.PATTERN does, with classes spelt out, which is faster.
_PLAIN_MATCHES = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{PLAIN_SPACE}{_L}{_N}]+"
    f"|[{PLAIN_SPACE}]+(?![^{PLAIN_SPACE}])|[{PLAIN_SPACE}]+"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a token in base 64 and its rank in every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    mapped = {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}
    return [mapped[b] for b in range(256)]


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that are joined last when the token's bytes are merged by lower ranks."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank >= own:
            raise ValueError(f"token of rank {own} cannot be reached by merges")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The library's tokenizer for a rank table and a splitting pattern, as text."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    text = {token: "".join(shown[b] for b in token) for token in ranks}
    ordered = sorted((token for token in ranks if len(token) > 1), key=ranks.__getitem__)
    merges = [tuple(text[part] for part in last_merge(token, ranks)) for token in ordered]
    tokenizer = Tokenizer(models.BPE(vocab={text[token]: rank for token, rank in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer.to_str()


def byte_table(tokenizer: str) -> list[bytes]:
    """Each id's bytes, by reversing the mapping of bytes to characters."""
    back = {c: bytes([b]) for b, c in enumerate(byte_characters())}
    vocabulary = json.loads(tokenizer)["model"]["vocab"]
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        table[number] = b"".join(back[c] for c in token)
    return table


def char_offsets(encoded: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last character of each token; tokens that share a split character overlap in it."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    character = np.cumsum((np.frombuffer(encoded, np.uint8) & 0xC0) != 0x80) - 1
    if not len(character):
        return starts, ends
    return character[starts], character[ends - 1] + 1


class ByteBpe:
    """Encoder and decoder of one worker."""

    def __init__(self, tokenizer: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(tokenizer)
        self._bytes = byte_table(tokenizer)
        self._sizes = np.array([len(b) for b in self._bytes], np.int64)
        self._own_split = pattern == public_tokenizers.PATTERN
        self._ids = BoundedCache(self._encode_chunk, CACHE_CHUNKS, CACHE_CHARS)

    def _encode_chunk(self, chunk: str) -> bytes:
        return np.array(self._library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = _PLAIN_MATCHES if self._own_split else None
        chunks = [plain.findall(t) if plain and is_plain(t) else _CHUNK_END.split(t) for t in texts]
        known = self._ids
        new = [c for c in set().union(*chunks) if c not in known and len(c) <= CACHE_CHARS]
        for chunk, found in zip(new, self._library.encode_batch_fast(new, add_special_tokens=False)):
            known.keep(chunk, np.array(found.ids, "<u4").tobytes())
        return [b"".join(map(known.__getitem__, own)) for own in chunks]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def offsets(self, packed: bytes, decoded: bytes) -> tuple[np.ndarray, np.ndarray]:
        return char_offsets(decoded, self._sizes[np.frombuffer(packed, "<u4")])


_workers: dict[tuple[str, str], ByteBpe] = {}


def _worker(tokenizer: str, pattern: str) -> ByteBpe:
    """The worker's encoder, built once for each tokenizer; only the last one is kept."""
    if (tokenizer, pattern) not in _workers:
        _workers.clear()
        _workers[tokenizer, pattern] = ByteBpe(tokenizer, pattern)
    return _workers[tokenizer, pattern]


def encode_decode(
    documents: DataFrame,
    keep: list[str],
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    with_offsets: bool = False,
) -> DataFrame:
    """Columns `keep` with packed_ids (binary), decoded (binary) and, if asked, char_starts and char_ends.

    The vocabulary is read on the driver and sent to the workers: its size does not depend on the data. A text's
    decoded bytes equal its UTF-8 bytes.
    """
    tokenizer = documents.sparkSession.sparkContext.broadcast(
        tokenizer_json(read_ranks(path or public_tokenizers.path(RANKS)), pattern)
    )
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(tokenizer.value, pattern)
        for batch in slices(batches):
            packed = bpe.encode([text or "" for text in batch.column("text").to_pylist()])
            decoded = [bpe.decode(ids) for ids in packed]
            arrays = [batch.column(name) for name in keep] + [pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())]
            names = [*keep, "packed_ids", "decoded"]
            if with_offsets:
                spans = [bpe.offsets(ids, text) for ids, text in zip(packed, decoded)]
                arrays += [pa.array([s[k] for s in spans], longs) for k in (0, 1)]
                names += ["char_starts", "char_ends"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    types = dict(documents.select(*keep).dtypes)
    schema = [f"`{name}` {types[name]}" for name in keep] + ["packed_ids binary", "decoded binary"]
    schema += ["char_starts array<bigint>", "char_ends array<bigint>"] if with_offsets else []
    return documents.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, ", ".join(schema))


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of the packed ids and of the decoded bytes."""
    return encode_decode(documents, ["doc_id"], path).select(
        "doc_id",
        (F.octet_length("packed_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
