"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon keeps terms within a band of inverse document frequency, counted over all documents. A document's distinct
terms in the lexicon are sorted, and hashed once for each of several random subsets of the lexicon. Subsets come in
sizes from a half of the lexicon to a 4096th: large ones change with any edit, small ones outlast larger edits, so the
share of equal hashes tells how alike two texts are. Of a size, subsets count that hold a term of either text, and the
more, the fewer of them do: where a subset mostly holds one term, the share of equal ones is that of common terms.
Which sizes these are depends on the texts' lengths, so there are as many subsets of every size.

The lexicon is held by hashed term: terms fall into a fixed number of slots, and a slot's document frequency is that
of the terms in it together. So what is sent to the workers is a bitmap of fixed size, however many terms there are.
A document with no term in the band uses all its terms, one without any term its whole text.

The neighbour a text is compared with and edited by is the next document in descending order of ids. Documents are
dealt into ranges of ids, a range is sorted in a task, and the first document of a range is sent to the range before
as well, so each text crosses the network once.

Null and empty texts have no terms and an edited text as long. Equal texts have equal fingerprints. Rows without an
id come last, rows of one id stand in order of their texts. A single document is its own next. Extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Slots of the hashed lexicon, as a power of two.
SLOT_BITS = 22
#: Subsets by size: a size is minus a power of two, and there are so many subsets of it.
SUBSETS = {1: 2} | dict.fromkeys(range(2, 13), 10)
#: Hexadecimal digits of one subset's hash; zero if it has no term of the text.
DIGITS = 4
#: Terms that are drawn for at a time.
TERMS_AT_ONCE = 1 << 15
#: Ranges of ids at most, whose ends the driver holds.
MOST_RANGES = 1 << 14

_TERM = re.compile(r"\w+")
_POWERS = np.repeat(list(SUBSETS), list(SUBSETS.values()))
#: A product of a term's hash and a salt decides for four subsets, by 16 of its bits each.
_SALTS = np.random.default_rng(11).integers(1 << 63, size=-(-len(_POWERS) // 4), dtype=np.uint64) | np.uint64(1)
_LIMITS = np.array([1 << (16 - int(p)) for p in _POWERS], np.uint16)
#: The first subset of each size, and what one of a size weighs at least of which all hold terms.
_FIRSTS, _LEAST_WEIGHT = np.concatenate([[0], np.cumsum(list(SUBSETS.values()))[:-1]]), 0.02


def terms(text: str) -> list[str]:
    """A text's distinct terms, sorted."""
    return sorted(set(_TERM.findall(text.lower())))


def term_hashes(ordered: list[str]) -> np.ndarray:
    """64-bit hashes of terms: CRC-32 spread over 64 bits; the upper bits choose a term's slot."""
    low = np.fromiter((zlib.crc32(t.encode()) for t in ordered), np.uint64, len(ordered))
    mixed = (low + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a term of each slot."""
    counts = np.zeros(1 << SLOT_BITS, np.int32)
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            counts[np.unique(slots(term_hashes(terms(text or ""))))] += 1
    used = np.flatnonzero(counts)
    found = [used, counts[used]]
    for start in range(0, len(used), 1 << 16):
        part = [pa.array(f[start : start + (1 << 16)].astype(np.int32)) for f in found]
        yield pa.RecordBatch.from_arrays(part, ["slot", "n"])


def lexicon(documents: DataFrame, lowest_idf: float, highest_idf: float) -> np.ndarray:
    """A packed bitmap of the slots whose inverse document frequency lies within the band.

    Inverse document frequency is log2 of documents by documents with a term of the slot. The driver gathers the
    bitmap, 64 slots to a number.
    """
    total = documents.count()
    counted = documents.select("text").mapInArrow(_count_slots, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n"))
    idf = F.log2(F.lit(float(total))) - F.log2("n")
    kept = counted.where((idf >= lowest_idf) & (idf <= highest_idf))
    packed = kept.groupBy(F.expr("slot div 64").cast("int").alias("place")).agg(F.expr("bit_or(shiftleft(1L, slot % 64))").alias("bits"))
    found, bitmap = packed.toArrow(), np.zeros(1 << (SLOT_BITS - 6), np.uint64)
    bitmap[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return np.packbits(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def in_subsets(hashes: np.ndarray) -> np.ndarray:
    """A row for each subset, telling which of the terms it holds."""
    drawn = hashes * _SALTS[:, None]
    drawn = (drawn ^ (drawn >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    drawn ^= drawn >> np.uint64(32)
    lanes = drawn.astype("<u8").view("<u2").reshape(len(_SALTS), -1, 4).transpose(0, 2, 1)
    return lanes.reshape(4 * len(_SALTS), -1)[: len(_LIMITS)] < _LIMITS[:, None]


def fingerprint(text: str, kept: np.ndarray) -> np.ndarray:
    """A 16-bit hash for each subset. `kept` says for each slot whether it is in the lexicon."""
    hashes = term_hashes(terms(text))
    in_band = hashes[kept[slots(hashes)]] if len(hashes) else hashes
    hashes = in_band if len(in_band) else hashes
    if not len(hashes):
        return np.full(len(_LIMITS), zlib.crc32(text.encode()) & 0xFFFF or 1, ">u2")
    starts = range(0, len(hashes), TERMS_AT_ONCE)
    pieces = [np.nonzero(in_subsets(hashes[start : start + TERMS_AT_ONCE])) for start in starts]
    subset = np.concatenate([held for held, _ in pieces])
    term = np.concatenate([place + start for start, (_, place) in zip(starts, pieces)])
    order = np.argsort(subset, kind="stable")  # terms stay sorted within a subset
    subset, chosen = subset[order], hashes[term[order]].tobytes()
    ends = (8 * np.searchsorted(subset, np.arange(len(_LIMITS) + 1))).tolist()
    # Of a subset with terms the hash is not zero.
    return np.array([(zlib.crc32(chosen[a:b]) & 0xFFFF or 1) if a < b else 0 for a, b in zip(ends, ends[1:])], ">u2")


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The weighted share of equal hashes among subsets in which either text has terms."""
    either = (one != 0) | (other != 0)
    held = np.add.reduceat(either, _FIRSTS, dtype=np.float64) / list(SUBSETS.values())
    weights = np.repeat(np.maximum(_LEAST_WEIGHT, 1 - held**4), list(SUBSETS.values())) * either
    total = weights.sum()
    return float(min(1.0, weights[one == other].sum() / total)) if total else float((one == other).all())


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _in_range(ends: list[int]) -> Column:
    """The number of ends below order value o, looked up in two steps."""
    width = max(1, math.isqrt(len(ends)))
    rows = [ends[k : k + width] for k in range(0, len(ends), width)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda end: end < F.col("o")))

    heads = F.split(F.lit(",".join(str(row[-1]) for row in rows)), ",").cast("array<bigint>")
    row = F.split(F.lit(";".join(",".join(map(str, row)) for row in rows)), ";")
    first = below(heads)
    return first * width + below(F.split(F.element_at(row, first + 1), ",").cast("array<bigint>"))


def _range_ends(ids: DataFrame, rows_per_range: int) -> list[int]:
    """The largest order value of each range of ids, found from ids alone on the executors.

    There is a range for every `rows_per_range` rows, MOST_RANGES at most; beyond that ranges hold more rows.
    """
    found = ids.agg(F.count("*").alias("n"), F.max("o").alias("largest")).first()
    if not found.n:
        return []
    ranges = min(-(-found.n // rows_per_range), MOST_RANGES)
    cuts = ids.approxQuantile("o", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    near = sorted({int(cut) for cut in cuts if cut < found.largest} | {found.largest})
    # Quantiles pass through doubles; a range's largest value is an id that exists.
    return sorted(row.e for row in ids.groupBy(_in_range(near)).agg(F.max("o").alias("e")).collect())


def _compared(keep: pa.Schema, kept: np.ndarray):
    """A function for mapInArrow over rows in order, each range followed by the first document after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # doc_id, text, fingerprint of the document that waits for its next
        for batch in slices(batches):
            made = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "beyond")))
            for doc_id, text, beyond in rows:
                own = fingerprint(text, kept)
                if last is not None:
                    changed = edited(last[1], text)
                    changed_print = fingerprint(changed, kept)
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    near = likeness(last[2], changed_print), likeness(last[2], own)
                    shown = last[2].tobytes().hex(), changed_print.tobytes().hex()
                    made.append((last[0], len(last[1]), digest, *shown, *near))
                last = None if beyond else (doc_id, text, own)
            columns = zip(*made) if made else [[]] * len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, keep)], schema=keep)

    return run


def match_next(
    documents: DataFrame, lowest_idf: float = 3.0, highest_idf: float = 20.0, rows_per_range: int = 4096
) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = documents.sparkSession
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(name, pa.string()) for name in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    ids = documents.select(order.alias("o"))
    ends = _range_ends(ids, rows_per_range)
    if not ends:
        return spark.createDataFrame([], schema)
    packed = spark.sparkContext.broadcast(lexicon(documents, lowest_idf, highest_idf))

    def run(batches):
        yield from _compared(arrow, np.unpackbits(packed.value).view(bool))(batches)

    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), order.alias("o")
    )
    own = _in_range(ends)
    # The largest of a range comes after the last of the range above it, the largest of all after the last of all.
    is_end = F.array_contains(F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>"), F.col("o"))
    places = F.when(is_end, F.array(own, (own + 1) % len(ends))).otherwise(F.array(own))
    dealt = texts.select("*", F.posexplode(places).alias("beyond", "range"))
    dealt = dealt.withColumn("beyond", F.col("beyond") == 1).repartition("range")
    ordered = dealt.sortWithinPartitions("range", "beyond", F.col("o").desc(), "text")
    return ordered.select("doc_id", "text", "beyond").mapInArrow(run, schema)
