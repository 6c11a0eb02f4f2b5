"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints come from the 64-bit hashes of a text's shingles, a bit being set if it is in over half of them. Equal
fingerprints are one class. Two classes link if they differ in at most `radius` bits (2 by default): then some value lies within
half the radius of both. So every class emits all values within half the radius of its fingerprint, classes meet by
value, and each is paired with the smallest class it meets there; pairs are made distinct and verified. All classes
that meet at one value lie within the radius of each other, and at most 1 + 64 fingerprints lie that near to a value,
so no group grows with the data and the pairs kept connect exactly what all pairs would. Links are joined to
components, each named after the smallest document in it.

Null and empty texts, and texts without words, have the fingerprint 0 and link like any other. Repeated rows give
repeated results; a component without any document id has a null component_id. Extra columns are ignored, an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import per_text, written
from tidemark.llm.components import components

BITS = 64
#: Hashes whose bits are counted at a time, for bounded memory on long texts.
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    words = text.encode().lower().split()  # of bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for start in range(0, count, HASHES_AT_ONCE):
        run = words[start : min(start + HASHES_AT_ONCE, count) + shingle - 1]
        size = min(shingle, len(run))
        joined = map(b" ".join, zip(*(run[k:] for k in range(size)))) if size == shingle else [b" ".join(run)]
        hashes = np.array([digest(s, seed) for s in joined], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    bits = np.packbits(2 * set_bits > count, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame, keep: list[str], shingle: int = 3, seed: int = 42) -> DataFrame:
    """Columns `keep` and fp (signed 64-bit) of every row."""
    run = per_text(keep, lambda: lambda text: (fingerprint(text, shingle, seed),), ["fp"], [pa.int64()])
    types = dict(documents.select(*keep).dtypes)
    schema = "".join(f"`{name}` {types[name]}, " for name in keep) + "fp bigint"
    return documents.select(*keep, "text").mapInArrow(run, schema)


def ball_masks(radius: int) -> list[int]:
    """All 64-bit values with at most `radius` bits set, as signed numbers."""
    places = (c for r in range(radius + 1) for c in combinations(range(BITS), r))
    values = (sum(1 << b for b in chosen) for chosen in places)
    return [v - (1 << BITS) if v >> (BITS - 1) else v for v in values]


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Verified pairs (u, v) of values of column fp, connecting all that differ in at most `radius` bits.

    The radius is even, so that both sides of a link reach the middle. Within a group every class is paired with the
    smallest; where the group's classes could lie further apart than the radius there is no such group.
    """
    if radius % 2:
        raise ValueError("the radius is even: each side goes half the way")
    masks = F.array(*(F.lit(m).cast("long") for m in ball_masks(radius // 2)))
    variants = classes.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    met = variants.withColumn("smallest", F.min("fp").over(Window.partitionBy("variant")))
    pairs = met.where(F.col("fp") > F.col("smallest")).select(F.col("fp").alias("u"), F.col("smallest").alias("v"))
    return pairs.distinct().where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(
    documents: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id, component_fingerprint, columns `keep`.

    component_id is the smallest doc_id of the component, component_fingerprint names the component in any case.
    """
    marked = written(fingerprints(documents, ["doc_id", *keep], shingle, seed), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = components(links(classes, radius))
    placed = classes.join(rooted, classes.fp == rooted.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = placed.join(named, "root").select("fp", "root", "component_id")
    # A fingerprint that very many documents share is split by the adaptive skew join; names has it once.
    return marked.join(names, "fp").select(
        "doc_id", _digits("fp").alias("fingerprint"), "component_id", _digits("root").alias("component_fingerprint"), *keep
    )


def _digits(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def without_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id.

    Of repeated rows with that id the first by text and the other columns stays; rows without an id stay only where
    their component has no id at all, and then one of them.
    """
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.sha2("text", 256)), F.lit("t"))
    keyed = documents.withColumn("_key", key)
    found = near_duplicates(keyed, keep=("_key",), **options)
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "_key"))
    kept = found.groupBy("component_fingerprint").agg(smallest.getField("_key").alias("_key")).select("_key")
    one = Window.partitionBy("_key").orderBy("text", *(c for c in documents.columns if c != "text"))
    stays = keyed.join(kept, "_key", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return stays.select(*documents.columns)
