"""Nearest neighbours by multi-index hashing of learned binary codes.

Fitting: on a bounded sample, vectors are centred, and rotations are learned that lose least when coordinates are
replaced by their signs. Several rotations, each from its own start, give a code of 256 bits. The search radius is the
Hamming distance that covers nearly all true neighbours of some sampled rows; those neighbours are looked up among all
rows, in one pass, so the radius is that of the whole table and shrinks as it gets denser.

Searching: different vectors are classes with their codes, which are split into 16-bit substrings. Of r bits that two
codes differ in, no more than an equal share fall into at least one substring. Every class is listed under each of its
substrings, every query probes all values within the share, so a shuffle on (place, value) brings together all codes
within the radius; pairs are verified by their whole codes and ranked by the Euclidean distance of the original vectors.
Queries that find fewer than `k` try again with the widest radius whose share is MOST_SHARE.

Where the radius calls for a larger share, most values of a substring would be probed and no index prunes. Then, and for
queries that still lack neighbours, rows and queries are dealt into blocks of bounded size, and every block of queries
meets every block of rows in a task of its own: that work grows with rows times queries. A block of rows indexes its
substrings and is searched in the same way, by values that near; if that leaves a query with too few, the radius grows
until there are enough or the block is exhausted. A block sends its best `k` per query, and the best of these count.

Vectors that are null, zero, of another length than the sample's most frequent one, or hold null or non-finite
components take no part, nor do rows with a null id. Repeated rows are candidates each by themselves, except for
queries of their own id; a query's repeated rows are one query for each different vector. Ties go to the smaller
vec_id. Of equal vectors the smallest ids are kept, as many as a query may need. Fewer candidates than k give fewer
rows, an empty table none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, written

SUBSTRING_BITS, WORD_BITS = 16, 64
#: Rows of the sample that rotations are fitted on, and of those whose neighbours among all rows tell the radius.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 256
#: The largest number of bits of a substring that the shuffled index is probed with: 137 of its 65536 values.
MOST_SHARE = 2
#: Rows turned into matrices at a time, and the most numbers a block of the scan holds.
ROWS_AT_ONCE, BLOCK_NUMBERS = 2048, 1 << 22


class Codes:
    """Learned codes: bits are the signs of rotated, centred vectors."""

    def __init__(self, sample: np.ndarray, bits: int = 256, rounds: int = 20, seed: int = 7):
        self.mean = sample.mean(0)
        centred = sample - self.mean
        random, size = np.random.default_rng(seed), sample.shape[1]
        rotations = []
        while sum(r.shape[1] for r in rotations) < bits:
            rotation = np.linalg.qr(random.normal(size=(size, size)))[0]
            for _ in range(rounds):
                # The rotation that brings the vectors nearest to their own signs, by Procrustes.
                left, _, right = np.linalg.svd(centred.T @ np.where(centred @ rotation > 0, 1.0, -1.0))
                rotation = left @ right
            rotations.append(rotation)
        self.rotation = np.concatenate(rotations, axis=1)[:, :bits]

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """A row of unsigned 16-bit substrings for each vector."""
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1).view(np.uint16)


def shares(radius: int, substrings: int) -> list[int]:
    """For each substring the bits it may differ in, so that codes within the radius agree that well in one at least.

    With r = m q + rest: q bits in the first rest + 1 substrings, q - 1 in the others, where -1 stands for no probe.
    """
    share, rest = divmod(radius, substrings)
    return [share if place <= rest else share - 1 for place in range(substrings)]


class MultiIndex:
    """Substring indexes over the codes of one block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.substrings = codes.shape[1]
        self.indexes = [np.unique(column, return_inverse=True) for column in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius."""
        near = np.zeros(len(self.codes), bool)
        for place, ((values, where), allowed) in enumerate(zip(self.indexes, shares(radius, self.substrings))):
            if allowed >= 0:
                near |= (np.bitwise_count(values ^ code[place]) <= allowed)[where]
        found = np.flatnonzero(near)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(1) <= radius]


def search_block(
    codes: Codes, radius: int, k: int, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each query its number, its id, and ids and distances of the block's k nearest found."""
    index, own = MultiIndex(codes(vectors)), codes(queries)
    bits = index.substrings * SUBSTRING_BITS
    for number, (query_id, query) in enumerate(zip(query_ids, queries)):
        reach = radius
        while True:
            found = index.within(own[number], reach)
            found = found[ids[found] != query_id]
            if len(found) >= k or reach >= bits:
                break
            reach = min(bits, reach + index.substrings)
        distance = np.sqrt(((vectors[found] - query) ** 2).sum(1))
        best = np.lexsort((ids[found], distance))[:k]
        yield number, query_id, ids[found][best], distance[best]


def _usable(vector: str, length: int | None = None) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return good if length is None else good & (F.size(vector) == length)


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.float64)


def fitted_radius(rows: DataFrame, codes: Codes, ids: np.ndarray, sample: np.ndarray, k: int, covered: float) -> int:
    """The Hamming distance within which this share of the sampled rows' k nearest among all rows lie.

    A task keeps k rows for each of the sampled ones, whose number is bounded; the driver gets no more than that.
    """
    length, own = sample.shape[1], codes(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances, bits = np.full((len(sample), k), np.inf), np.zeros((len(sample), k), np.int64)
        for batch in slices(batches, ROWS_AT_ONCE):
            block = _matrix(batch.column("embedding"), length)
            apart = (block**2).sum(1) - 2 * sample @ block.T  # but for the sampled row's own square
            apart[ids[:, None] == batch.column("vec_id").to_numpy()] = np.inf
            near = np.argsort(apart, axis=1)[:, :k] if len(block) <= k else np.argpartition(apart, k - 1, axis=1)[:, :k]
            differing = np.bitwise_count(own[:, None, :] ^ codes(block)[near]).sum(2, np.int64)
            distances = np.concatenate([distances, np.take_along_axis(apart, near, 1)], axis=1)
            bits = np.concatenate([bits, differing], axis=1)
            best = np.argsort(distances, axis=1, kind="stable")[:, :k]
            distances, bits = np.take_along_axis(distances, best, 1), np.take_along_axis(bits, best, 1)
        query, place = np.nonzero(np.isfinite(distances))
        arrays = [pa.array(query, pa.int64()), pa.array(distances[query, place]), pa.array(bits[query, place])]
        yield pa.RecordBatch.from_arrays(arrays, ["query", "distance", "bits"])

    found = rows.select("vec_id", "embedding").mapInArrow(run, "query bigint, distance double, bits bigint")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "bits")))
    bits = best.where(F.col("rank") <= k).select("bits").toArrow().column("bits").to_numpy()
    return int(np.quantile(bits, covered, method="higher")) if len(bits) else 0


def coded(rows: DataFrame, codes: Codes, length: int) -> DataFrame:
    """The rows and `code`, their codes as 64-bit numbers."""
    columns = rows.columns
    kinds = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            words = codes(_matrix(batch.column("embedding"), length)).view(np.int64)
            ends = pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32())
            made = pa.ListArray.from_arrays(ends, pa.array(words.ravel())).cast(kinds)
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), made], [*columns, "code"])

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, code array<bigint>")


def _substrings(code: str, count: int) -> Column:
    """The 16-bit substrings of a code, in the order of `Codes`."""
    each = WORD_BITS // SUBSTRING_BITS
    return F.array(
        *(
            F.shiftrightunsigned(F.col(code)[p // each], SUBSTRING_BITS * (p % each)).bitwiseAND(F.lit(0xFFFF)).cast("int")
            for p in range(count)
        )
    )


def _masks(allowed: int) -> list[int]:
    return [sum(1 << b for b in chosen) for n in range(allowed + 1) for chosen in combinations(range(SUBSTRING_BITS), n)]


def meetings(classes: DataFrame, asked: DataFrame, radius: int, substrings: int) -> DataFrame:
    """Queries and classes that agree in a substring but for its share of the radius, once for each such substring.

    Columns query_id, mark, class, and the number of bits that their codes differ in.
    """
    allowed = shares(radius, substrings)
    lists = {n: F.array(*map(F.lit, _masks(n))).cast("array<int>") for n in allowed}
    masks = F.create_map(*(x for n, values in lists.items() for x in (F.lit(n), values)))
    own = F.posexplode(_substrings("code", substrings)).alias("place", "own")
    probes = asked.select("query_id", "mark", F.col("code").alias("asked"), own)
    probes = probes.select("*", F.explode(masks[F.array(*map(F.lit, allowed))[F.col("place")]]).alias("mask"))
    probes = probes.select("query_id", "mark", "asked", "place", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    index = classes.select("class", "code", F.posexplode(_substrings("code", substrings)).alias("place", "value"))
    words = range(substrings * SUBSTRING_BITS // WORD_BITS)
    differing = sum(F.bit_count(F.col("code")[w].bitwiseXOR(F.col("asked")[w])) for w in words)
    # A value that very many codes share is split by the adaptive skew join.
    return probes.join(index, ["place", "value"]).select("query_id", "mark", "class", differing.alias("bits"))


def _ranked(near: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def distinct_vectors(rows: DataFrame, codes: Codes, length: int, k: int) -> DataFrame:
    """class, embedding, code and members: the k + 1 smallest ids of each different vector, with their repeated rows.

    No query needs more of them, its own id left out. Map tasks send no more than that many rows of a vector.
    """
    ids = rows.groupBy("embedding", "vec_id").agg(F.count("*").alias("n"))
    # By a part of the ids first, so that one task holds only some rows of a vector that very many rows share.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    for by in (["embedding", part], ["embedding"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
        ids = ids.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    members = F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("members")
    name = F.struct(F.col("members")[0]["vec_id"].alias("id"), F.xxhash64("embedding").alias("mark")).alias("class")
    return coded(ids.groupBy("embedding").agg(members).select(name, "embedding", "members"), codes, length)


def _by_index(
    rows: DataFrame, asked: DataFrame, codes: Codes, radius: int, k: int, length: int
) -> tuple[DataFrame, DataFrame]:
    """(near, rest): the k nearest of the queries that find as many in the shuffled index, and the queries that don't."""
    classes = written(distinct_vectors(rows, codes, length, k), "classes")
    asked, near = written(coded(asked, codes, length), "asked"), None
    substrings = codes.rotation.shape[1] // SUBSTRING_BITS

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            one, other = (_matrix(batch.column(c), length) for c in ("embedding", "asked"))
            kept = [batch.column(c) for c in ("query_id", "mark", "members")]
            score = pa.array(np.sqrt(((one - other) ** 2).sum(1)))
            yield pa.RecordBatch.from_arrays([*kept, score], ["query_id", "mark", "members", "score"])

    schema = "query_id bigint, mark bigint, members array<struct<vec_id: bigint, n: bigint>>, score double"
    for reach in sorted({radius, substrings * (MOST_SHARE + 1) - 1}):
        met = meetings(classes, asked, reach, substrings).where(F.col("bits") <= reach)
        pairs = met.select("query_id", "mark", "class").distinct()
        both = pairs.join(classes.select("class", "embedding", "members"), "class")
        both = both.join(asked.select("query_id", "mark", F.col("embedding").alias("asked")), ["query_id", "mark"])
        each = both.drop("class").mapInArrow(measured, schema).select("query_id", "mark", "score", F.inline("members"))
        copies = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")
        each = each.where(F.col("vec_id") != F.col("query_id")).select("*", copies).drop("n", "copy")
        best = written(_ranked(each, k).drop("rank"), "near")
        full = best.groupBy("query_id", "mark").agg(F.count("*").alias("found")).where(F.col("found") >= k).drop("found")
        good = best.join(full, ["query_id", "mark"], "left_semi")
        near = good if near is None else near.union(good)
        asked = written(asked.join(full, ["query_id", "mark"], "left_anti"), "asked")
        if asked.isEmpty():
            break
    return near, asked.drop("code")


def _by_blocks(
    rows: DataFrame, asked: DataFrame, codes: Codes, radius: int, k: int, length: int, rows_per_block: int, queries_per_block: int
) -> DataFrame:
    """query_id, mark, vec_id, score: the k nearest of every block for each query."""
    most = max(1, BLOCK_NUMBERS // length)
    row_blocks = -(-rows.count() // min(rows_per_block, most)) or 1
    query_blocks = -(-asked.count() // min(queries_per_block, most)) or 1

    def dealt(blocks: int, name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(1), name, "embedding"), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    index = rows.select("vec_id", "embedding", dealt(row_blocks, "vec_id").alias("r"), every(query_blocks).alias("q"))
    asked = asked.select("query_id", "mark", "embedding", dealt(query_blocks, "query_id").alias("q"), every(row_blocks).alias("r"))

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        ids, query_ids, marks = (t[c].to_numpy() for t, c in ((block, "vec_id"), (queries, "query_id"), (queries, "mark")))
        parts = ([], [], [], [])
        if len(ids) and len(query_ids):
            found = search_block(
                codes, radius, k, ids, _matrix(block["embedding"], length), query_ids, _matrix(queries["embedding"], length)
            )
            for number, query_id, near, distance in found:
                for part, values in zip(parts, (np.full(len(near), query_id), np.full(len(near), marks[number]), near, distance)):
                    part.append(values)
        names, kinds = ("query_id", "mark", "vec_id", "score"), (np.int64, np.int64, np.int64, np.float64)
        arrays = [pa.array(np.concatenate(p) if p else [], pa.from_numpy_dtype(d)) for p, d in zip(parts, kinds)]
        return pa.Table.from_arrays(arrays, list(names))

    schema = "query_id bigint, mark bigint, vec_id bigint, score double"
    return asked.groupBy("q", "r").cogroup(index.groupBy("q", "r")).applyInArrow(search, schema)


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    bits: int = 256,
    covered: float = 0.98,
    rows_per_block: int = 8192,
    queries_per_block: int = 4096,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of each query's k nearest rows found; bits in whole words of 64."""
    if bits % WORD_BITS:
        raise ValueError(f"a code is made of words of {WORD_BITS} bits")
    spark = rows.sparkSession
    # Floats are sent as they are and become doubles where they are used.
    given = dict(rows.dtypes).get("embedding")
    kind = given if given in ("array<float>", "array<double>") else "array<double>"
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), is_query.alias("is_query"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & _usable("embedding"))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec_id", "embedding").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lengths = sample["embedding"].map(len)
    length = int(lengths.mode()[0])
    sample = sample[lengths == length]
    fit_on = np.array(sample["embedding"].tolist(), np.float64)
    codes = Codes(fit_on, bits)
    vectors = vectors.where(F.size("embedding") == length)
    radius = fitted_radius(vectors, codes, sample["vec_id"].to_numpy()[:SAMPLE_QUERIES], fit_on[:SAMPLE_QUERIES], k, covered)

    asked = vectors.where("is_query").dropDuplicates(["vec_id", "embedding"])
    asked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("mark"), "embedding")
    near = None
    if max(shares(radius, bits // SUBSTRING_BITS)) <= MOST_SHARE:
        near, asked = _by_index(vectors.drop("is_query"), asked, codes, radius, k, length)
    if near is None or not asked.isEmpty():
        scanned = _by_blocks(vectors, asked, codes, radius, k, length, rows_per_block, queries_per_block)
        near = scanned if near is None else near.union(scanned)
    return _ranked(near, k).select("query_id", "rank", "vec_id", "score")
