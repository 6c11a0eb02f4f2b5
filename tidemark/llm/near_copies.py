"""Near copies: SimHash first, then exactly what it leaves apart, by prefix filtering over word shingles, leaders first.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at least `similarity`
(0.8); groups are the connected components of all such pairs, and no such pair is left out.

Texts whose SimHash fingerprints, those of operator 7, differ in at most `radius` bits (2) are met by ball hashing as
there and verified by their shingles. Fingerprints that near are rare below a similarity of some 0.95; the pairs that
SimHash leaves apart are looked up by shingles, as follows.

Shingles have one order for all texts, common ones last. Of two similar sets with n shingles each, at least one of the
first n - ceil(similarity n) + 1 of either is among those of the other, so texts are looked up by these prefixes only.
Any order is right. How common a shingle is, is counted by all tasks in slots of fixed number, and those whose sums
stand out come late. The others' first ones are counted one by one, and those that three texts or more have come after the
rest, so that a passage of few texts, which slots don't tell, is in the prefixes of hardly any. Most prefix shingles are in
one text only and of no use: they are counted once, without their texts, and a bitmap of fixed size of those met twice lets
the others be dropped where they are read.

What is written are hashes: texts stay in their table, and are read again where a pair asks for its shingles, again by
a bitmap, and once more for the result.

Texts of the same words in the same order are one class. In each shingle's bucket all classes are verified with its
leader first, the class that meets the most others over all its buckets. Of a text and very many near copies that is
the text itself, as edits put rare shingles into the prefix. So pairs grow with the classes where a bucket ends up in
one component. In all other buckets every pair of classes of different components is verified too, but those that
cannot be similar: by their sizes, by what can be left in common after the shingle's place in both, by how many shingles
of each part of their hashes' range they can share, or because their Jaccard distances to the leader differ by more than theirs may (it is a metric). Components don't change by leaving
out pairs inside one. That last step grows with the square of a bucket's classes in the worst case, as when many texts
stand close to each other without being near copies.

Words are runs of anything but ASCII white space, with A-Z in lower case. Texts of fewer words than a shingle are one
shingle; null and empty texts and texts without words are one class. Repeated rows, with one id and one text, are
copies. An empty table gives no rows. Extra columns are kept, whatever their names, unless they start with `_near_`:
those raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import ROWS_AT_ONCE, Scratch, bitmap, in_bitmap, rows_per_batch, slices, written
from tidemark.llm.components import components

#: Slots of the rough counts of shingles, and most bits of a bitmap, as powers of two.
SLOT_BITS, MOST_BITS = 22, 27
#: Slots whose counts are sent as one row, and such rows in an Arrow batch.
BLOCK, BLOCKS_AT_ONCE = 1 << 13, 64
#: Parts of the range of hashes in which a text's shingles are counted.
PARTS = 512
#: Against rounding in bounds that must not lose a pair.
SLACK = 1e-9

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str) -> tuple[int, np.ndarray]:
    """A signed hash of the sequence of words, and one of each word in order."""
    words = text.encode().lower().split()  # of bytes: A-Z alone are lowered, ASCII white space alone splits
    whole = xxhash.xxh64_intdigest(b" ".join(words), 7)
    known: dict[bytes, int] = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    return whole - (1 << 64) * (whole >> 63), np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of `size` words; of the whole, if it is shorter."""
    size = min(size, len(words))
    hashes = np.zeros(max(0, len(words) - size + 1) if size else 0, np.uint64)
    for k in range(size):
        hashes = hashes * _STEP + words[k : k + len(hashes)]
        hashes ^= hashes >> np.uint64(29)
    return np.unique(hashes).view(np.int64)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) * _MIX) >> np.uint64(64 - SLOT_BITS)


def _levels(documents: DataFrame, shingle: int) -> np.ndarray:
    """For each slot how many texts' shingles fall into it, in steps of half a binary logarithm, 0 where it doesn't stand out.

    Every task sends all its counts, packed, as a shingle rare in each task may be common in all; they are added in blocks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                np.add.at(counts, _slots(shingles(word_hashes(text or "")[1], shingle)), 1)
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for start in range(0, len(used), BLOCKS_AT_ONCE):
            places = used[start : start + BLOCKS_AT_ONCE]
            packed = [pa.compress(blocks[k].tobytes(), "lz4", asbytes=True) for k in places]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(packed, pa.binary())], ["place", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, packed in zip(batch.column("place").to_pylist(), batch.column("packed")):
                block = np.frombuffer(pa.decompress(packed.as_buffer(), 4 * BLOCK, "lz4"), np.uint32)
                sums[place] = sums[place] + block if place in sums else block.astype(np.int64)
        for place, block in sums.items():
            packed = pa.compress(_standing_out(block).tobytes(), "lz4", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([packed], pa.binary())], ["place", "packed"])

    schema = "place bigint, packed binary"
    # At most one row a block, whatever the data.
    found = documents.select("text").mapInArrow(count, schema).repartition("place").mapInArrow(add, schema).toArrow()
    levels = np.zeros(((1 << SLOT_BITS) // BLOCK, BLOCK), np.uint8)
    for place, packed in zip(found.column("place").to_pylist(), found.column("packed")):
        levels[place] = np.frombuffer(pa.decompress(packed.as_buffer(), BLOCK, "lz4"), np.uint8)
    return levels.reshape(-1)


def _standing_out(counts: np.ndarray) -> np.ndarray:
    """1 + 2 log2 of by how much each count exceeds the usual one, 0 where chance may do that."""
    usual = np.median(counts)
    over = counts - usual
    return np.where(over > 4 * np.sqrt(usual) + 1, 1 + np.floor(2 * np.log2(np.maximum(over, 1))), 0).astype(np.uint8)


def prefix(hashes: np.ndarray, levels: np.ndarray, similarity: float, often: np.ndarray | None = None) -> np.ndarray:
    """The first of these sorted shingles by level and hash, of which sets similar enough share one at least; those in `often` come late."""
    size = len(hashes) - int(np.ceil(similarity * len(hashes) - SLACK)) + 1 if len(hashes) else 0
    ranks = levels[_slots(hashes)]
    if often is not None:
        ranks = np.maximum(ranks, in_bitmap(often, hashes))
    return hashes[np.argsort(ranks, kind="stable")[:size]]


def _often(documents: DataFrame, levels: Broadcast, shingle: int, similarity: float, scratch: Scratch) -> np.ndarray:
    """A bitmap of the shingles that three texts or more have in their prefixes by the rough counts, which don't tell them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [prefix(shingles(word_hashes(text or "")[1], shingle), levels.value, similarity) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], ["shingle"])

    rows = documents.select("text").mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("rows"))
    return _bits_of(scratch.written(rows.where("rows > 2").select("shingle"), "often"))


def _keyed(documents: DataFrame) -> DataFrame:
    """The rows with _near_key, which tells ids and, where there is none, texts apart, and _near_text, a text's hash."""
    if any(c.lower().startswith("_near_") for c in documents.columns):
        raise ValueError("names of columns that start with _near_ are taken")
    by_text = F.concat(F.lit("t"), F.sha2("text", 256))
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), by_text, F.lit("t"))
    return documents.withColumns({"_near_key": key, "_near_text": F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())})


def counts_by_part(hashes: np.ndarray) -> np.ndarray | None:
    """How many hashes lie in each part of their range; None where that is more than a byte holds.

    Two sets have no more in common than the smaller counts of all parts together.
    """
    counts = np.bincount((hashes.view(np.uint64) * _STEP >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS)
    return counts.astype(np.int8) if counts.max() < 128 else None


def _marked(documents: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """doc_id, _near_key, _near_text, _near_class, _near_n (distinct shingles), _near_prefix, _near_counts and _near_print, written."""
    context = documents.sparkSession.sparkContext
    levels = context.broadcast(_levels(documents, shingle))
    often = context.broadcast(_often(documents, levels, shingle, similarity, scratch))
    kept = ["doc_id", "_near_key", "_near_text"]
    names = ["_near_class", "_near_n", "_near_prefix", "_near_counts", "_near_print"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = []
            for text in batch.column("text").to_pylist():
                whole, words = word_hashes(text or "")
                hashes = shingles(words, shingle)
                first = prefix(hashes, levels.value, similarity, often.value)
                made.append((whole, len(hashes), first, counts_by_part(hashes), simhash.fingerprint(text or "")))
            arrays = [pa.array(c, t) for c, t in zip(zip(*made), types)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *arrays], [*kept, *names])

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, _near_key string, _near_text bigint, "
    schema += "_near_class bigint, _near_n bigint, _near_prefix array<bigint>, _near_counts array<tinyint>, _near_print bigint"
    return scratch.written(documents.select(*kept, "text").mapInArrow(run, schema), "marks")


def _classes(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """class, n, counts, print, prefix and first, the smallest row; a prefix has the shingles that other rows' have too, and their places."""
    met = marked.select(F.explode("_near_prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("rows"))
    met = scratch.written(met.where("rows > 1").select("shingle"), "met")
    shared = marked.sparkSession.sparkContext.broadcast(_bits_of(met))
    rest = [c for c in marked.columns if c != "_near_prefix"]
    names, kind = [*rest, "_near_prefix"], pa.struct([("place", pa.int32()), ("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column("_near_prefix")
            hashes, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            places = np.arange(len(hashes)) - np.repeat(ends[:-1], np.diff(ends))
            stays = in_bitmap(shared.value, hashes)
            left = pa.StructArray.from_arrays([pa.array(places[stays], pa.int32()), pa.array(hashes[stays], pa.int64())], fields=list(kind))
            ends = np.concatenate([[0], np.cumsum(stays)])[ends]
            prefixes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), left)
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), prefixes], names)

    schema = ", ".join(f"{c} {t}" for c, t in marked.dtypes if c != "_near_prefix")
    schema += ", _near_prefix array<struct<place: int, shingle: bigint>>"
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("_near_key").alias("key"), F.col("_near_text").alias("text")))
    # Equal in all rows of a class.
    of_class = [F.any_value(f"_near_{c}").alias(c) for c in ("n", "prefix", "counts", "print")]
    classes = marked.mapInArrow(run, schema).groupBy(F.col("_near_class").alias("class")).agg(first.alias("first"), *of_class)
    return scratch.written(classes, "classes")


def _bits_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of some 32 bits a hash, but of no more than 2^MOST_BITS."""
    return bitmap(hashes, min(MOST_BITS, max(16, (32 * hashes.count()).bit_length())))


def _by_fingerprint(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) that connect all classes whose SimHash fingerprints differ in at most `radius` bits.

    A fingerprint stands for its smallest class, with which its other classes are paired.
    """
    prints = scratch.written(classes.groupBy("print").agg(F.min("class").alias("least")), "prints")
    same = classes.join(prints, "print").where("class > least").select(F.col("class").alias("u"), F.col("least").alias("v"))
    linked = simhash.links(prints.select(F.col("print").alias("fp")), radius)
    one, other = (prints.select(F.col("print").alias(c), F.col("least").alias(f"least_{c}")) for c in "uv")
    near = linked.join(one, "u").join(other, "v")
    return same.union(near.select(F.greatest("least_u", "least_v"), F.least("least_u", "least_v")))


def _buckets(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """shingle, class, n, place, leader, leader_n: a row for each shingle of a prefix that other classes' have too."""
    rows = classes.select("class", "n", F.inline("prefix"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n_classes")).where("n_classes > 1")
    # A shingle of very many classes is split by the adaptive skew join.
    shared = rows.join(counts, "shingle")
    density = shared.groupBy("class").agg(F.sum("n_classes").alias("density"))
    dense = shared.join(density, "class")
    leaders = dense.groupBy("shingle").agg(F.max(F.struct("density", "class", "n")).alias("l"))
    leaders = leaders.select("shingle", F.col("l.class").alias("leader"), F.col("l.n").alias("leader_n"))
    return scratch.written(shared.drop("n_classes").join(leaders, "shingle"), "buckets")


def _sizes(n: str, other: str, similarity: float) -> Column:
    return F.least(n, other) >= similarity * F.greatest(n, other) - SLACK


def _possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs that may have enough in common, by their counts."""
    counts = classes.select("class", "n", "counts")
    one, other = (counts.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}")) for c in "uv")
    least = F.aggregate(F.zip_with("cu", "cv", lambda a, b: F.least(a, b).cast("int")), F.lit(0), lambda done, n: done + n)
    wanted = similarity / (1 + similarity) * (F.col("nu") + F.col("nv")) - SLACK
    may = F.col("cu").isNull() | F.col("cv").isNull() | (least >= wanted)
    return pairs.join(one, "u").join(other, "v").where(may).select("u", "v")


def _compared(
    pairs: DataFrame, documents: DataFrame, classes: DataFrame, shingle: int, similarity: float, scratch: Scratch
) -> DataFrame:
    """The pairs that may be similar with the Jaccard similarity of their shingles, as a written table."""
    pairs = scratch.written(_possible(pairs, classes, similarity), "pairs")  # three reads follow
    asked = pairs.select(F.col("u").alias("class")).union(pairs.select("v")).distinct()
    # A class' shingles are those of its first row.
    wanted = classes.join(asked, "class").select(F.col("first.key").alias("_near_key"), F.col("first.text").alias("_near_text"))
    told = documents.sparkSession.sparkContext.broadcast(_bits_of(wanted.select(_row_hash())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            here = batch.filter(pa.array(in_bitmap(told.value, batch.column("row").to_numpy())))
            both = [word_hashes(text or "") for text in here.column("text").to_pylist()]
            arrays = [pa.array([whole for whole, _ in both], pa.int64())]
            arrays.append(pa.array([shingles(words, shingle) for _, words in both], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["class", "shingles"])

    sets = documents.select(_row_hash().alias("row"), "text").mapInArrow(run, "class bigint, shingles array<bigint>")
    # Repeated rows become one; the few more that the bitmap lets through meet no pair. Both joins use this one shuffle.
    sets = sets.groupBy("class").agg(F.any_value("shingles").alias("shingles"))
    one = sets.select(F.col("class").alias("u"), F.col("shingles").alias("a"))
    other = sets.select(F.col("class").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(one, "u").join(other, "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    all_of_both = F.size("a") + F.size("b") - F.col("common")
    return scratch.written(both.select("u", "v", "common", all_of_both.alias("either")), "compared")


def _row_hash() -> Column:
    return F.xxhash64("_near_key", "_near_text")


def _linked(compared: DataFrame, similarity: float) -> DataFrame:
    return compared.where(F.col("common") >= similarity * F.col("either")).select("u", "v")


def _with_leaders(buckets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of a bucket's classes and its leader."""
    pairs = buckets.where((F.col("class") != F.col("leader")) & _sizes("n", "leader_n", similarity))
    return pairs.select(F.greatest("class", "leader").alias("u"), F.least("class", "leader").alias("v"))


def _across(
    buckets: DataFrame, compared: DataFrame, rooted: DataFrame, similarity: float, scratch: Scratch
) -> DataFrame:
    """Pairs (u, v) of classes of different components that share a bucket and may be similar enough."""
    roots = rooted.select(F.col("node").alias("class"), "root")
    named = buckets.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    by_root = named.groupBy("shingle", "root").agg(F.count("*").alias("k"))
    main = by_root.groupBy("shingle").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("roots"))
    open_ones = main.where("roots > 1").select("shingle", F.col("m.root").alias("main"))
    distance = (1 - F.col("common") / F.col("either")).alias("distance")
    ways = compared.select(F.col("u").alias("class"), F.col("v").alias("leader"), distance)
    ways = ways.union(compared.select(F.col("v"), F.col("u"), distance))
    rows = named.join(open_ones, "shingle").join(ways, ["class", "leader"], "left")
    rows = rows.withColumn("distance", F.when(F.col("class") == F.col("leader"), 0.0).otherwise(F.col("distance")))
    rows = scratch.written(rows.select("shingle", "class", "n", "place", "root", "main", "distance"), "open")
    # Of two components one is not the bucket's largest.
    a, b = rows.where("root <> main").alias("a"), rows.alias("b")
    left = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    wanted = similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - SLACK
    apart = F.abs(F.col("a.distance") - F.col("b.distance")) > 1 - similarity + SLACK
    may = (F.col("a.root") != F.col("b.root")) & _sizes("a.n", "b.n", similarity) & (left >= wanted) & ~F.coalesce(apart, F.lit(False))
    found = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & may)
    return found.select(F.greatest("a.class", "b.class").alias("u"), F.least("a.class", "b.class").alias("v")).distinct()


def near_copies(
    documents: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 2, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): doc_id, _near_key, _near_text and _near_class of every row, and class, first, root of every class.

    `first` is the smallest row of a class by id, nulls last; classes with one root are one group of near copies. Both
    read tables of `scratch`, by default in a folder that is left to the shared folder's own clean-up.
    """
    scratch = scratch or Scratch(documents.sparkSession, "near-copies")
    with rows_per_batch(documents.sparkSession, ROWS_AT_ONCE):
        return _grouped(documents, similarity, shingle, radius, scratch)


def _grouped(
    documents: DataFrame, similarity: float, shingle: int, radius: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    keyed = _keyed(documents)
    marked = _marked(keyed, shingle, similarity, scratch)
    classes = _classes(marked, scratch)
    buckets = _buckets(classes, scratch)
    ends = _by_fingerprint(classes, radius, scratch).union(_with_leaders(buckets, similarity)).distinct()
    compared = _compared(ends, keyed, classes, shingle, similarity, scratch)
    links = _linked(compared, similarity)
    across = _across(buckets, compared, components(links, scratch.written), similarity, scratch)
    rest = _linked(_compared(across, keyed, classes, shingle, similarity, scratch), similarity)
    rooted = components(links.union(rest), scratch.written)
    groups = classes.join(rooted, F.col("class") == F.col("node"), "left")
    groups = groups.select("class", "first", F.coalesce("root", "class").alias("root"))
    return marked.drop("_near_n", "_near_prefix", "_near_counts", "_near_print"), groups


def without_near_copies(documents: DataFrame, **options) -> DataFrame:
    """One document of each group of near copies, with all its columns: that of the smallest id.

    Rows without an id stay only where their group has no id at all, and then one of them. An id's texts of one class,
    which differ in white space or case, are told apart by their hashes; of repeated rows the first by their other
    columns stays.
    """
    scratch = Scratch(documents.sparkSession, "near-copies")
    _, groups = near_copies(documents, scratch=scratch, **options)
    # `first` is the first row of a class; one id may have several texts.
    kept = groups.groupBy("root").agg(F.min("first").alias("kept"))
    kept = written(kept.select(F.col("kept.key").alias("_near_key"), F.col("kept.text").alias("_near_text")), "near-kept")
    scratch.clear()  # documents and the rows kept are all that is read from here on
    of_row = ["_near_key", "_near_text"]
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    # Repeated rows are one before they are sent; the join finds them dealt as it needs them.
    one = _keyed(documents).groupBy(*of_row).agg(F.min(row).alias("_near_row"))
    return one.join(kept, of_row, "left_semi").select("_near_row.*")
