"""Merkle manifest of a dataset: a postorder append log, written by aligned builders.

A row's leaf is the SHA-256 of its columns, each `-` if null, else its UTF-8 byte count, `:` and its value. Leaves of a
source stand by id; while there are several nodes, every three in a row make the next level's node, a last run of fewer
too, by the SHA-256 of their digests as hexadecimal text. The subroots of all sources, null first and then by the bytes
of their names, make the root in the same way.

Rows get their place in a source from a distributed sort: ranges of (source, id), and the rows before each range from
its counts. Builders are aligned: one takes the 3^LEVELS leaves from a multiple of that number on and appends each node
to its log as soon as it is complete, so its segment is the postorder of a subtree. The roots of these subtrees are the
leaves of the next round, until every source has one segment left. No task has more than 3^LEVELS nodes of one source
at a time. Where a node stands in a postorder log follows from the sizes of the subtrees before it, so siblings are
addressed, not searched: a proof is the siblings of a leaf in its segment, then those of its segment's root in the next
round's, up to the root over sources. Segments meet the path of their root by a join of one row a segment.

Rows of one source and one id stand by their leaf, rows without an id before the others; equal rows have equal leaves
and places next to each other. Null and empty texts differ. Extra columns are ignored. An empty table has no rows and no
root.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, written

#: Children of a node, and levels that a builder adds to its leaves.
FAN, LEVELS = 3, 5
DIGEST = 32
#: What a leaf is made of.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left: string, right: string>>"


def leaf(columns: list[Column]) -> Column:
    """The leaf of a row as lower-case hexadecimal text."""
    told = [F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in columns]
    return F.sha2(F.concat(*(F.coalesce(t, F.lit("-")) for t in told)), 256)


def height(nodes: int) -> int:
    """Levels above so many leaves, until one node is left."""
    levels = 0
    while FAN**levels < nodes:
        levels += 1
    return levels


def position(level: int, index: int, leaves: int, top: int) -> int:
    """Where the index-th node of a level stands in the postorder log of a tree of this height, from 0.

    Before it come the levels below, up to its own last leaf, the nodes before it on its level, and of each level above
    those whose subtrees ended before its own began.
    """
    upto = min((index + 1) * FAN**level, leaves)
    below = sum(-(-upto // FAN**k) for k in range(level))
    return below + index + sum(index // FAN**k for k in range(1, top - level + 1))


def parent(digests: list[bytes]) -> bytes:
    return sha256("".join(map(bytes.hex, digests)).encode()).digest()


def append_log(leaves: list[bytes], top: int) -> list[bytes]:
    """All nodes of a tree in the order in which they are complete; its last node is the root."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(top + 1)]

    def add(level: int, node: bytes) -> None:
        log.append(node)
        run = open_runs[level]
        run.append(node)
        if len(run) == FAN and level < top:
            close(level)

    def close(level: int) -> None:
        node = parent(open_runs[level])
        open_runs[level].clear()
        add(level + 1, node)

    for node in leaves:
        add(0, node)
    for level in range(top):
        if open_runs[level]:
            close(level)
    return log


def siblings(log: bytes, place: int, leaves: int, top: int) -> list[tuple[str, str]]:
    """For each level the digests left and right of the leaf's branch in its run, read from the log by position."""
    path = []
    for level in range(top):
        index, count = place // FAN**level, -(-leaves // FAN**level)
        first = index - index % FAN
        at = {k: DIGEST * position(level, k, leaves, top) for k in range(first, min(first + FAN, count)) if k != index}
        found = {k: log[a : a + DIGEST].hex() for k, a in at.items()}
        path.append(("".join(d for k, d in found.items() if k < index), "".join(d for k, d in found.items() if k > index)))
    return path


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and the siblings on its path give."""
    for left, right in path:
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Written rows with pos, their place from 0 among those of their key, and n, how many these are.

    `order` tells all rows of a key apart, so that a group of equal rows is dealt to several ranges.
    """
    spread = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    # Numbers of a partition's rows without gaps; written, so that each row keeps its own.
    numbered = written(spread.withColumn("number", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("number", 33)
    counts = numbered.groupBy("key", part.alias("part")).agg(F.min("number").alias("first"), F.count("*").alias("rows"))
    # At most a row for each partition and key; a key's window holds no more than there are partitions.
    of_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("rows").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(of_key).alias("n"))
    found = numbered.withColumn("part", part).join(starts, ["key", "part"])
    return found.withColumn("pos", F.col("number") + F.col("shift")).drop("part", "number", "shift")


def _segments(placed: DataFrame) -> DataFrame:
    """One row a builder: key, block, n (leaves of the key), ids, claims, log, from key, n, pos, id, claim, node."""
    size = FAN**LEVELS

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        leaves, n = rows["node"].to_pylist(), rows["n"][0].as_py()
        log = append_log(leaves, LEVELS if n > size else height(n))
        values = (
            rows["key"][0].as_py(),
            rows["pos"][0].as_py() // size,
            n,
            rows["id"].to_pylist(),
            b"".join(c or b"" for c in rows["claim"].to_pylist()),
            b"".join(log),
        )
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    schema = pa.schema(list(zip(("key", "block", "n", "ids", "claims", "log"), kinds)))
    blocks = placed.select("key", "n", "pos", "id", "claim", "node", F.floor(F.col("pos") / size).alias("block"))
    told = "key string, block bigint, n bigint, ids array<bigint>, claims binary, log binary"
    return written(blocks.groupBy("key", "block").applyInArrow(build, told), "segments")


def _last_node() -> Column:
    """The root of a segment's subtree."""
    return F.substring("log", -DIGEST, DIGEST)


def rounds(placed: DataFrame) -> list[DataFrame]:
    """Segments of every round: the first over the leaves, each later one over the roots of the one before."""
    size, most = FAN**LEVELS, placed.agg(F.max("n")).first()[0] or 0
    built = [_segments(placed)]
    while most > size:
        most = -(-most // size)
        roots = built[-1].where(F.col("n") > size).select(
            "key",
            F.ceil(F.col("n") / size).alias("n"),
            F.col("block").alias("pos"),
            F.lit(None).cast("bigint").alias("id"),
            F.lit(None).cast("binary").alias("claim"),
            _last_node().alias("node"),
        )
        built.append(_segments(roots))
    return built


def _top(n: int) -> int:
    return LEVELS if n > FAN**LEVELS else height(n)


def _leaves_here(n: int, block: int) -> int:
    return min(FAN**LEVELS, n - block * FAN**LEVELS)


def _with_paths(built: list[DataFrame], of_keys: DataFrame) -> DataFrame:
    """The first round's segments with path, subroot and root, from of_keys: key, path, subroot, root of whole trees."""
    size, known = FAN**LEVELS, None
    for segments in reversed(built):
        ended = segments.where(F.col("n") <= size).join(of_keys, "key")
        if known is not None:
            ended = ended.unionByName(segments.where(F.col("n") > size).join(known, ["key", "block"]))
        if segments is built[0]:
            return ended
        known = written(ended.mapInArrow(_of_blocks, _OF_BLOCKS), "paths")


_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_OF_BLOCKS = f"key string, block bigint, path {_PATH}, subroot string, root string"
_PROVED = [("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))]
_PROVED += [("verified", pa.bool_()), ("path", _PATH_TYPE)]


def _as_rows(path: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"left": left, "right": right} for left, right in path]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[list[tuple[str, str]]]]]:
    """Segments and the whole paths of their leaves in order."""
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        leaves, top = _leaves_here(row["n"], row["block"]), _top(row["n"])
        above = [(step["left"], step["right"]) for step in row["path"]]
        yield row, [siblings(row["log"], place, leaves, top) + above for place in range(leaves)]


def _of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of a round's leaves, which are segments of the round before."""
    for row, paths in _opened(batches):
        blocks = pa.array([row["block"] * FAN**LEVELS + k for k in range(len(paths))], pa.int64())
        key, subroot, root = (pa.array([row[c]] * len(paths), pa.string()) for c in ("key", "subroot", "root"))
        path = pa.array(map(_as_rows, paths), _PATH_TYPE)
        yield pa.RecordBatch.from_arrays([key, blocks, path, subroot, root], ["key", "block", "path", "subroot", "root"])


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, paths in _opened(batches):
        top, leaves, log = _top(row["n"]), len(paths), row["log"]
        at = [DIGEST * position(0, k, leaves, top) for k in range(leaves)]
        claims = [row["claims"][k : k + DIGEST].hex() for k in range(0, DIGEST * leaves, DIGEST)]
        roots = [folded(claim, path) for claim, path in zip(claims, paths)]
        columns = [
            row["ids"],
            [log[a : a + DIGEST].hex() for a in at],
            [row["subroot"]] * leaves,
            [row["root"]] * leaves,
            [sha256("".join(left + right for left, right in path).encode()).hexdigest() for path in paths],
            roots,
            [root == row["root"] for root in roots],
        ]
        if row["with_path"]:
            columns.append(list(map(_as_rows, paths)))
        arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _PROVED)]
        yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in _PROVED[: len(arrays)]])


def _key(source: str) -> Column:
    """Never null; null sources first, then by their bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


class Manifest:
    """The manifest of documents, and of what is claimed to be their texts (by default, what they are)."""

    def __init__(self, documents: DataFrame, claimed_text: Column | None = None):
        claimed = F.col("text") if claimed_text is None else claimed_text
        texts = documents.select(*COLUMNS, claimed.alias("claimed"))
        rest = [F.col(c) for c in COLUMNS[:-1]]
        own, other = leaf([*rest, F.col("text")]), leaf([*rest, F.col("claimed")])
        leaves = texts.select(
            _key("source").alias("key"),
            F.col("doc_id").cast("long").alias("id"),
            F.unhex(own).alias("node"),
            F.unhex(F.when(F.col("text").eqNullSafe(F.col("claimed")), own).otherwise(other)).alias("claim"),
            # Tells equal rows apart.
            F.monotonically_increasing_id().alias("row"),
        )
        self.of_sources = rounds(_placed(written(leaves, "leaves"), ["id", "node", "row"]))
        ended = [s.where(F.col("n") <= FAN**LEVELS).select("key", _last_node().alias("node")) for s in self.of_sources]
        subroots = reduce(DataFrame.union, ended).select(
            F.lit("").alias("key"),
            F.col("key").alias("source"),
            F.lit(None).cast("bigint").alias("id"),
            F.lit(None).cast("binary").alias("claim"),
            "node",
        )
        self._subroots = written(_placed(subroots, ["source"]), "subroots")
        self.over_sources = rounds(self._subroots)

    def log(self) -> DataFrame:
        """source, position, level, node: each source's postorder log, its last node the subroot."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                row = batch.to_pylist()[0]
                here, top, k = _leaves_here(row["n"], row["block"]), _top(row["n"]), row["round"]
                made = []
                for level in range(k > 0, top + 1):  # a later round's leaves are in the log of the round before
                    for index in range(-(-here // FAN**level)):
                        at = DIGEST * position(level, index, here, top)
                        whole = row["block"] * FAN ** (LEVELS - level) + index
                        above = k * LEVELS + level
                        place = position(above, whole, row["leaves"], height(row["leaves"]))
                        made.append((row["key"][1:] if row["key"] else None, place, above, row["log"][at : at + DIGEST].hex()))
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
                arrays = [pa.array(c, t) for c, t in zip(zip(*made), kinds)] if made else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays(arrays, ["source", "position", "level", "node"])

        totals = self.of_sources[0].select("key", F.col("n").alias("leaves")).distinct()
        told = [
            s.join(totals, "key").select("key", "block", "n", "leaves", "log", F.lit(k).alias("round"))
            for k, s in enumerate(self.of_sources)
        ]
        return reduce(DataFrame.union, told).mapInArrow(run, "source string, position bigint, level int, node string")

    def proofs(self, with_path: bool = True) -> DataFrame:
        """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, path.

        A path has the digests left and right of a branch, level by level from the leaf to the root; proof_sha256 is that
        of all of them in this order. folded_root is what the claimed text's leaf and the path give, verified whether
        that is the root.
        """
        root = F.lower(F.hex(_last_node())).alias("root")
        # The tree over sources is one tree, so this is one row.
        whole = self.over_sources[-1].select("key", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), root)
        of_places = _with_paths(self.over_sources, whole).mapInArrow(_of_blocks, _OF_BLOCKS)
        sources = self._subroots.select("source", F.col("pos").alias("block"), F.lower(F.hex("node")).alias("of_source"))
        of_keys = of_places.join(sources, "block").select(
            F.col("source").alias("key"), "path", F.col("of_source").alias("subroot"), "root"
        )
        placed = _with_paths(self.of_sources, written(of_keys, "paths")).withColumn("with_path", F.lit(with_path))
        told = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return placed.mapInArrow(_proved, told + (f", path {_PATH}" if with_path else ""))


def tampered(documents: DataFrame) -> DataFrame:
    """Per document: its leaf, proof and roots, and whether they hold after line ends of every other text are deleted."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claimed = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return Manifest(documents, claimed).proofs(with_path=False)


#: The result as SQL: levels one by one, then each document's digest folded up them.
SQL = r"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
         CASE WHEN list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                lambda c: CAST(ascii(c) AS UBIGINT)), lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
                lambda x, step: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) & 1 = 1
              THEN replace(text, chr(10), '') ELSE text END AS claimed FROM documents),
leaves AS (
  SELECT r, doc_id, source,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(claimed) || ':' || claimed, '-')) AS claim FROM rows),
nodes AS (
  SELECT source, 0 AS level, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS BIGINT) AS i,
         leaf AS digest, CAST(count(*) OVER (PARTITION BY source) AS BIGINT) AS n FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), CAST(ceil(any_value(n) / 3) AS BIGINT)
  FROM nodes WHERE n > 1 GROUP BY source, level, i // 3),
subroots AS (SELECT source, digest FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, CAST(row_number() OVER (ORDER BY source COLLATE "C" NULLS FIRST) - 1 AS BIGINT) AS i, digest,
         CAST(count(*) OVER () AS BIGINT) AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), CAST(ceil(any_value(n) / 3) AS BIGINT)
  FROM upper WHERE n > 1 GROUP BY level, i // 3),
tree AS (
  SELECT source, 'low' AS part, level, i, digest, n FROM nodes UNION ALL SELECT NULL, 'top', level, i, digest, n FROM upper),
steps AS (
  SELECT source, part, level, i // 3 AS run, i % 3 AS place,
         coalesce(string_agg(digest, '' ORDER BY i) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS left_of,
         coalesce(string_agg(digest, '' ORDER BY i) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS right_of
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY source, part, level, i // 3 ORDER BY i)),
low AS (
  SELECT l.r, l.source, 0 AS level,
         CAST(row_number() OVER (PARTITION BY l.source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS BIGINT) AS i, claim AS digest, '' AS proof
  FROM leaves l
  UNION ALL
  SELECT p.r, p.source, p.level + 1, p.i // 3, sha256(left_of || digest || right_of), proof || left_of || right_of
  FROM low p JOIN steps s ON s.part = 'low' AND p.source IS NOT DISTINCT FROM s.source AND p.level = s.level
       AND p.i // 3 = s.run AND p.i % 3 = s.place),
low_ends AS (SELECT r, source, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM low GROUP BY r, source),
numbered AS (SELECT source, digest, CAST(row_number() OVER (ORDER BY source COLLATE "C" NULLS FIRST) - 1 AS BIGINT) AS i FROM subroots),
high AS (
  SELECT e.r, 0 AS level, k.i, e.digest, e.proof FROM low_ends e JOIN numbered k ON e.source IS NOT DISTINCT FROM k.source
  UNION ALL
  SELECT p.r, p.level + 1, p.i // 3, sha256(left_of || digest || right_of), proof || left_of || right_of
  FROM high p JOIN steps s ON s.part = 'top' AND p.level = s.level AND p.i // 3 = s.run AND p.i % 3 = s.place),
ends AS (SELECT r, arg_max(digest, level) AS folded_root, arg_max(proof, level) AS proof FROM high GROUP BY r)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded_root,
       folded_root = t.digest AS verified
FROM leaves l JOIN ends USING (r) JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
     CROSS JOIN (SELECT digest FROM upper WHERE n = 1) t
"""
