"""Mixing sources to target weights.

Each document gets a hash-random key. Within a source, documents stand in ranges of keys, sorted inside a range; sums
per range, added up range by range, and running sums inside a range give every document the words before it. A source
is cut at its exact budget: whole passes first, then the documents before the cut, and of the one at the cut as many
words as are left. Ranges are cut from the key itself, 4096 to a source, so a source with most of the rows is sorted
by many tasks, and the table of range sums has at most 4096 rows a source.

Targets: all sources together share `share` of the words there are, by weight, none beyond `most` times its own
words; what is over is shared again. That ends where every source has weight times one common level, or its bound.
The level follows directly once sources are ordered by bound over weight.

Null texts have no words, null sources are a source of their own, the last. Repeated rows count each by itself; null
ids share one key in `mix`, as its SQL has it, so a source's rows without an id stand in one range there; in
`mixed_copies` they have keys of their texts. A source without words has target 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Hexadecimal digits of a key that name its range.
RANGE_DIGITS = 3


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column | str, seed: int = 0) -> Column:
    """The same for every run: an MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target from source, source_size: a row per source, so its windows are small."""
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("bound", most * F.col("source_size"))
    # The first sources of this order reach their bounds; a source does if the level without it is above its own.
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    earlier = F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - earlier) / later
    levels = weighed.withColumn("level", level)
    # Before the first source that doesn't, levels rise; after it they fall: its level is the largest of the rest.
    reaches = F.col("level") * F.col("weight") >= F.col("bound")
    common = F.max(F.when(~reaches, F.col("level"))).over(everything)
    target = F.when(reaches, F.col("bound").cast("double")).otherwise(F.col("weight") * common)
    return levels.select("source", "source_size", target.alias("target"))


def _placed(
    documents: DataFrame, key: Column, kept: Column, order: list[Column | str], weights: tuple[int, ...], share: float, most: int
) -> DataFrame:
    """Per row: kept, size, source, source_size, target and taken. Rows stand by `key`, then by `order`."""
    # One expression for null and other sources: the join finds the rows dealt as the window left them.
    sized = documents.select(
        F.array("source").alias("source"),
        words("text").alias("size"),
        key.alias("key"),
        F.substring(key, 1, RANGE_DIGITS).alias("range"),
        kept.alias("kept"),
    )
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sources.withColumn("source", F.col("source")[0]), weights, share, most)
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(by_range), F.lit(0)))
        .join(targets.withColumn("source", F.array("source")), "source")
        .select("source", "range", "range_start", "source_size", "target")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", *order)
    running = sized.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = running.join(starts, ["source", "range"])
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    before = F.col("range_start") + F.col("upto") - F.col("size")
    rest = F.least(F.greatest(budget - passes * F.col("source_size") - before, F.lit(0)), F.col("size"))
    taken = (passes * F.col("size") + rest).cast("long")
    return placed.select("kept", "size", F.col("source")[0].alias("source"), "source_size", "target", taken.alias("taken"))


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 0
) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target and taken: the words of it that the mix takes.

    `taken` is the number of whole passes over its source times its size, plus what the last pass takes of it.
    """
    key = random_key("doc_id", seed)
    placed = _placed(documents, key, F.col("doc_id"), ["kept", "size"], weights, share, most)
    return placed.withColumnRenamed("kept", "doc_id")


def mixed_copies(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 0
) -> DataFrame:
    """The mix itself: each row as often as it is taken, the last time with only its first words if cut.

    A cut text ends after the last word taken; rows of which no word is taken, or that have none, are left out. Where ids aren't null, shares are those of `mix`. Rows without an id have a key of their text's hash.
    """
    of_text = F.md5(F.concat(F.lit(f"{seed}:t"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    key = F.when(F.col("doc_id").isNull(), of_text).otherwise(random_key("doc_id", seed))
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    order = [F.col("kept.doc_id"), F.col("size"), F.col("kept.text")]
    rows = _placed(documents, key, row, order, weights, share, most).where("taken > 0").select("size", "taken", "kept")
    whole = (F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    counts = F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array()))
    taken = rows.withColumn("words", F.explode(counts))
    pieces = F.split("kept.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("words")), "")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("kept.text"))
    taken = taken.withColumn("text", text)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    # Columns stay within `kept` until here, so none of theirs meets one of the mix.
    return taken.select(*(made[c].alias(c) if c in made else F.col(f"kept.`{c}`") for c in documents.columns))


#: The result as SQL, written from the rule: the level is found by trying each source as the last to reach its bound.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('0:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
totals AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (CASE (ROW_NUMBER() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3
             WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) AS w
  FROM totals),
levels AS (
  SELECT (1.5::DOUBLE * (SELECT CAST(SUM(source_size) AS DOUBLE) FROM weighed)
          - COALESCE(SUM(CASE WHEN 2 * b.source_size < c.v * b.w THEN 2 * b.source_size END), 0)::DOUBLE)
         / SUM(CASE WHEN 2 * b.source_size < c.v * b.w THEN 0 ELSE b.w END)::DOUBLE AS level, c.v
  FROM (SELECT DISTINCT 2 * source_size / w::DOUBLE AS v FROM weighed) c CROSS JOIN weighed b GROUP BY c.v),
chosen AS (SELECT MAX(level) AS level FROM levels WHERE level <= v),
targets AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL OR level * w >= 2 * source_size THEN 2.0::DOUBLE * source_size ELSE w * level END AS target
  FROM weighed CROSS JOIN chosen),
placed AS (
  SELECT s.*, CAST(SUM(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS b
  FROM sized s),
joined AS (
  SELECT p.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size
                 + LEAST(GREATEST(budget - (budget // source_size) * source_size - b, 0), size) END AS BIGINT) AS taken
FROM joined
"""
