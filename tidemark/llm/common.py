"""Helpers that the operators share: input columns, Arrow batches, written tables, bounded caches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import scratch_path
from tidemark.sources.folders import Folder

#: Texts are turned into Python strings this many rows at a time, whatever the size of an Arrow batch.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a bounded number of rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def per_text(columns: list[str], make: Callable[[], Callable[[str], tuple]], names: list[str], types: list[pa.DataType]):
    """A function for mapInArrow: keeps `columns` and adds what make()(text) returns for each text (null: empty).

    `make` runs once per task; what it builds may be kept between tasks of a worker by the caller's module.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in slices(batches):
            results = [one(text or "") for text in batch.column("text").to_pylist()]
            kept = [batch.column(name) for name in columns]
            made = [pa.array([r[k] for r in results], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(kept + made, columns + names)

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, and nothing upstream runs twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = StructType([field for field in df.schema])
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of that many rows at most for what runs meanwhile: both sides of a worker hold some at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables that one run writes to the shared folder, below a folder that is removed once none is read any more."""

    def __init__(self, spark: SparkSession, name: str):
        self._folder = Folder(spark, scratch_path(spark, name))
        self._made = 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self._made += 1
        path = self._folder.child(f"{self._made}-{name}")
        df.write.parquet(path)
        return df.sparkSession.read.schema(StructType(list(df.schema))).parquet(path)

    def clear(self) -> None:
        self._folder.remove()


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, packed, little end first: set where a number of the column has its first `bits` bits.

    Numbers are hashes of 64 bits. The driver gathers 64 bits a row, so what it gets is bounded by `bits` alone.
    """
    (name,) = hashes.columns
    slots = hashes.select(F.shiftrightunsigned(F.col(name), 64 - bits).alias("slot"))
    packed = slots.groupBy(F.expr("slot div 64").alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("set"))
    found, whole = packed.toArrow(), np.zeros(1 << (bits - 6), np.int64)
    whole[found["place"].to_numpy()] = found["set"].to_numpy()
    return whole.view(np.uint8)


def in_bitmap(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap is set for each of the signed hashes."""
    slots = hashes.view(np.uint64) >> np.uint64(64 - (len(packed).bit_length() + 2))
    return (packed[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def text_size(column: str = "text"):
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


class BoundedCache(dict):
    """Remembers make(key) for keys of at most `longest` characters.

    It forgets everything when it holds `limit` entries; what it returns never depends on that.
    """

    def __init__(self, make: Callable, limit: int, longest: int):
        super().__init__()
        self._make, self._limit, self._longest = make, limit, longest

    def __missing__(self, key):
        return self.keep(key, self._make(key))

    def keep(self, key, value):
        if len(key) <= self._longest:
            if len(self) >= self._limit:
                self.clear()
            self[key] = value
        return value


#: In texts whose characters all lie below this one, the Unicode versions of all libraries agree on classes.
PLAIN_BELOW = "\u0530"


def is_plain(text: str) -> bool:
    return text.isascii() or max(text) < PLAIN_BELOW


def plain_class(*kinds: str) -> str:
    """The characters below PLAIN_BELOW of some general categories, for use in brackets of a pattern."""
    return "".join(
        re.escape(chr(c)) for c in range(ord(PLAIN_BELOW)) if unicodedata.category(chr(c))[0] in kinds
    )


#: White space among plain characters, as Unicode's property has it: U+001C to U+001F aren't.
PLAIN_SPACE = r"\t-\r \x85\xa0"
