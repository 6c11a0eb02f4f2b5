"""A corpus pipeline: documents with a told language, without near copies, mixed by source, encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs
of the next. All but the last return the columns of documents. Columns besides those are left out, whatever their names,
and an empty table gives none of the rows of any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, language_id, mixing, near_copies
from tidemark.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL can't express fingerprints or encodings.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the others go: null and empty texts, and texts without a letter a landmark knows.

    Repeated rows stay repeated, a null id stays null, and a null lang becomes the language told.
    """
    return language_id.only_identified(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles alike by 0.8 or more.

    SimHash finds the nearest of them, by fingerprints at most two bits apart, each pair verified; prefixes of shingles
    find the others among the components that SimHash leaves.
    That of the smallest id stays, one of its repeated rows, and rows without an id only where their group has no id.
    """
    return near_copies.without_near_copies(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the one at a source's cut only up to the cut.

    Rows without a source are a source of their own; repeated rows have a share each, and texts without words none.
    """
    return mixing.mixed_copies(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids as packed 32-bit integers, checked by decoding: doc_id, lang, source, n_tokens, ...

    One row for each row given; a null text has no ids.
    """
    keep = ["doc_id", "lang", "source"]
    encoded = byte_bpe.encode_decode(docs, keep)
    return encoded.select(
        *keep,
        (F.octet_length("packed_ids") / 4).cast("long").alias("n_tokens"),
        "packed_ids",
        F.sha2("packed_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
