"""Benchmark decontamination by one Aho-Corasick automaton over words.

Test items are normalised as texts are: A-Z in lower case, words are runs of digits, letters a-z and anything beyond
ASCII. Each run of `size` consecutive words of an item is a window, as is an item of fewer words, but not of none. The
distinct windows go into an automaton whose symbols are numbers of words; each text is turned into such numbers once and
scanned once, whatever the number of windows. Hit words are merged to spans, and spans mapped back to code points of the
original text.

The automaton is sent to all tasks, so the size of the windows is measured first: up to WINDOWS of BYTES together make
one automaton, more are dealt by hash to several, and documents, written once with a row number, meet one after the
other. What windows belong to which items stays in a table that joins the windows found.

Null texts and texts without words have none and no hits; so has every text if there are no items with words. Repeated
documents give repeated results. Items of one id count once; the windows of items without an id are found, but add no
item. Extra columns are ignored, and an empty table gives no rows. Texts are read in pieces of bounded size that overlap
by a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, written

#: Words of a lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows and their bytes that make one automaton, which takes some hundred bytes a window's word.
WINDOWS, BYTES = 1 << 17, 1 << 24
#: Bytes of a text turned into words at a time.
PIECE = 1 << 22

_KEPT = ascii_lowercase.encode() + b"0123456789"
_PLAIN = bytes(b + 32 if chr(b) in ascii_uppercase else b if b >= 128 or b in _KEPT else 32 for b in range(256))

_SPAN = pa.struct([(name, pa.int64()) for name in ("first", "end", "start", "stop")])
_TYPES = {"row": pa.int64(), "doc_id": None, "n_words": pa.int64(), "spans": pa.list_(_SPAN), "windows": pa.list_(pa.string())}
_SPANS = "array<struct<first: bigint, end: bigint, start: bigint, stop: bigint>>"


def words(text: Column | str) -> Column:
    lowered = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, window and key of every item's windows, each once; a window is its words joined by spaces."""
    told = items.select("item_id", words("text").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    windows = told.select(
        "item_id", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("words", s, size), " "))).alias("window")
    )
    return windows.distinct().select("item_id", "window", F.md5("window").alias("key"))


class Matcher:
    """The automaton over windows, given as (key, window)."""

    def __init__(self, windows: list[tuple[str, str]]):
        self.keys = [key for key, _ in windows]
        self._numbers: dict[bytes, int] = {}
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.longest = 0
        for place, (_, window) in enumerate(windows):
            named = tuple(self._numbers.setdefault(w, len(self._numbers) + 1) for w in window.encode().split())
            self.longest = max(self.longest, len(named))
            self._automaton.add_word(named, (place, len(named)))
        if windows:
            self._automaton.make_automaton()

    def find(self, plain: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """The number of words, and (first word, word after the last, window) of all occurrences, by their ends."""
        found, count, carried, start = [], 0, (), 0
        while start < len(plain):
            stop = plain.find(b" ", start + PIECE)
            stop = len(plain) if stop < 0 else stop
            piece = plain[start:stop].split()
            start = stop
            if self.longest:
                get = self._numbers.get
                named = carried + tuple([get(word, 0) for word in piece])
                before = count - len(carried)
                for last, (place, length) in self._automaton.iter(named):
                    if last >= len(carried):  # others were found with the piece before
                        found.append((before + last + 1 - length, before + last + 1, place))
                carried = named[max(0, len(named) - self.longest + 1) :]
            count += len(piece)
        return count, found


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of words inside any occurrence; stretches that touch are one."""
    spans: list[list[int]] = []
    for first, end, _ in sorted(found):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([first, end])
    return [tuple(span) for span in spans]


def offsets(plain: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points where spans of words start and stop in the original text, whose bytes stand as in `plain`."""
    raw = np.frombuffer(plain, np.uint8)
    edges = np.flatnonzero(np.diff(raw != 32, prepend=False, append=False))  # starts and stops of words in turn
    wanted = np.array([(edges[2 * first], edges[2 * end - 1]) for first, end in spans]).ravel()
    leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [tuple(pair) for pair in leads[wanted].reshape(-1, 2).tolist()]


def _scanned(rows: DataFrame, windows: DataFrame, all_rows: bool) -> DataFrame:
    """row, doc_id, n_words, spans and windows found of rows (row, doc_id, text); only of hit ones unless all_rows."""
    # At most about WINDOWS rows of BYTES: `windows` is one automaton's share.
    sent = rows.sparkSession.sparkContext.broadcast([(w.key, w.window) for w in windows.toLocalIterator()])
    names = list(_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in slices(batches):
            made = []
            for text in batch.column("text").to_pylist():
                plain = (text or "").encode().translate(_PLAIN)
                count, found = matcher.find(plain)
                spans = merged(found)
                placed = [(*s, *o) for s, o in zip(spans, offsets(plain, spans))] if spans else []
                told = [dict(zip(("first", "end", "start", "stop"), p)) for p in placed]
                made.append((count, told, sorted({matcher.keys[place] for *_, place in found})))
            kept = [k for k, (_, told, _) in enumerate(made) if all_rows or told]
            arrays = [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("row", "doc_id")]
            arrays += [pa.array([made[k][j] for k in kept], _TYPES[name]) for j, name in enumerate(names[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"row bigint, doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, spans {_SPANS}, windows array<string>"
    return rows.mapInArrow(run, schema)


def _joined_spans(spans: Column) -> Column:
    """Spans of several automata, in order of their words and merged like those of one."""
    empty = F.lit([]).cast(_SPANS)

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(
            last["first"].alias("first"),
            F.greatest(last["end"], span["end"]).alias("end"),
            last["start"].alias("start"),
            F.greatest(last["stop"], span["stop"]).alias("stop"),
        )
        touches = (F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["end"])
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touches, F.concat(before, F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


def contaminated(
    documents: DataFrame, items: DataFrame, size: int = 10, windows_at_once: int = WINDOWS, bytes_at_once: int = BYTES
) -> DataFrame:
    """Per document: doc_id, n_words, spans and items (ids as strings, in order).

    A span is a stretch of hit words: `first` word and the one after its `end`, `start` and `stop` in code points of the
    original text.
    """
    told = written(item_windows(items, size), "windows")
    distinct = told.select("window", "key").distinct()
    total = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-total.n // windows_at_once), -(-total.bytes // bytes_at_once))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if parts == 1:
        marked = written(_scanned(rows, distinct, True), "marked")
    else:
        rows = written(rows, "numbered")
        part = F.pmod(F.xxhash64("window"), F.lit(parts))
        each = [_scanned(rows, distinct.where(part == k), k == 0) for k in range(parts)]
        together = reduce(DataFrame.union, each).groupBy("row").agg(
            F.any_value("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            _joined_spans(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.flatten(F.collect_list("windows")).alias("windows"),
        )
        marked = written(together, "marked")
    # A window that very many documents hold is split by the adaptive skew join.
    found = marked.select("row", F.explode("windows").alias("key")).join(told.select("item_id", "key"), "key")
    by_row = found.where("item_id is not null").groupBy("row").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    items_of = F.sort_array(F.coalesce("items", F.array().cast("array<string>")))
    return marked.join(by_row, "row", "left").select("doc_id", "n_words", "spans", items_of.alias("items"))


def digests(documents: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda done, s: done + s["end"] - s["first"])
    return contaminated(documents, items, size).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The result as SQL: windows of documents, of each length that items have, joined with those of items.
SQL = r"""
WITH told AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS length, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM told WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
doc_windows AS (
  SELECT r, length, s, array_to_string(w[s:s + length - 1], ' ') AS win
  FROM (SELECT r, w, length, unnest(range(1, len(w) - length + 2)) AS s
        FROM docs, (SELECT DISTINCT length FROM item_windows))),
found AS (SELECT d.r, d.s, d.length, i.item_id FROM doc_windows d JOIN item_windows i USING (length, win)),
hits AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(s, s + length)) AS k FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
