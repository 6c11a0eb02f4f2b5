"""Licence scans: winnowed fingerprints of templates find candidates, banded alignment confirms them.

Texts and templates are sequences of words in lower case. Every run of three words has a hash; of each two adjacent
hashes the smaller is kept, so any four words that a text shares with a template leave a common fingerprint. An
inverted index leads from fingerprints to places in templates. Hits of a template on nearby diagonals are one
candidate; the template is aligned with the words there, within a band around the diagonals, counting equal words in
order. A candidate is reported if the matched words are at least `coverage` of the template's (0.8 by default) and the
stretch names the same licence: words that tell licences apart (`lesser`, `nc`, ...) and the numbers of a version must be
those of the template, no other and none less, so a near twin with a word or number of its own is not taken for it. Of
reports that overlap, the one with the most matched words stays, then the one with the highest coverage, the first.

Null and empty texts give no rows, nor does an empty table; repeated rows give repeated results, extra columns are
ignored. Texts are scanned
whole; a word of any length is one word.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import BoundedCache, slices
from tidemark.llm.license_texts import TELLING, TEMPLATES, VERSIONED

#: Words of a fingerprinted run, and adjacent runs of which one is kept.
RUN, WINDOW = 3, 2

_WORD = re.compile(r"\w+")


def run_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of RUN words, from the words' hashes."""
    hashes = np.zeros(max(0, len(words) - RUN + 1), np.uint64)
    for k in range(RUN):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(hashes)]
    return hashes ^ (hashes >> np.uint64(31))


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that are the smallest of some WINDOW adjacent ones, the last of equal ones."""
    if len(hashes) < WINDOW:
        return np.arange(len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - windows.argmin(1))


def aligned(template: list[str], words: list[str], first: int, last: int) -> tuple[int, int, int]:
    """Most equal words in order with word - template place within first..last; first word and past-last word of them.

    Among equally many, the shortest stretch of words.
    """
    # For each diagonal of the band: the best (matches, minus the length of the stretch) and the stretch's start.
    width = last - first + 1
    matches, starts = [0] * (width + 1), [-1] * (width + 1)
    best = (0, 0, 0, 0)
    for t, wanted in enumerate(template):
        for d in range(width):
            w = t + first + d
            # Skipping the template's word comes from the diagonal above, skipping a text's word from the one below.
            count, start = matches[d + 1], starts[d + 1]
            if 0 <= w < len(words) and words[w] == wanted:
                count, start = matches[d] + 1, starts[d] if matches[d] else w
                found = (count, start - w, start, w + 1)
                if found > best:
                    best = found
            elif matches[d] > count:
                count, start = matches[d], starts[d]
            if d and matches[d - 1] > count:
                count, start = matches[d - 1], starts[d - 1]
            matches[d], starts[d] = count, start
        matches[width], starts[width] = 0, -1
    return best[0], best[2], best[3]


def naming(words: list[str]) -> frozenset[str]:
    """What tells a licence from its near twins: telling words, and versions as numbers in order."""
    found, version = set(), []
    for k, word in enumerate(words):
        if word.isdigit() and (version or k and words[k - 1] in VERSIONED):
            version.append(word)
            continue
        if version:
            found.add(".".join(version).removesuffix(".0"))
            version = []
        if word in TELLING:
            found.add(word)
    return frozenset(found | ({".".join(version).removesuffix(".0")} if version else set()))


class Scanner:
    """The templates' inverted index, and scans of one worker's texts."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.hashes = BoundedCache(lambda word: zlib.crc32(word.encode()), 300_000, 64)
        self.names = list(templates)
        self.templates = [_WORD.findall(text.lower()) for text in templates.values()]
        self.named = [naming(words) for words in self.templates]
        places = defaultdict(list)
        for number, words in enumerate(self.templates):
            hashes = run_hashes(self._numbers(words))
            for place in winnowed(hashes):
                places[int(hashes[place])].append((number, int(place)))
        self.keys = np.array(sorted(places), np.uint64)
        self.places = [places[int(key)] for key in self.keys]

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def hits(self, words: list[str]) -> dict[int, list[int]]:
        """Diagonals (place in the text less place in the template) by template, for fingerprints in common."""
        hashes = run_hashes(self._numbers(words))
        at = np.searchsorted(self.keys, hashes)
        known = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == hashes)
        found = defaultdict(list)
        if len(known):
            kept = winnowed(hashes)
            for place in known[np.isin(known, kept)].tolist():
                for number, own in self.places[at[place]]:
                    found[number].append(place - own)
        return found

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end) of each match; start and end in code points."""
        lowered = text.lower()
        words = _WORD.findall(lowered)
        found = self.hits(words)
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        if len(spans) != len(words):  # lower case made or joined words: count places in the lowered text
            spans = [m.span() for m in _WORD.finditer(lowered)]
        matches = []
        for number, diagonals in found.items():
            template = self.templates[number]
            band = 2 + len(template) // 10
            diagonals.sort()
            cuts = [0, *(k for k in range(1, len(diagonals)) if diagonals[k] - diagonals[k - 1] > band), len(diagonals)]
            for a, b in zip(cuts, cuts[1:]):
                first, last = diagonals[a] - band, diagonals[b - 1] + band
                # Only the words that the band can reach are looked at.
                low, high = max(0, first), min(len(words), last + len(template))
                count, start, end = aligned(template, words[low:high], first - low, last - low)
                if count >= self.coverage * len(template) and naming(words[low + start : low + end]) == self.named[number]:
                    matches.append((-count, -count / len(template), low + start, low + end, self.names[number]))
        kept: list[tuple] = []  # by start, without overlaps
        for match in sorted(matches):
            place = bisect_left(kept, match[2:])
            before, after = kept[place - 1] if place else None, kept[place] if place < len(kept) else None
            if (before is None or before[1] <= match[2]) and (after is None or match[3] <= after[0]):
                kept.insert(place, (*match[2:], -match[1], -match[0]))
        return [(name, part, count, spans[a][0], spans[b - 1][1]) for a, b, name, part, count in kept]


def scan_licenses(documents: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """A row for each match: doc_id, license, coverage, matched_words, span_start, span_end, matched_text.

    Templates are a given list of fixed size; spans count code points, the end is past the last.
    """
    names = ["doc_id", "license", "coverage", "matched_words", "span_start", "span_end", "matched_text"]
    kind = dict(documents.dtypes)["doc_id"]
    schema = (
        f"doc_id {kind}, license string, coverage double, matched_words bigint, span_start bigint, span_end bigint, "
        "matched_text string"
    )
    types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in slices(batches):
            rows, found = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for match in scanner.scan(text) if text else ():
                    rows.append(k)
                    found.append((*match, text[match[3] : match[4]]))
            if rows:
                ids = batch.column("doc_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*found), types))], names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
