"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, at least `times` q and at least `shortest` words long, that no word
next to it extends. Words are numbered. At each scale B, a power of two, periods from B to 2B - 1 are sought: a run of
four periods holds a block of B words, at a multiple of B, whole together with its repetition q words on. The sum of
squared differences between a block and the stretch that follows, at all B shifts at once, is two sums of squares less
twice a correlation, which number-theoretic transforms give without rounding; enough primes are used for the largest sum
there can be, so it is 0 exactly where the block occurs. Only blocks all of whose words return within 2B words are
convolved, others can't occur there. Shifts found are seeds: equal words q apart are followed both ways, and the stretch
is a run if it is long enough and no divisor of q is a period of it.

Three or more shifts of one block are in arithmetic progression, as the block itself has their difference d as a period.
A run through it then ends, or begins, q words after the stretch of period d around the block does, so two periods are
left to try instead of all shifts. Stretches followed are remembered. The work grows with n log n for n words.

Null and empty texts and texts without words have no runs and nothing collapsed. Repeated rows give repeated results,
an empty table none. Columns but those asked for are ignored. Texts are taken whole, in batches of bounded size, one at
least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: Primes of the form k 2^26 + 1 with a generator of each; in that order as many as are needed.
PRIMES = ((2013265921, 31), (469762049, 3), (1811939329, 13))
#: Words of texts that are searched together, and numbers of a transform's matrix.
WORDS_AT_ONCE, NUMBERS_AT_ONCE = 1 << 16, 1 << 17
#: Farther than any word.
NEVER = np.int64(1) << 62

Run = tuple[int, int, int]


@lru_cache(maxsize=None)
def _twiddles(prime: int, generator: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to half - 1 of a primitive root of order 2 half, and of its inverse, as columns."""
    root = pow(generator, (prime - 1) // (2 * half), prime)
    both = []
    for base in (root, pow(root, -1, prime)):
        powers = np.ones(1, np.uint64)
        while len(powers) < half:
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), prime)) % np.uint64(prime)])
        both.append(powers[:, None])
    return tuple(both)


def transform(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The transform of each column, in bit-reversed order; a's rows are a power of two."""
    p, half = np.uint64(prime), len(a) // 2
    while half:
        pairs = a.reshape(-1, 2, half, a.shape[1])
        total, apart = pairs[:, 0] + pairs[:, 1], pairs[:, 0] + (p - pairs[:, 1])
        apart = apart * _twiddles(prime, generator, half)[0] % p
        a = np.stack([np.minimum(total, total - p), apart], axis=1).reshape(a.shape)  # below 0 wraps to large
        half //= 2
    return a


def inverse(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Undoes transform, but for a factor of the number of rows."""
    p, half = np.uint64(prime), 1
    while half < len(a):
        pairs = a.reshape(-1, 2, half, a.shape[1])
        other = pairs[:, 1] * _twiddles(prime, generator, half)[1] % p
        total, apart = pairs[:, 0] + other, pairs[:, 0] + (p - other)
        a = np.stack([np.minimum(total, total - p), np.minimum(apart, apart - p)], axis=1).reshape(a.shape)
        half *= 2
    return a


def occurrences(numbers: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `starts` and shifts from size to 2 size - 1 at which the blocks there occur again, by place and shift.

    `numbers` goes on for 3 `size` after each start; sums of squares of `size` of its values fit the primes' product.
    """
    largest, needed, product = int(numbers.max(initial=1)), 0, 1
    while product <= size * largest * largest:
        product *= PRIMES[needed][0]
        needed += 1
    found = ([], [])
    at_once = max(1, NUMBERS_AT_ONCE // (2 * size))
    inside = np.arange(2 * size)[:, None]
    for first in range(0, len(starts), at_once):
        here = starts[first : first + at_once]
        blocks = np.zeros((2 * size, len(here)), np.uint64)
        # Backwards from 0, so that a product of transforms is a correlation.
        blocks[-np.arange(size)] = numbers[here + inside[:size]]
        after = numbers[here + size + inside]
        same = np.ones((size, len(here)), bool)
        for prime, generator in PRIMES[:needed]:
            p = np.uint64(prime)
            both = transform(blocks % p, prime, generator) * transform(after % p, prime, generator) % p
            correlation = inverse(both, prime, generator)[:size]
            sums = np.cumsum(np.concatenate([np.zeros((1, len(here)), np.uint64), after * after % p]), axis=0)
            squares = (blocks * blocks % p).sum(0) + sums[size : 2 * size] - sums[:size]
            same &= squares % p * np.uint64(2 * size) % p == np.uint64(2) * correlation % p
        place, shift = np.nonzero(same.T)
        found[0].append(first + place)
        found[1].append(size + shift)
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found[0] or empty), np.concatenate(found[1] or empty)


def _next_same(numbers: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How far the next equal word of the same text is; NEVER where there is none, and between texts."""
    order = np.lexsort((numbers, texts))
    gap = np.full(len(numbers), NEVER)
    same = (numbers[order[1:]] == numbers[order[:-1]]) & (texts[order[1:]] == texts[order[:-1]])
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    gap[numbers == 0] = NEVER
    return gap


class Stretches:
    """Maximal stretches of a text's words of given periods, each followed once."""

    def __init__(self, numbers: np.ndarray, begin: int, end: int):
        self._numbers, self._begin, self._end = numbers, begin, end
        self._known: dict[int, list[tuple[int, int]]] = {}

    def around(self, place: int, period: int) -> tuple[int, int]:
        """The stretch that holds `place` and the word a period on, which are equal."""
        known = self._known.setdefault(period, [])
        for first, end in known[-3:]:
            if first <= place < end - period:
                return first, end
        x, right, step = self._numbers, place, 64
        while right + period < self._end:
            n = min(step, self._end - period - right)
            other = x[right : right + n] != x[right + period : right + period + n]
            if other.any():
                right += int(other.argmax())
                break
            right, step = right + n, 2 * step
        left, step = place, 64
        while left > self._begin:
            n = min(step, left - self._begin)
            other = x[left - n : left] != x[left - n + period : left + period]
            if other.any():
                left -= int(other[::-1].argmax())
                break
            left, step = left - n, 2 * step
        known.append((left, right + period))
        return known[-1]

    def is_smallest(self, first: int, period: int) -> bool:
        """Whether no divisor of the period is one of the stretch, which holds two periods at least."""
        x, rest, factor = self._numbers, period, 2
        while rest > 1:
            if factor * factor > rest:
                factor = rest
            if rest % factor:
                factor += 1
                continue
            while rest % factor == 0:
                rest //= factor
            part = period // factor
            if np.array_equal(x[first : first + 2 * period - part], x[first + part : first + 2 * period]):
                return False
        return True


def _seeds(stretches: Stretches, place: int, shifts: list[int], size: int) -> list[int]:
    """Periods to try for runs through the block at `place` that occurs at these shifts."""
    if len(shifts) < 3:
        return shifts
    step = shifts[1] - shifts[0]
    own, other = stretches.around(place, step), stretches.around(place + shifts[0], step)
    return [q for q in {other[0] - own[0], other[1] - own[1]} if size <= q < 2 * size]


def runs_of(texts: list[np.ndarray], times: int = 4, shortest: int = 6) -> list[list[Run]]:
    """(start, length, period) of each text's runs, by start and period; texts are numbers of words, from 1."""
    if times < 4:
        raise ValueError("blocks are found in runs of four periods or more")
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - [len(t) + 1 for t in texts]
    longest = max((len(t) for t in texts), default=0)
    if longest < shortest:
        return [[] for _ in texts]
    tail = np.zeros(3 * longest, np.uint64)  # room for the last blocks' windows; 0 is no word
    numbers = np.concatenate([piece for t in texts for piece in (t.astype(np.uint64), tail[:1])] + [tail])
    of_text = np.repeat(np.arange(len(texts)), ends - begins)
    gaps = _next_same(numbers[: len(of_text)], of_text)
    lengths = (ends - begins - 1)[of_text]
    found: list[set[Run]] = [set() for _ in texts]
    stretches = [Stretches(numbers, b, e - 1) for b, e in zip(begins.tolist(), ends.tolist())]
    size = 1
    while times * size <= longest:
        starts = np.arange(len(gaps)) * size
        wanted = (gaps < 2 * size) & (lengths[starts] >= max(shortest, times * size))
        starts = starts[wanted]
        places, shifts = occurrences(numbers, starts, size)
        at = starts[places]
        owner = of_text[at]
        whole = (shifts * times <= lengths[at]) & (at + shifts + size <= ends[owner] - 1)
        at, shifts, owner = at[whole], shifts[whole], owner[whole]
        firsts = np.flatnonzero(np.diff(at, prepend=-1))  # of each block that occurs again
        for k, upto in zip(firsts.tolist(), [*firsts[1:].tolist(), len(at)]):
            place, text = int(at[k]), int(owner[k])
            here = stretches[text]
            for q in _seeds(here, place, shifts[k:upto].tolist(), size):
                if numbers[place] != numbers[place + q]:
                    continue
                first, end = here.around(place, q)
                run = (first - int(begins[text]), end - first, q)
                if end - first >= max(shortest, times * q) and run not in found[text] and here.is_smallest(first, q):
                    found[text].add(run)
        # The farthest return in blocks of twice the size.
        gaps = gaps[: len(gaps) // 2 * 2].reshape(-1, 2).max(1)
        size *= 2
    return [sorted(f, key=lambda run: (run[0], run[2])) for f in found]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by a space, without those that any run holds after its first period."""
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, period in runs:
            stays[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(stays).tolist()]
    return b" ".join(words)


def _numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter([seen.setdefault(w, len(seen) + 1) for w in words], np.int64, len(words))


Change = Callable[[int | None, list[bytes]], list[bytes]]


def periodic_runs(documents: DataFrame, change: Change | None = None, times: int = 4, shortest: int = 6) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length, period, by start and period) and the collapsed text.

    Words are runs of anything but ASCII white space. change(doc_id, words) may put others in their place.
    """
    span = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def told(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of([_numbered(t) for t in texts], times, shortest)
        rows = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
        left = [collapsed(t, r).decode() for t, r in zip(texts, found)]
        arrays = [ids, pa.array(map(len, texts), pa.int64()), pa.array(rows, pa.list_(span)), pa.array(left, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, first, texts, held = batch.column("doc_id"), 0, [], 0
            for k, (doc_id, text) in enumerate(zip(ids.to_pylist(), batch.column("text").to_pylist())):
                words = (text or "").encode().split()  # of bytes: ASCII white space alone splits
                texts.append(change(doc_id, words) if change else words)
                held += len(words)
                if held >= WORDS_AT_ONCE:
                    yield told(ids.slice(first, len(texts)), texts)
                    first, texts, held = k + 1, [], 0
            if texts:
                yield told(ids.slice(first, len(texts)), texts)

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def with_repetition(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In every tenth document by a hash of its id the words from some place on repeat the first of them."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def digests(documents: DataFrame) -> DataFrame:
    """Per document, with repetitions put in: doc_id, n_runs, its longest run, and digests of runs and collapsed text."""
    found = periodic_runs(documents, with_repetition)
    longest = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("n"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    told = found.withColumn("longest", longest)
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        F.col("longest.n").alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("1000 * longest.n div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
