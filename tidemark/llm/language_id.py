"""Language identification by string kernels, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the number of character n-grams, of 1 to 4 characters, that both contain, over the
geometric mean of the numbers each contains. N-grams are taken inside and at the edges of words, in lower case, with
everything but letters read as a space, and counted as present or not; they are hashed into 2^22 slots, more than any
natural text fills. Some labelled texts are landmarks, whose n-grams are held as a bit for each landmark: a text's n-grams
select rows of that matrix, and their sum is its kernel with all landmarks. It is described by these values, whitened by
the kernel among the landmarks and brought to unit length. One ridge regression for each language tells it from the
rest; texts are scored in batches by two matrix products.

The model is fitted on a bounded sample of labelled rows: of the `languages` most frequent labels (ties by name), of each
the rows with the smallest hash of their id, up to `rows_per_language` and to an equal share of `rows_in_all`, among
texts of at most `sample_bytes` bytes. Landmarks are dealt to the languages in turn, one at least to each; beyond that
only while all together hold at most MOST_NGRAMS n-grams. So neither the driver's memory nor the model grows with the
rows or with the number of labels. Everything else covers all rows and whole texts.

A text that is null or has no letter is `und` with score 0. A text with letters gets a learned language; the score is
its regression value, cut to 0 to 1, and 0 if it shares no n-gram with any landmark. Ties go to the language first by
name. If there are no labelled rows every text is `und`. Rows of equal texts get equal results; rows with a null id
are never learned from unless `is_training` says so. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, text_size

#: Slots for hashed n-grams, as a power of two, and the longest n-gram.
SLOT_BITS, LONGEST = 22, 4
#: Languages, and rows of them all, that are learned; n-grams of all landmarks but each language's first.
LANGUAGES, ROWS_IN_ALL, MOST_NGRAMS = 512, 2048, 1 << 18
#: Landmark rows summed at a time.
NGRAMS_AT_ONCE = 1 << 14
#: Characters of a text turned into n-grams at a time, and texts scored at a time.
CHARS_AT_ONCE, TEXTS_AT_ONCE = 1 << 18, 64
UNDETERMINED = "und"

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point whether it is a letter; built once per process."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS


def _spaced(text: str, letters: np.ndarray) -> tuple[np.ndarray, bool]:
    """Code points in lower case, runs of other characters as one space; whether there is a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = letters[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, 32)[keep], bool(letter.any())


def _hashed(text: str, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Slots of a text's n-grams, a part of the text at a time; nothing for parts without a letter."""
    shift = np.uint64(64 - SLOT_BITS)
    for start in range(0, len(text), CHARS_AT_ONCE):
        # A part starts a little before its place, so that no n-gram is lost between parts.
        part, has = _spaced(text[max(0, start - 2 * LONGEST) : start + CHARS_AT_ONCE], letters)
        if not has:
            continue
        points = np.concatenate([[32], part[: len(part) - (part[-1] == 32)], [32]]).astype(np.uint64)
        rolled, found = np.zeros(len(points), np.uint64), []
        for n in range(1, LONGEST + 1):
            rolled = (rolled[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + points[n - 1 :] + np.uint64(n)
            # A space alone is no n-gram.
            marked = rolled if n > 1 else rolled[points != 32]
            found.append((marked * np.uint64(0xD6E8FEB86659FD93)) >> shift)
            rolled = rolled[:-1]
            if not len(rolled):
                break
        yield np.concatenate(found).astype(np.int64)


class NGrams:
    """Distinct slots of one text after another.

    Every slot has the number of the n-gram that came there last. Numbers never repeat, so nothing is cleared between texts.
    """

    def __init__(self):
        self._last = np.zeros(1 << SLOT_BITS, np.int64)
        self._next = 1

    def __call__(self, text: str) -> np.ndarray:
        begun, found = self._next, [np.zeros(0, np.int64)]
        for slots in _hashed(text, _letters()):
            new = slots[self._last[slots] < begun]
            numbers = np.arange(self._next, self._next + len(new))
            self._last[new] = numbers
            found.append(new[self._last[new] == numbers])
            self._next += len(new)
        return np.concatenate(found)


@dataclass
class Model:
    """Landmarks' n-grams, their numbers, and the regressions behind the whitening."""

    languages: list[str]
    ngrams: np.ndarray  # slots that some landmark has
    landmarks: np.ndarray  # n-grams x landmarks, packed bits
    sizes: np.ndarray
    whitening: np.ndarray  # landmarks x components
    weights: np.ndarray  # components x languages

    def places(self) -> np.ndarray:
        """For every slot its row among the landmarks' n-grams, or -1."""
        places = np.full(1 << SLOT_BITS, -1, np.int32)
        places[self.ngrams] = np.arange(len(self.ngrams))
        return places

    def kernel(self, slots: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The kernel of a text, told by its distinct slots, with every landmark."""
        rows = places[slots]
        rows, common = rows[rows >= 0], np.zeros(len(self.sizes), np.float32)
        for start in range(0, len(rows), NGRAMS_AT_ONCE):
            common += _bits(self.landmarks[rows[start : start + NGRAMS_AT_ONCE]], len(self.sizes)).sum(0, np.int32)
        return common / np.sqrt(np.maximum(1, len(slots) * self.sizes))

    def features(self, kernel: np.ndarray) -> np.ndarray:
        """Whitened kernel values, of unit length; zero where no n-gram is shared."""
        whitened = kernel @ self.whitening
        norm = np.linalg.norm(whitened, axis=1, keepdims=True)
        return np.where(kernel.any(1, keepdims=True), whitened / np.maximum(norm, 1e-12), 0)

    def score(self, kernel: np.ndarray) -> np.ndarray:
        return self.features(kernel) @ self.weights


def _bits(packed: np.ndarray, count: int) -> np.ndarray:
    return np.unpackbits(packed, axis=1, count=count)


def _chosen(texts: list[str], of: dict[str, list[int]], landmarks: int, ngrams: NGrams) -> dict[int, np.ndarray]:
    """Landmarks and their slots, dealt to the languages in turn."""
    chosen, held, served = {}, np.zeros(1 << SLOT_BITS, bool), set()
    for turn in range(max(map(len, of.values()))):
        for language, own in of.items():
            if turn >= len(own) or len(chosen) >= max(landmarks, len(of)) and language in served:
                continue
            slots = ngrams(texts[own[turn]])
            fits = held.sum() + np.count_nonzero(~held[slots]) <= MOST_NGRAMS
            if len(slots) and (fits or language not in served):
                chosen[own[turn]] = slots
                held[slots] = True
                served.add(language)
        if len(chosen) >= max(landmarks, len(of)):
            break
    return chosen


def fit(texts: list[str], labels: list[str], landmarks: int = 160, ridge: float = 1e-3) -> Model:
    """A model of the labelled texts; one of them at least has a letter."""
    ngrams, languages = NGrams(), sorted(set(labels))
    of = {language: [k for k, label in enumerate(labels) if label == language] for language in languages}
    chosen = _chosen(texts, of, landmarks, ngrams)
    known = np.unique(np.concatenate(list(chosen.values())))
    packed = np.zeros((len(known), -(-len(chosen) // 8)), np.uint8)
    for k, slots in enumerate(chosen.values()):
        packed[np.searchsorted(known, slots), k // 8] |= np.uint8(128 >> k % 8)
    sizes = np.array([len(slots) for slots in chosen.values()], np.float64)
    model = Model(languages, known, packed, sizes, np.zeros((len(chosen), 0)), np.zeros((0, len(languages))))
    places = model.places()
    kernel = np.array([model.kernel(slots, places) for slots in chosen.values()], np.float64)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    large = values > 1e-6 * max(values.max(initial=0), 1e-12)
    model.whitening = (vectors[:, large] / np.sqrt(values[large])).astype(np.float32)
    x = model.features(np.array([model.kernel(ngrams(text), places) for text in texts], np.float32)).astype(np.float64)
    y = np.array([[label == language for language in languages] for label in labels], np.float64)
    # Languages weigh alike, whatever their share of the sample.
    weight = np.array([1 / len(of[label]) for label in labels])[:, None]
    gram = x.T @ (x * weight) + ridge * np.eye(x.shape[1])
    model.weights = np.linalg.solve(gram, x.T @ (y * weight)).astype(np.float32)
    return model


def labelled_sample(
    documents: DataFrame, is_training: Column, rows_per_language: int, sample_bytes: int, languages: int, rows_in_all: int
) -> DataFrame:
    """doc_id, text and lang of the rows to learn from, at most about `rows_per_language` of each language.

    Which rows these are is told by a threshold on a hash of the id, from counts of rows; texts are read only after.
    """
    fits = is_training & F.col("lang").isNotNull() & (text_size() <= sample_bytes) & F.col("text").isNotNull()
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30))
    counts = documents.where(fits).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    rows_per_language = max(1, min(rows_per_language, rows_in_all // max(1, len(counts))))
    limits = {lang: -(-(rows_per_language << 30) // count) for lang, count in counts}
    if not limits:
        return documents.where("false").select("doc_id", "text", "lang")
    below = F.create_map(*(F.lit(x) for lang, most in limits.items() for x in (lang, float(most))))[F.col("lang")]
    # Rows repeated with their id count once, so the number of rows is bounded however often one id comes.
    most = 2 * rows_per_language * len(limits)
    return documents.where(fits & (place < below)).select("doc_id", "text", "lang").distinct().limit(most)


def train(
    documents: DataFrame,
    is_training: Column,
    rows_per_language: int = 400,
    sample_bytes: int = 1 << 16,
    languages: int = LANGUAGES,
    rows_in_all: int = ROWS_IN_ALL,
) -> Model | None:
    """A model from the bounded sample; None if there is nothing to learn from."""
    found = labelled_sample(documents, is_training, rows_per_language, sample_bytes, languages, rows_in_all).collect()
    found = sorted(found, key=lambda r: (r.doc_id is None, r.doc_id, r.text, r.lang))
    kept = [r for r in found if any(c.isalpha() for c in r.text)]
    return fit([r.text for r in kept], [r.lang for r in kept]) if kept else None


def predict(
    documents: DataFrame, model: Model | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Columns `keep` of every row, with the predicted language and its score under these names."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ngrams = shared.value, NGrams()
        places = known and known.places()
        for batch in slices(batches, TEXTS_AT_ONCE):
            texts = batch.column("text").to_pylist()
            if known is None:
                told, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            else:
                lettered, kernel = np.zeros(len(texts), bool), np.zeros((len(texts), len(known.sizes)), np.float32)
                for k, text in enumerate(texts):
                    slots = ngrams(text or "")
                    lettered[k], kernel[k] = len(slots), known.kernel(slots, places)
                values = known.score(kernel)
                best = values.argmax(1)
                told = [known.languages[k] if has else UNDETERMINED for k, has in zip(best, lettered)]
                scores = np.where(lettered, values[np.arange(len(texts)), best].clip(0, 1), 0).astype(np.float64)
            arrays = [*(batch.column(c) for c in keep), pa.array(told, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    types = dict(documents.select(*keep).dtypes)
    schema = "".join(f"`{name}` {types[name]}, " for name in keep) + f"{names[0]} string, {names[1]} double"
    return documents.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def held_out() -> Column:
    """Whether a document's label is kept for testing: CRC-32 of its id as text has the remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. A null id is held out."""
    model = train(documents, ~held_out())
    return predict(documents, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def only_identified(documents: DataFrame) -> DataFrame:
    """The documents whose language is told, with all their columns; a null lang becomes the predicted one.

    Rejected are texts that are null, have no letter, or share no n-gram with any landmark.
    """
    columns = documents.columns
    names = [_free(name, columns) for name in ("lang_pred", "score")]
    found = predict(documents, train(documents, ~held_out()), columns, tuple(names))
    stays = found.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) > 0))
    return stays.withColumn("lang", F.coalesce("lang", names[0])).select(*columns)


def _free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name
