"""Language identification, token counts and byte-level encoding against libraries and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, language_id, token_counts
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
ODD = ["", " ", "\u0085\xa0", "a<|startoftext|>b<|endoftext|> <|STARTOFTEXT|>", "ΑΣ ΑΣΑ İ", "ṩ á q̇", "漢字ひ한가\x1c😀 👍🏽", "x" * 3000, "'s don't IT'LL"]
POOL = "abcdefABC  '\t\n.,!?12éÉßüñΣσς̣́̈̇漢字ひ한가\u0085\xa0\x1c 😀👍🏽ำİıﬁ½²Ⅷ‍æᲉ"


def odd_texts(n, seed=5):
    draw = random.Random(seed)
    return ["".join(draw.choice(POOL) for _ in range(draw.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def words_library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def bytes_library():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_librarys(spark, docs_of, words_library):
    texts = [None, *ODD, *odd_texts(2000)]
    rows = token_counts.token_counts(docs_of(texts)).orderBy("doc_id").collect()
    for text, row in zip(texts, rows):
        expected = len(words_library.encode(text or "", add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes) == (expected, len((text or "").encode())), repr(text)
    assert token_counts.token_counts(docs_of([])).count() == 0


def test_counts_of_whole_table(spark, words_library):
    rows = {r.doc_id: r for r in QUERIES["op2_token_counts"](spark, DATA).collect()}
    for doc in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        n = len(words_library.encode(doc.text or "", add_special_tokens=False).ids)
        assert rows[doc.doc_id].n_tokens == n and rows[doc.doc_id].over_limit == (n > 2048)


def test_a_small_cache_changes_nothing(words_library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 3)
    counter = token_counts.HeapBpe(words_library.to_str())
    for text in odd_texts(200, 9):
        assert counter.count(text) == len(words_library.encode(text, add_special_tokens=False).ids)


def test_ids_are_the_librarys_and_decode_to_the_text(spark, docs_of, bytes_library):
    texts = [None, *ODD, *odd_texts(2000, 6)]
    rows = byte_bpe.encode_decode(docs_of(texts), ["doc_id"], with_offsets=True).orderBy("doc_id").collect()
    for text, row in zip(texts, rows):
        text = text or ""
        ids = np.frombuffer(bytes(row.packed_ids), "<u4").tolist()
        assert ids == bytes_library.encode_ordinary(text), repr(text)
        assert bytes(row.decoded).decode() == text
        # Each token's bytes lie within the characters that its offsets name.
        for token, start, end in zip(ids, row.char_starts, row.char_ends):
            assert bytes_library.decode_single_token_bytes(token) in text[start:end].encode()
    assert byte_bpe.digests(docs_of([])).count() == 0


def test_digests_of_whole_table(spark, bytes_library):
    rows = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, DATA).collect()}
    for doc in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids, row = bytes_library.encode_ordinary(doc.text or ""), rows[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()


def test_vocabulary_that_cannot_be_reached_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.last_merge(b"abc", {b"abc": 300})


def test_language_of_held_out_documents(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {k for k, r in rows.items() if r.held_out}
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_edge_cases(spark, docs_of):
    known = [(k, t, l, "s") for k, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 40)]
    odd = [(1000, None, None, None), (1001, "", "en", "s"), (1002, "12 .. 3", "de", "s"), (1003, "the dog", None, None), (None, "der Hund", None, "s")]
    odd += [(1004, "und die Katze " * 30000, None, "s")]
    found = language_id.identify(docs_of(known + odd)).collect()
    told = {r.doc_id: (r.lang_pred, r.score > 0) for r in found}
    assert told[1000] == told[1001] == told[1002] == ("und", False)
    assert told[1003] == ("en", True) and told[1004] == ("de", True) and told[None] == ("de", True)
    kept = language_id.only_identified(docs_of(known + odd))
    assert kept.columns == docs_of([]).columns
    assert {r.doc_id for r in kept.collect()} == {*range(80), 1003, 1004, None}
    assert {r.lang_pred for r in language_id.identify(docs_of([(1, "abc", None, "s")])).collect()} == {"und"}
    assert language_id.identify(docs_of([])).count() == 0


def test_language_ignores_label_source_and_id(spark, docs_of):
    rows = [(k, t, l, "s") for k, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 40)]
    model = language_id.train(docs_of(rows), ~language_id.held_out())
    one = language_id.predict(docs_of([(5, "the dog", "en", "a")]), model, ["doc_id"]).first()
    other = language_id.predict(docs_of([(5000, "the dog", "de", "b")]), model, ["doc_id"]).first()
    assert one[1:] == other[1:]


def words_of(seed, n=400, alphabet="abcdefghijklmnopqrstuvwxyz"):
    """Words of an invented language, with letters of its own preference."""
    draw = random.Random(seed)
    weights = [draw.random() ** 3 for _ in alphabet]
    return ["".join(draw.choices(alphabet, weights, k=draw.randint(2, 8))) for _ in range(n)]


def test_many_labels_fit_in_a_bounded_sample(spark, docs_of):
    draw, languages = random.Random(3), [f"l{k:03}" for k in range(500)]
    words = {language: words_of(k, 60) for k, language in enumerate(languages)}
    rows = [(20 * k + n, " ".join(draw.choices(words[language], k=30)), language, "s") for k, language in enumerate(languages) for n in range(6)]
    frame = docs_of(rows)
    sample = language_id.labelled_sample(frame, ~language_id.held_out(), 400, 1 << 16, 512, 2048)
    assert sample.count() <= 2 * 2048
    few = language_id.labelled_sample(frame, ~language_id.held_out(), 400, 1 << 16, 7, 2048).collect()
    assert len({r.lang for r in few}) == 7
    model = language_id.train(frame, ~language_id.held_out())
    assert len(model.languages) >= 490 and len(model.sizes) >= len(model.languages)
    told = {r.doc_id: r.lang_pred for r in language_id.predict(frame, model, ["doc_id"]).collect()}
    assert np.mean([told[k] == language for k, _, language, _ in rows if language in model.languages]) >= 0.95


def test_long_texts_keep_their_score(spark, docs_of):
    draw = random.Random(8)
    cjk = [chr(c) for c in range(0x4E00, 0x9000)]
    own = {"aa": words_of(1, 4000), "bb": words_of(2, 4000), "zh": ["".join(draw.choices(cjk[:6000], k=3)) for _ in range(4000)]}
    rows = [(k, " ".join(draw.choices(own[language], k=120)), language, "s") for k, language in enumerate(["aa", "bb", "zh"] * 60)]
    model = language_id.train(docs_of(rows), ~language_id.held_out())
    texts = [(n, " ".join(draw.choices(own[language], k=size)), language, "s") for n, (language, size) in enumerate((a, b) for a in own for b in (120, 300_000))]
    found = {r.doc_id: r for r in language_id.predict(docs_of(texts), model, ["doc_id"]).collect()}
    for short, long in ((0, 1), (2, 3), (4, 5)):
        assert found[short].lang_pred == found[long].lang_pred == texts[short][2]
        assert found[long].score >= found[short].score - 0.1


def test_kernels_are_those_of_sets_of_ngrams():
    """Common n-grams over the geometric mean of sizes, counted with plain sets."""
    texts = odd_texts(40, 12) + ["der Hund und die Katze", "the cat and the dog", "x" * 300]

    def grams(text):
        text = "".join(c if c.isalpha() else " " for c in text.lower())
        text = " " + " ".join(text.split()) + " " if text.strip() else ""
        return {text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1)} - {" "}

    texts = [t for t in texts if any(c.isalpha() for c in t)]
    model = language_id.fit(texts, ["a", "b"] * (len(texts) // 2) + ["a"] * (len(texts) % 2), landmarks=9)
    chosen = [texts[k] for turn in range(9) for k in (2 * turn, 2 * turn + 1)][:9]
    ngrams, places, apart = language_id.NGrams(), model.places(), []
    for text in texts:
        slots = ngrams(text)
        assert len(slots) == len(set(slots.tolist())) == len(grams(text))
        kernel = model.kernel(slots, places)
        for value, landmark in zip(kernel, chosen):
            a, b = grams(text), grams(landmark)
            apart.append(abs(value - len(a & b) / (len(a) * len(b)) ** 0.5))
    # Two n-grams share a slot now and then.
    assert max(apart) < 0.05 and np.mean(np.array(apart) > 1e-6) < 0.01
