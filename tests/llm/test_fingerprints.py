"""I-Match, SimHash and components against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import fingerprints, simhash
from tidemark.llm.components import components
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc_id to smallest doc_id reachable, from a dict of doc_id to fingerprint."""
    classes = defaultdict(list)
    for doc_id, fp in prints.items():
        classes[fp].append(doc_id)
    keys, root = list(classes), {}
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    for k in keys:
        root[find(k)] = min(root.get(find(k), 1 << 62), *classes[k], 1 << 62)
    return {d: root[find(fp)] for d, fp in prints.items()}


def test_simhash_of_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    prints = {d.doc_id: plain_simhash(d.text or "") for d in docs}
    expected = plain_components(prints)
    rows = QUERIES["op7_simhash"](spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == expected[r.doc_id]


def test_simhash_edge_cases(spark, docs_of):
    texts = [None, "", " \t", "One", "one", "one two", "É", "é", "a b c\x1cd e", "w " * 70000]
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs_of(texts)).collect()}
    for k, text in enumerate(texts):
        assert int(rows[k].fingerprint, 16) == plain_simhash(text or "")
    assert rows[0].component_id == rows[1].component_id == rows[2].component_id == 0
    assert rows[3].component_id == rows[4].component_id == 3
    assert rows[6].fingerprint != rows[7].fingerprint
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_links_connect_what_all_pairs_connect(spark):
    draw = random.Random(4)
    prints = [draw.getrandbits(64) for _ in range(60)]
    for _ in range(400):  # chains of changes of one to three bits
        prints.append(draw.choice(prints) ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 3))))
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    pairs = simhash.links(frame)
    assert all((a ^ b).bit_count() <= 2 for a, b in ((u & (1 << 64) - 1, v & (1 << 64) - 1) for u, v in map(tuple, pairs.collect())))
    roots = {r.node: r.root for r in components(pairs).collect()}
    expected = plain_components(dict(enumerate(prints)))
    for i in range(len(prints)):
        for j in range(i):
            same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
            assert same == (expected[i] == expected[j])
    with pytest.raises(ValueError):
        simhash.links(frame, 3)


def test_components_of_random_graphs(spark):
    draw = random.Random(8)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = list(range(500))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert {k: find(k) for k in range(500) if find(k) != k} == roots
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_document_of_each_group_stays(spark, docs_of):
    long = " ".join(f"word{k}" for k in range(500))
    rows = [(7, long), (3, long), (9, long.upper()), (4, "something else here"), (4, "something else here")]
    rows += [(None, long), (None, "no id at all"), (None, "no id at all"), (11, None), (12, "")]
    kept = simhash.without_near_duplicates(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 11), (True, 0)]


def test_match_next_columns(spark):
    docs = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda d: -d.doc_id)
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    for rows_per_range in (4096, 37):  # one range, and many
        rows = {r.doc_id: r for r in fingerprints.match_next(frame, rows_per_range=rows_per_range).collect()}
        assert len(rows) == len(docs)
        for k, d in enumerate(docs):
            following = docs[(k + 1) % len(docs)].text
            half = len(d.text) // 2
            changed = d.text[: len(d.text) - half] + following[:half]
            r = rows[d.doc_id]
            assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            assert (r.near_next == 1) if following == d.text else True
    by_text = defaultdict(set)
    for d in docs:
        by_text[d.text].add(rows[d.doc_id].fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    # Of those not above, nearly all have lost every term with their second half.
    assert sum(r.near_edited > r.near_next for r in rows.values()) >= 0.98 * len(docs)
    alike = [rows[d.doc_id] for d in docs if len(d.text) > 200]
    assert sum(r.near_edited > r.near_next for r in alike) >= 0.985 * len(alike)


def plain_fingerprint(text, in_band):
    """Subset by subset, term by term."""
    terms = sorted(set(re.findall(r"\w+", text.lower())))
    terms = [t for t in terms if in_band(t)] or terms
    if not terms:
        return [zlib.crc32(text.encode()) & 0xFFFF or 1] * len(fingerprints._POWERS)
    mask, found = (1 << 64) - 1, []
    for k, power in enumerate(fingerprints._POWERS.tolist()):
        chosen = b""
        for t in terms:
            h = (zlib.crc32(t.encode()) + 1) * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
            drawn = h * int(fingerprints._SALTS[k // 4]) & mask
            drawn = (drawn ^ drawn >> 32) * 0xD6E8FEB86659FD93 & mask
            drawn ^= drawn >> 32
            if (drawn >> 16 * (k % 4) & 0xFFFF) < 1 << (16 - power):
                chosen += h.to_bytes(8, "little")
        found.append((zlib.crc32(chosen) & 0xFFFF or 1) if chosen else 0)
    return found


def test_fingerprints_of_whole_table_against_the_rule(spark, monkeypatch):
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = frame.collect()
    counts = defaultdict(int)  # documents by slot of a term
    slots_of = lambda t: int(fingerprints.slots(fingerprints.term_hashes([t]))[0])
    cache = {}
    for d in docs:
        held = set(re.findall(r"\w+", (d.text or "").lower()))
        cache |= {t: slots_of(t) for t in held if t not in cache}
        for slot in {cache[t] for t in held}:
            counts[slot] += 1
    kept = np.unpackbits(fingerprints.lexicon(frame, 3.0, 20.0)).view(bool)
    for slot, count in counts.items():
        assert kept[slot] == (len(docs) >= 8 * count) or len(docs) == 8 * count  # a tie hangs on the last bit of a logarithm
    in_band = lambda t: kept[cache[t]]
    rows = {r.doc_id: r.fingerprint for r in fingerprints.match_next(frame).collect()}
    for d in [d for d in docs if len(d.text) < 3000][::9]:
        assert rows[d.doc_id] == "".join(f"{h:04x}" for h in plain_fingerprint(d.text, in_band))
    text = " ".join(f"w{k}" for k in range(300))
    kept = np.ones(1 << fingerprints.SLOT_BITS, bool)
    whole = fingerprints.fingerprint(text, kept)
    monkeypatch.setattr(fingerprints, "TERMS_AT_ONCE", 7)
    assert (fingerprints.fingerprint(text, kept) == whole).all() and whole.tolist() == plain_fingerprint(text, lambda t: True)


def test_likeness_follows_the_share_of_common_terms():
    draw, kept = random.Random(6), np.ones(1 << fingerprints.SLOT_BITS, bool)
    for size in (16, 100, 2000):
        shares, found = [], []
        for _ in range(60):
            common = draw.randint(0, size)
            words = [f"t{draw.randrange(10**9)}" for _ in range(2 * size - common)]
            one, other = (fingerprints.fingerprint(" ".join(w), kept) for w in (words[:size], words[size - common :]))
            shares.append(common / len(words))
            found.append(fingerprints.likeness(one, other))
            assert common < size or found[-1] == 1
        assert np.corrcoef(shares, found)[0, 1] > 0.9


def test_match_next_edge_cases(spark, docs_of):
    rows = [(5, None), (4, ""), (3, "ab"), (None, "xyz"), (2, "long " * 50000), (2, "again"), (1 << 60, "top"), ((1 << 60) + 1, "tops")]
    found = fingerprints.match_next(docs_of(rows), rows_per_range=2).collect()
    order = [(1 << 60) + 1, 1 << 60, 5, 4, 3, 2, 2, None]
    texts = ["tops", "top", "", "", "ab", "again", "long " * 50000, "xyz"]
    expected = set()
    for k, (doc_id, text) in enumerate(zip(order, texts)):
        changed = fingerprints.edited(text, texts[(k + 1) % len(texts)])
        expected.add((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in found} == expected and len(found) == 8
    assert fingerprints.match_next(docs_of([])).count() == 0
    single = fingerprints.match_next(docs_of(["only one text"])).first()
    assert single.near_next == 1


def test_lexicon_is_the_band_of_document_frequency(spark, docs_of):
    kept = np.unpackbits(fingerprints.lexicon(docs_of(["a b c", "a b", "a", "a"]), 0.5, 1.5)).view(bool)
    slots = fingerprints.slots(fingerprints.term_hashes(["a", "b", "c"]))
    assert kept[slots].tolist() == [False, True, False] and kept.sum() == 1
