"""Near copies against brute force over five-word shingles."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import near_copies
from tidemark.llm.common import bitmap, in_bitmap
from tests.llm.test_fingerprints import plain_components, plain_simhash

DATA = "/root/testdata/sf0.01"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def roots_of_near_copies(texts):
    """doc_id to the smallest id of its group, all pairs compared."""
    root, sets = {d: d for d in texts}, {d: shingle_set(t) for d, t in texts.items()}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(texts), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small >= 0.8 * large:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (small + large - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in texts}


def first_of_near_copies(texts):
    return set(roots_of_near_copies(texts).values())


def changed(words, edits, draw):
    words = list(words)
    for k in draw.sample(range(len(words)), edits):
        words[k] = f"edit{draw.randrange(10**6)}"
    return words


def test_groups_of_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows, groups = near_copies.near_copies(docs)
    named = rows.join(groups, rows["_near_class"] == groups["class"]).select("doc_id", "root").collect()
    expected = roots_of_near_copies({d.doc_id: d.text for d in docs.collect()})
    assert len(named) == len(expected)
    by_root = {}
    for r in named:
        by_root.setdefault(r.root, set()).add(expected[r.doc_id])
    assert all(len(found) == 1 for found in by_root.values())
    assert len(by_root) == len(set(expected.values()))


def test_a_text_with_very_many_copies(spark, docs_of):
    draw = random.Random(3)
    base = [f"w{draw.randrange(4000)}" for _ in range(400)]
    # Copies are like the base by about 0.82, not like each other; in no order that tells which the base is.
    texts = [changed(base, 8, draw) for _ in range(600)] + [base] + [[f"v{draw.randrange(4000)}" for _ in range(400)] for _ in range(50)]
    texts = [" ".join(t) for t in texts]
    draw.shuffle(texts)
    sets = [shingle_set(t) for t in texts]
    alike = [len(a & sets[texts.index(" ".join(base))]) > 100 for a in sets]
    kept = {r.doc_id for r in near_copies.without_near_copies(docs_of(texts)).collect()}
    others = {k for k, near in enumerate(alike) if not near}
    assert others <= kept and len(others) == 50
    # Candidates are found by chance of the edits' bits: nearly all.
    assert len(kept - others) <= 1 + 0.05 * 600


def test_similarity_decides(spark, docs_of):
    base = [f"w{k}" for k in range(204)]  # 200 shingles; an edit inside changes five
    near, far = list(base), list(base)
    for k in (20, 60, 100, 140):
        near[k] = f"near{k}"
    for k in (15, 50, 85, 120, 155):
        far[k] = f"far{k}"
    texts = [" ".join(base), " ".join(near).upper(), " ".join(far), "\t".join(base)]
    assert {r.doc_id for r in near_copies.without_near_copies(docs_of(texts)).collect()} == first_of_near_copies(dict(enumerate(texts))) == {0, 2}


def test_edge_cases(spark, docs_of):
    long = " ".join(f"word{k}" for k in range(500))
    rows = [(7, long), (3, long), (9, long.upper()), (4, "something else here"), (4, "something else here"), (4, "another text")]
    rows += [(None, long), (None, "no id at all"), (None, "no id at all"), (11, None), (12, ""), (13, " \n"), (14, "x " * 200000)]
    for name in ("class", "first"):
        docs = docs_of(rows, name)
        kept = near_copies.without_near_copies(docs)
        assert kept.columns == docs.columns
        found = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect())
        assert found == [
            (False, 3, "word0 wor"),
            (False, 4, "another t"),
            (False, 4, "something"),
            (False, 11, ""),
            (False, 14, "x x x x x"),
            (True, 0, "no id at "),
        ]
        assert near_copies.without_near_copies(docs_of([], name)).count() == 0


def test_bitmap(spark):
    draw = np.random.default_rng(4)
    hashes = draw.integers(-(1 << 63), (1 << 63) - 1, 3000)
    packed = bitmap(spark.createDataFrame([(int(h),) for h in hashes[:1000]], "h long"), 16)
    assert len(packed) == 1 << 13
    held = {h >> 48 for h in hashes[:1000].view(np.uint64).tolist()}
    assert in_bitmap(packed, hashes).tolist() == [h >> 48 in held for h in hashes.view(np.uint64).tolist()]
    assert not bitmap(spark.createDataFrame([], "h long"), 16).any()


def test_names_that_are_taken(docs_of):
    with pytest.raises(ValueError, match="_near_"):
        near_copies.without_near_copies(docs_of(["a"], "_near_key"))


def groups_of(docs):
    rows, groups = near_copies.near_copies(docs)
    found = {}
    for r in rows.join(groups, rows["_near_class"] == groups["class"]).select("doc_id", "root").collect():
        found.setdefault(r.root, set()).add(r.doc_id)
    return sorted(map(sorted, found.values()))


def brute_groups(texts):
    found = {}
    for d, root in roots_of_near_copies(dict(enumerate(texts))).items():
        found.setdefault(root, set()).add(d)
    return sorted(map(sorted, found.values()))


def test_chains_of_versions(spark, docs_of):
    draw = random.Random(11)
    texts = []
    for _ in range(6):  # dense groups near each other: versions of versions
        family = [[f"w{draw.randrange(4000)}" for _ in range(200)]]
        for _ in range(90):
            family.append(changed(family[draw.randrange(max(0, len(family) - 12), len(family))], draw.randint(2, 6), draw))
        texts += [" ".join(t) for t in family]
    draw.shuffle(texts)
    assert groups_of(docs_of(texts)) == brute_groups(texts)


def test_pairs_among_texts_of_the_same_words(spark, docs_of):
    draw = random.Random(12)
    common = [f"p{k}" for k in range(200)]
    texts = []
    for _ in range(250):  # all have nearly the same words, each in an order of its own: no near copies but of each one's own
        own = draw.sample(common, 200)
        texts += [own, changed(own, 3, draw)]
    texts = [" ".join(t) for t in texts]
    draw.shuffle(texts)
    groups = groups_of(docs_of(texts))
    assert groups == brute_groups(texts) and len(groups) == 250


def test_appended_and_replaced_blocks(spark, docs_of):
    draw = random.Random(13)
    texts = []
    for k in range(120):
        base = [f"w{draw.randrange(10**6)}" for _ in range(404)]
        more = [f"w{draw.randrange(10**6)}" for _ in range(draw.randint(71, 100))]  # 400 of 471 to 500 shingles
        block = draw.randint(30, 40)  # 366 to 356 of 434 to 444
        at = draw.randrange(10, 300)
        texts += [base, base + more if k % 2 else base[:at] + more[:block] + base[at + block :]]
    texts = [" ".join(t) for t in texts]
    sets = list(map(shingle_set, texts))
    assert all(0.8 <= len(a & b) / len(a | b) <= 0.851 for a, b in zip(sets[::2], sets[1::2]))
    assert groups_of(docs_of(texts)) == [[2 * k, 2 * k + 1] for k in range(120)]


def test_simhash_groups_without_lookups(spark, docs_of, monkeypatch):
    draw = random.Random(14)
    texts = []
    for k in range(40):  # one edit of 600 words: about 2 bits of 64
        base = [f"w{draw.randrange(10**6)}" for _ in range(600)]
        texts += [base, changed(base, 1, draw), changed(base, 1, draw)]
    # Equal fingerprints without likeness: a line repeated decides all bits, the rest of the texts differs.
    line = [f"l{k}" for k in range(9)]
    for k in range(3):
        texts.append(line * 40 + [f"r{k}x{j}" for j in range(12)])
    texts = [" ".join(t) for t in texts]
    prints = {k: plain_simhash(t) for k, t in enumerate(texts)}
    near = plain_components(prints)
    assert near[120] == near[121] == near[122]
    near |= {k: k for k in (120, 121, 122)}  # verified, and not alike
    expected = {}
    for k, root in near.items():
        expected.setdefault(root, set()).add(k)
    assert 20 < sum(len(g) > 1 for g in expected.values()) and len(expected) > 60
    assert groups_of(docs_of(texts)) == brute_groups(texts)
    lookups = near_copies._buckets
    monkeypatch.setattr(near_copies, "_buckets", lambda *given: lookups(*given).where("false"))
    assert groups_of(docs_of(texts)) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("slots", [True, False])
def test_shared_passages_make_few_pairs(spark, docs_of, monkeypatch, slots):
    draw = random.Random(15)
    passages = [[f"p{draw.randrange(10**6)}" for _ in range(12)] for _ in range(40)]
    texts = []
    for k in range(800):  # a passage is in 20 texts, which aren't near copies
        own = [f"w{draw.randrange(10**6)}" for _ in range(96)]
        texts.append(" ".join(own[:50] + passages[k % 40] + own[50:]))
    lookups, seen = near_copies._buckets, []

    def buckets(*given):
        seen.append(lookups(*given))
        return seen[-1]

    monkeypatch.setattr(near_copies, "_buckets", buckets)
    if not slots:  # as where few texts of very many share a passage, which rough counts don't tell
        monkeypatch.setattr(near_copies, "_levels", lambda *given: np.zeros(1 << near_copies.SLOT_BITS, np.uint8))
    assert len(groups_of(docs_of(texts))) == 800
    sizes = [r["count"] for r in seen[0].groupBy("shingle").count().collect()]
    assert sum(k * (k - 1) // 2 for k in sizes) < 4 * 800
