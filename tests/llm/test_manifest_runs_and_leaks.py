"""Merkle manifests, periodic runs and decontamination against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import decontamination, manifest, periodic
from tidemark.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


def of_sql(sql, **tables):
    with duckdb.connect() as con:
        for name, rows in tables.items():
            con.register(name, rows)
        return sorted(map(repr, con.execute(sql).fetchall()))


def as_tuples(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_manifest", "op13_decontamination"])
def test_equals_sql_on_whole_tables(spark, name):
    tables = {t: duckdb.read_parquet(f"{DATA}/{t}.parquet").to_arrow_table() for t in ("documents", "benchmark")}
    assert as_tuples(QUERIES[name](spark, DATA)) == of_sql(ORACLES[name], **tables)


# Manifests


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(found[-1][k : k + 3]) for k in range(0, len(found[-1]), 3)])
    return found


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 100])
def test_log_is_the_postorder_and_positions_address_it(n):
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
    tree, top = levels([leaf.hex() for leaf in leaves]), manifest.height(n)
    log = manifest.append_log(leaves, top)
    assert len(tree) == top + 1 and log[-1].hex() == tree[-1][0]
    places = [manifest.position(level, k, n, top) for level, nodes in enumerate(tree) for k in range(len(nodes))]
    assert sorted(places) == list(range(len(log)))
    for level, nodes in enumerate(tree):
        for k, node in enumerate(nodes):
            assert log[manifest.position(level, k, n, top)].hex() == node
    for k in range(n):
        path = manifest.siblings(b"".join(log), k, n, top)
        assert manifest.folded(leaves[k].hex(), path) == tree[-1][0]
        assert manifest.folded(h(["x"]), path) != tree[-1][0]


def frame(spark, rows):
    """Documents with columns of clashing names."""
    return spark.createDataFrame(
        [(*r, "x", 1, "y") for r in rows],
        "doc_id long, source string, lang string, n_chars long, text string, key string, n long, root string",
    )


def test_manifest_over_several_rounds_nulls_and_repeats(spark):
    rows = [(k, "hot", "en", 3, f"a\n{k % 900}") for k in range(1, 1100)]
    rows += [(7, None, None, None, None), (7, None, None, None, ""), (None, "hot", "de", 1, "x"), (5, "é", "en", 0, "")]
    rows += [(3, "copies", "en", 1, "same")] * 300 + [(k, "", "en", 1, "b") for k in range(4)]
    random.Random(3).shuffle(rows)
    docs = frame(spark, rows)
    arrow = docs.select(*manifest.COLUMNS).toArrow()
    assert as_tuples(manifest.tampered(docs)) == of_sql(manifest.SQL, documents=arrow)
    found = manifest.Manifest(docs)
    sizes = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + 1
    logs = {}
    for r in found.log().collect():
        logs.setdefault(r.source, {})[r.position] = (r.level, r.node)
    proofs = found.proofs().collect()
    subroots = {r.subroot for r in proofs}
    assert logs.keys() == sizes.keys() and len(proofs) == len(rows)
    for source, log in logs.items():
        top, n = manifest.height(sizes[source]), sizes[source]
        assert sorted(log) == list(range(sum(-(-n // 3**k) for k in range(top + 1))))
        assert log[len(log) - 1][0] == top and log[len(log) - 1][1] in subroots
        nodes = [[log[manifest.position(level, k, n, top)] for k in range(-(-n // 3**level))] for level in range(top + 1)]
        assert [[d for _, d in level] for level in nodes] == levels([d for _, d in nodes[0]])
    for r in proofs:
        assert r.verified and r.folded_root == r.root
        assert manifest.folded(r.leaf, [(s.left, s.right) for s in r.path]) == r.root
        assert h(s.left + s.right for s in r.path) == r.proof_sha256


def test_manifest_of_nothing_and_of_one(spark):
    assert manifest.tampered(frame(spark, [])).collect() == []
    (row,) = manifest.tampered(frame(spark, [(1, None, None, None, None)])).collect()
    leaf = h(["1:1----"])
    assert (row.leaf, row.subroot, row.root, row.folded_root) == (leaf,) * 4
    assert row.verified and row.proof_sha256 == h([])


# Runs


def plain_runs(words, times=4, shortest=6):
    found = set()
    for q in range(1, len(words) // times + 1):
        k = 0
        while k + q < len(words):
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            stretch = words[start : k + q]
            if len(stretch) >= max(shortest, times * q):
                if not any(stretch[d:] == stretch[: len(stretch) - d] for d in range(1, q)):
                    found.add((start, len(stretch), q))
            k += k == start or k + q < len(words)
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(draw, longest):
    """Words with repeated roots, some of them nearly periodic themselves."""
    words, kinds = [], draw.choice([1, 2, 3, 40])
    while len(words) < longest and draw.random() < 0.9:
        root = [draw.randint(1, kinds) for _ in range(draw.randint(1, 20))]
        if draw.random() < 0.4:
            root = (root[:3] * 8)[: draw.randint(1, 14)] + [kinds + 1]
        words += (root * 12)[: draw.randint(1, 5 * len(root) + 8)]
    return words


def test_runs_equal_those_of_all_periods():
    draw = random.Random(12)
    for _ in range(150):
        texts = [some_words(draw, draw.choice([0, 5, 60, 300])) for _ in range(draw.randint(1, 5))]
        assert periodic.runs_of([np.array(t, np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def test_runs_touch_no_neighbouring_text():
    assert periodic.runs_of([np.array([1, 1, 1])] * 9) == [[]] * 9


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_occurrences_are_exact_with_numbers_that_need_several_primes(size):
    draw = np.random.default_rng(size)
    numbers = draw.integers(1, 1 << 24, 12 * size).astype(np.uint64)
    numbers[5 * size : 6 * size] = numbers[3 * size + size // 2 : 4 * size + size // 2]
    padded, starts = np.concatenate([numbers, np.zeros(3 * size, np.uint64)]), np.arange(0, 12 * size, size)
    expected = {
        (k, d) for k, s in enumerate(starts) for d in range(size, 2 * size)
        if np.array_equal(padded[s : s + size], padded[s + d : s + d + size])
    }
    places, shifts = periodic.occurrences(padded, starts, size)
    assert set(zip(places.tolist(), shifts.tolist())) == expected


def plain_run_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and (code := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        a = code // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + code // 10 % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]
    return (
        doc_id,
        len(runs),
        *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        h(f"{s},{n},{q}\n" for s, n, q in runs),
        h([" ".join(kept)]),
    )


def test_digests_equal_brute_force(spark, docs_of):
    draw = random.Random(5)
    texts = [" ".join(f"w{x}" for x in some_words(draw, 200)) for _ in range(120)]
    texts += [None, "", " \n\t", "a", "x y z", "é " * 7, "a\x1ca " * 6, "same " * 5000, *["b c " * 9] * 3]
    rows = [*enumerate(texts), (None, "q " * 8), (None, None)]
    found = periodic.digests(docs_of(rows, extra="runs"))
    assert as_tuples(found) == sorted(repr(plain_run_digest(*r)) for r in rows)
    assert periodic.digests(docs_of([])).collect() == []


def test_digests_of_short_documents_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, DATA).collect()}
    assert rows.keys() == docs.keys()
    short = [k for k, text in docs.items() if len(text or "") < 2500]
    assert len(short) > 500
    for k in short:
        assert rows[k] == plain_run_digest(k, docs[k])
    assert sum(r[1] > 0 for r in rows.values()) > 30


# Leaks


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven"),
    (2, "short item"),
    (10, "TWO three, four five six seven eight nine ten-eleven!"),
    (10, "repeated id é"),
    (3, "..."),
    (4, None),
    (None, "no id here"),
]


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, text string, row long, key string")


@pytest.mark.parametrize("at_once", [1, 2, 1000])
def test_spans_and_items(spark, docs_of, at_once):
    filler = "w " * 30
    docs = [
        "one two three four five six seven eight nine ten eleven",
        f"{filler}É. Short -- ITEM;{filler}",
        "two three four five six seven eight nine ten",
        "shorter item, short items",
        "short item short item",
        "say no id here",
        None,
        "",
        "one two three four five six seven eight nine ten",
    ]
    found = decontamination.contaminated(docs_of(docs, extra="row"), items_of(spark, ITEMS), windows_at_once=at_once)
    rows = {r.doc_id: r for r in found.collect()}
    words = {k: [(s.first, s.end) for s in r.spans] for k, r in rows.items()}
    assert words == {0: [(0, 11)], 1: [(31, 33)], 2: [], 3: [], 4: [(0, 4)], 5: [(1, 4)], 6: [], 7: [], 8: [(0, 10)]}
    assert {k: r["items"] for k, r in rows.items() if r["items"]} == {0: ["1", "10"], 1: ["2"], 4: ["2"], 8: ["1"]}
    span = rows[1].spans[0]
    assert docs[1][span.start : span.stop] == "Short -- ITEM"
    assert [r.n_words for _, r in sorted(rows.items())] == [11, 63, 9, 4, 4, 4, 0, 0, 10]


def test_leaks_equal_sql_with_long_and_repeated_texts(spark, docs_of):
    draw = random.Random(8)
    words = [f"w{k}" for k in range(4)]
    items = [(k % 40, " ".join(draw.choices(words, k=draw.randint(0, 14)))) for k in range(60)]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 400))) for _ in range(80)] + ["A,b;" * 300, None, ""]
    docs, bench = docs_of([*enumerate(texts), (None, texts[0]), (0, texts[1])]), items_of(spark, items + ITEMS)
    found = decontamination.digests(docs, bench)
    tables = {"documents": docs.toArrow(), "benchmark": bench.toArrow()}
    assert as_tuples(found) == of_sql(decontamination.SQL, **tables)


def test_words_across_pieces_of_a_text(monkeypatch):
    text = b" ".join(b"abcdefghij"[k % 10 : k % 10 + 1] for k in range(500))
    windows = [("x", "c d e f g h i j a b"), ("y", "j a"), ("z", "a b c")]
    whole = decontamination.Matcher(windows).find(text)
    monkeypatch.setattr(decontamination, "PIECE", 7)
    count, found = decontamination.Matcher(windows).find(text)
    assert count == 500 and (count, sorted(found)) == (whole[0], sorted(whole[1])) and len(found) > 100


def test_no_items_and_no_documents(spark, docs_of):
    none = items_of(spark, [])
    (row,) = decontamination.digests(docs_of(["a b"]), none).collect()
    assert tuple(row) == (0, 2, 0, 0, h([]), False)
    assert decontamination.digests(docs_of([]), items_of(spark, ITEMS)).collect() == []
