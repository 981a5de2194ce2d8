import random

import numpy as np
import pytest

from tidemark.llm import leakage


def shared(a, b, k):
    a, b = leakage.words(a), leakage.words(b)
    runs = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    return any(tuple(a[i : i + k]) in runs for i in range(len(a) - k + 1))


def test_words():
    assert leakage.words("Ça_va? É-té 12x́, STRASSE straße") == ["ca", "va", "e", "te", "12x", "strasse", "strasse"]
    assert leakage.words(None) == leakage.words("") == []


def brute_tiles(p, t, k):
    """Greedy string tiling as first published: scan for the longest unmarked match, mark it, again."""
    mp, mt, tiles = [False] * len(p), [False] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                best = min(best, (-n, i, j))
        n, i, j = -best[0], best[1], best[2]
        if n < k:
            return sorted(tiles)
        tiles.append((i, j, n))
        mp[i : i + n], mt[j : j + n] = [True] * n, [True] * n


def test_tiling_against_the_plain_algorithm():
    rng = random.Random(2)
    for _ in range(200):
        p, t = [rng.randrange(3) for _ in range(rng.randrange(3, 25))], [rng.randrange(3) for _ in range(rng.randrange(3, 30))]
        seeds = [(i, j) for i in range(len(p) - 2) for j in range(len(t) - 2) if p[i : i + 3] == t[j : j + 3]]
        if seeds:
            a, b = map(np.array, zip(*seeds))
            got = leakage.tile(np.array(p), np.array(t), a, b, 3)
            assert max(n for _, _, n in got) == max(n for _, _, n in brute_tiles(p, t, 3))
            for i, j, n in got:
                assert p[i : i + n] == t[j : j + n]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(40)] + [(100, None), (101, ""), (102, "x " * 9), (103, "y " * 10), (104, "y " * 10)]
    docs = []
    for d in range(150):
        text = [rng.choice(vocabulary) for _ in range(50)]
        if d % 3 == 0:
            source = leakage.words(items[rng.randrange(40)][1])
            n = rng.choice([9, 10, 11, len(source)])
            start = rng.randrange(max(1, len(source) - n + 1))
            text[20:20] = source[start : start + n]
        docs.append((d, ", ".join(w.upper() if d % 2 else w for w in text), "s"))
    docs += [(900, None, "s"), (901, "", "s"), (902, "Y-y y Y ý y. y y\ny y y", "s"), (902, "Y-y y Y ý y. y y\ny y y", "s"), (903, "y " * 30_000, "s"), (904, "y " * 9, "s")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id int, text string"), docs, items


def test_pairs_against_brute_force(tables):
    documents, benchmark, docs, items = tables
    want = {(i, d) for i, a in items for d, b, _ in docs if a and b and shared(a, b, 10)}
    figures = []
    for chars in (10**9, 400):  # sent to the documents, and met by hashes
        got = leakage.leaks(documents.drop("item_id"), benchmark, block_chars=chars).collect()
        assert {(r.item_id, r.doc_id) for r in got} == want and len(got) == len(want)
        figures.append(sorted(map(tuple, got)))
    assert figures[0] == figures[1]
    assert {(103, 902), (104, 903)} <= want
    assert all(r.longest >= 10 and r.covered <= r.coverage * 1e9 and 0 < r.coverage <= 1 for r in got)


def test_reordered_passages_are_covered(spark):
    first, second = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(15))
    items = spark.createDataFrame([("i", f"{first} {second}")], "item_id string, text string")
    documents = spark.createDataFrame([(1, f"x {second} y {first} z {second}")], "doc_id bigint, text string")
    r = leakage.leaks(documents, items).first()
    assert (r.n_tiles, r.longest, r.covered, r.coverage) == (2, 15, 27, 1.0)
    part = spark.createDataFrame([(1, f"x {second} y {first} z"), (2, f"{first} z"), (3, None)], "doc_id bigint, text string")
    found = leakage.leaks(part, items)
    assert {r.doc_id for r in leakage.covered(found, 0.5).collect()} == {1} and {r.doc_id for r in leakage.covered(found, 0.4).collect()} == {1, 2}


def test_filter_lets_every_run_of_an_item_pass(spark):
    seeds = spark.createDataFrame([(1, h) for h in (0, 5, -1, -(2**63), 2**63 - 1, 123456789012345)], "i int, h bigint")
    bits = leakage._filter(seeds, 1 << 16)
    place = [h % 2**64 % (1 << 16) for h in (0, 5, -1, -(2**63), 2**63 - 1, 123456789012345)]
    assert sorted({p for p in place}) == np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()


def test_empty_tables(tables):
    documents, benchmark, _, _ = tables
    documents = documents.drop("item_id")
    assert leakage.leaks(documents.limit(0), benchmark).count() == 0 and leakage.leaks(documents, benchmark.limit(0)).count() == 0
    assert leakage.leaks(documents.limit(0), benchmark, block_chars=0).count() == 0
