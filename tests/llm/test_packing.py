import random
import time
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import packing


def check_plan(histogram, capacity):
    used = Counter()
    for pattern, n in packing.plan(histogram, capacity):
        assert n >= 1 and sum(x * k for x, k in pattern.items()) <= capacity
        for x, k in pattern.items():
            used[x] += k * n
    assert used == Counter({x: n for x, n in histogram.items() if n})


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 10**9), max_size=12))
def test_plan_places_every_item_once(histogram):
    check_plan(histogram, 40)


def test_exact_complements_of_one_two_and_three():
    for gap, others in ((5, [5]), (9, [4, 5]), (9, [2, 3, 4]), (6, [3, 3]), (9, [3, 3, 3])):
        lengths = packing.Lengths(dict(Counter(others)), 20)
        assert sorted(lengths.exactly(gap)) == sorted(others)
        assert packing.Lengths(dict(Counter(others[:-1])), 20).exactly(gap) == ()


def test_plan_stays_small_and_full():
    rng = random.Random(1)
    histogram = Counter(min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(50_000))
    patterns = packing.plan(histogram, 2048)
    check_plan(histogram, 2048)
    containers, tokens = sum(n for _, n in patterns), sum(x * n for x, n in histogram.items())
    assert containers <= -(-tokens // 2048) + 1 and len(patterns) <= 2 * len(histogram)
    assert len(packing.plan({x: n * 10**6 for x, n in histogram.items()}, 2048)) <= 2 * len(histogram)


@pytest.mark.parametrize("capacity, mean, seconds", [(32_768, 8.5, 4), (131_072, 9.5, 40)])
def test_large_capacities(capacity, mean, seconds):
    rng = random.Random(2)
    histogram = Counter(min(capacity, int(rng.lognormvariate(mean, 1)) + 1) for _ in range(300_000))
    began = time.process_time()
    patterns = packing.plan(histogram, capacity)
    assert time.process_time() - began < seconds
    check = Counter()
    for pattern, n in patterns:
        assert sum(x * k for x, k in pattern.items()) <= capacity
        check.update({x: k * n for x, k in pattern.items()})
    assert check == histogram and sum(n for _, n in patterns) <= -(-sum(x * n for x, n in histogram.items()) // capacity) + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=8), st.integers(1, 30))
def test_index_finds_a_sum_whenever_there_is_one(histogram, gap):
    one = sorted(x for x, n in histogram.items() for _ in range(n))
    there = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(one, k))
    found = packing.Lengths(histogram, 30).exactly(gap)
    assert bool(found) == there and (not found or (sum(found) == gap and not Counter(found) - Counter(histogram)))


def test_lengths_outside_are_an_error():
    with pytest.raises(ValueError):
        packing.plan({41: 1}, 40)


def test_pack(spark):
    sizes = [(k, [None, 0, 1, 7, 10, 11, 25, 30][k % 8], "x") for k in range(400)] + [(1000, 7, "x"), (1000, 7, "x"), (None, 3, "x")]
    df = spark.createDataFrame(sizes, "id bigint, n_tokens bigint, container string")
    got = packing.pack(df, "id", 10).collect()
    want = Counter()
    for key, n, _ in sizes:
        n = n or 0
        for i in range(max(1, -(-n // 10))):
            want[key, i, 10 * i, min(10, n - 10 * i)] += 1
    assert Counter((r.id, r.piece, r.start, r.length) for r in got) == want
    filled = Counter()
    for r in got:
        assert (r.container is None) == (r.length == 0)
        filled[r.container] += r.length
    filled.pop(None)
    assert max(filled.values()) <= 10 and sorted(filled) == list(range(len(filled)))
    assert len(filled) == 350 + 52 + 25  # full pieces, one for each 7 (with a 1 or the 3), and the fives in pairs: none can be saved
    assert {r.container: r.filled for r in packing.fill(packing.pack(df, "id", 10), 10).collect()} and packing.pack(df.limit(0), "id", 10).count() == 0


def test_hot_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 50)
    got = packing.pack(spark.range(1000).withColumn("n_tokens", F.lit(3)), "id", 10)
    per = Counter(r.container for r in got.collect())
    assert len(per) == 334 and set(per.values()) == {3, 1}


def test_token_counts(spark):
    texts = [None, "", "hello world", "a" * 300_000, " " * 1_200_000 + "x", "naïve 漢字 🙂", "<|endoftext|>"]
    got = {r.id: r.n_tokens for r in packing.token_counts(spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "id int, text string, n_tokens int"), "id", "text").collect()}
    assert got[0] == 0 and got[1] == 0 and got[2] == 2 and got[3] > 0 and got[4] > 0 and got[5] > 3 and got[6] > 1


def test_a_long_run_does_not_change_the_rest_of_its_text(spark):
    """Once such a text was cut at all white space, so that each of its words cost a token more."""
    rng = random.Random(4)
    prose = " ".join(rng.choices(["The", "quick", "brown", "fox's", "jumps,", "over", "42", "lazy\n", "dogs."], k=4000))
    blob = "".join(rng.choices("ABCDEFGHIJabcdefghij0123456789+/", k=150_000))
    word, blank = "a" * 250_000, " \n" * 125_000
    texts = [prose, " " + prose, " " + blob, " " + word, blank, f"{prose} {blob} {prose}", f"{prose} {word} {prose}", f"{prose}{blank} {prose}", f"{blob} {blob}{blank} {prose}"]
    got = {r.id: r.n_tokens for r in packing.token_counts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()}
    assert got[5] == got[0] + got[2] + got[1] and got[6] == got[0] + got[3] + got[1]
    assert abs(got[7] - (got[0] + got[4] + got[1])) <= 2 and abs(got[8] - (2 * got[2] + got[4] + got[1])) <= 3
