import random
from itertools import combinations

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import cooccurrence

SCHEMA = "r string, i string, item_a int, n int"


def brute(pairs):
    baskets = {}
    for r, i in pairs:
        if r is not None and i is not None:
            baskets.setdefault(r, set()).add(i)
    n, one, two = len(baskets), {}, {}
    for items in baskets.values():
        for i in items:
            one[i] = one.get(i, 0) + 1
        for p in combinations(sorted(items), 2):
            two[p] = two.get(p, 0) + 1
    return sorted((a, b, k, one[a], one[b], n) for (a, b), k in two.items())


def check(spark, pairs):
    df = spark.createDataFrame([(r, i, 1, 2) for r, i in pairs], SCHEMA)  # further columns with names of the result
    got = cooccurrence.co_occurrence(df, "r", "i").collect()
    assert sorted((x.item_a, x.item_b, x.n_ab, x.n_a, x.n_b, x.n) for x in got) == brute(pairs)
    assert all(abs(x.lift - x.n_ab * x.n / (x.n_a * x.n_b)) < 1e-12 for x in got)


def test_many_items_cross_blocks(spark):
    rng = random.Random(5)
    check(spark, [(f"r{rng.randrange(300)}", f"i{rng.randrange(700)}") for _ in range(3000)])


@pytest.mark.parametrize("head, block, coordinates", [(0, 7, 50), (3, 2, 10), (3, 1000, 10**6), (1000, 5, 10)])
def test_head_and_rare_items_add_up(monkeypatch, head, block, coordinates):
    """The task's own sums, with a small head and few coordinates held at once."""
    for name, value in (("HEAD", head), ("BLOCK", block), ("COORDINATES", coordinates)):
        monkeypatch.setattr(cooccurrence, name, value)
    rng = random.Random(head + block)
    sets = [sorted({f"i{min(rng.randrange(1, 40), rng.randrange(1, 40))}" for _ in range(rng.randrange(1, 9))}) for _ in range(120)] + [[f"i{k}" for k in range(60)]]
    batches = [pa.RecordBatch.from_arrays([pa.array(sets[k : k + 50], pa.list_(pa.string()))], ["items"]) for k in range(0, len(sets), 50)]
    got = {}
    for batch in cooccurrence._gram(iter(batches)):
        for r in batch.to_pylist():
            got[r["a"], r["b"]] = got.get((r["a"], r["b"]), 0) + r["n"]
    want = {(None, None): len(sets)}
    for s in sets:
        for p in [*((x, x) for x in s), *combinations(sorted(s), 2)]:
            want[p] = want.get(p, 0) + 1
    assert got == want


def test_hot_record_and_repeats(spark):
    check(spark, [("r", f"i{k % 40}") for k in range(2000)] + [("s", "i1"), ("s", "i2"), ("s", "i1")])


def test_nulls_blanks_and_empty(spark):
    check(spark, [(None, "a"), ("r", None), ("r", "a"), ("r", ""), ("s", ""), ("s", "a"), ("t", None)])
    check(spark, [])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([None, "r", "s", "t"]), st.sampled_from([None, "", "ä", "a", "Z", "z" * 300])), max_size=30))
def test_any_small_table(spark, pairs):
    check(spark, pairs)


def test_clearly_together_is_exact_at_the_bounds(spark):
    rows = [("a", "b", 3, 10, 10, 100), ("a", "c", 3, 10, 11, 100), ("a", "d", 2, 2, 2, 100), ("a", "e", 3, 3, 3, 3001)]
    df = spark.createDataFrame(rows, "item_a string, item_b string, n_ab bigint, n_a bigint, n_b bigint, n bigint")
    assert [r.item_b for r in cooccurrence.clearly_together(df).collect()] == ["b"]
