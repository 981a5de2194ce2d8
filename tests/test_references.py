from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import references

REF = references.Reference("child.key", "id", "key")
DAY = datetime(2022, 1, 1)
CHILD, PARENT = "id bigint, key string, loaded_at timestamp_ntz, kind string", "key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, closed int"


def at(n):
    return None if n is None else DAY + timedelta(days=n)


def brute(children, parents):
    found = []
    for i, key, t in children:
        if key is None or not key.strip():
            continue
        own = [(f, u) for k, f, u in parents if k == key]
        if t is not None and any(f is not None and f <= t and (u is None or u > t) for f, u in own):
            continue
        times = [f for f, _ in own if f is not None]
        kind = "missing" if not own else "late" if t is None or (times and min(times) > t) else "deleted"
        found.append((i, kind))
    return sorted(found)


def frames(spark, children, parents):
    c = spark.createDataFrame([(i, k, at(t), "x") for i, k, t in children], CHILD)
    return c, spark.createDataFrame([(k, at(f), at(u), 0) for k, f, u in parents], PARENT)


CASES = {
    "kinds": ([(1, "a", 5), (2, "a", 1), (3, "b", 5), (4, "c", 9), (5, "c", 4)], [("a", 3, None), ("c", 2, 6)]),
    "edges": ([(1, "a", 3), (2, "a", 6), (3, "a", 2)], [("a", 3, 6)]),
    "recreated": ([(k, "a", k) for k in range(12)], [("a", 2, 4), ("a", 6, 8), ("a", 10, None), ("a", 7, 8)]),
    "backwards": ([(1, "a", 5)], [("a", 6, 4), ("a", 3, 3)]),
    "nulls": ([(1, None, 1), (2, " \t", 1), (3, "a", None), (4, "z", None), (5, "a ", 3), (6, "n", 3)], [(None, 1, None), ("a", 1, None), ("n", None, None)]),
    "repeats": ([(1, "a", 5), (1, "a", 5)], [("b", 1, None), ("b", 1, None)]),
    "empty": ([], []),
    "no parents": ([(1, "a", 1)], []),
}


@pytest.mark.parametrize("name", CASES)
def test_against_definition(spark, name):
    children, parents = CASES[name]
    got = references.orphans(REF, *frames(spark, children, parents)).collect()
    assert sorted((r.ref_id, r.kind) for r in got) == brute(children, parents)


def hot():
    children = [(k, "hot" if k % 2 else f"k{k % 40}", k % 30) for k in range(600)]
    return children, [("hot", 10, 20), ("hot", 25, None), *((f"k{k}", k % 20, None if k % 3 else 25) for k in range(0, 40, 2))]


def test_heavy_keys_are_spread_and_agree(spark):
    children, parents = hot()
    got = references.orphans(REF, *frames(spark, children, parents)).collect()
    assert "hot" in references.heavy_keys(frames(spark, children, parents)[0], "key")
    assert sorted((r.ref_id, r.kind) for r in got) == brute(children, parents)


def brute_open(children, parents, end):
    return sum(1 for _, k, t in children if t < end and not any(p == k and f < end and (u is None or u >= end) for p, f, u in parents))


def test_snapshots_against_definition(spark):
    children = [(k, "hot" if k % 3 else f"k{k % 9}", (7 * k) % 200) for k in range(300)]
    parents = [("hot", 10, 50), ("hot", 100, 170), ("hot", 180, None), ("k1", 5, None), ("k2", 64, 65), ("k2", 90, 250), ("k3", 400, None), ("k4", 30, 20), ("k4", 60, 60)]
    ends = {"2022-01": 31, "2022-02": 59, "2022-03": 90, "2022-04": 120, "2022-05": 151, "2022-06": 181, "2022-07": 212}
    got = {r.period: r.n_open for r in references.snapshots(REF, *frames(spark, children, parents)).collect()}
    assert got == {m: n for m, end in ends.items() if (n := brute_open(children, parents, end))}


def test_deliveries_agree_with_one_pass_and_only_append(spark):
    children, parents = hot()
    state, sizes = references.OrphanState(), []
    for low in range(0, 30, 6):
        new = [x for x in children if low <= x[2] < low + 6]
        rows = [x for x in parents if low <= x[1] < low + 6]
        again = [x for x in parents if x[1] < low and x[2] is not None and low <= x[2] < low + 6]
        begun = [(k, f, u if u is not None and u < low + 6 else None) for k, f, u in rows]
        state = state.advance(REF, *frames(spark, new, begun + again), at(low + 6) - timedelta(microseconds=1))
        sizes.append(state.keys.where(F.col("version") == state.version).count())
    assert sorted((r.ref_id, r.kind) for r in state.orphans.collect()) == brute(children, parents)
    assert state.open_at(at(29)).first().n_open == references.OrphanState().advance(REF, *frames(spark, children, parents)).open_at(at(29)).first().n_open
    one = state.step(REF, *frames(spark, [(9999, "k1", 30)], []))
    assert one["keys"].count() == 1 and one["found"].count() <= 1 and one["resolved"].count() == one["open"].count() == 0 and one["changes"].count() == 1


def test_deliveries_one_by_one_reach_the_same_state(spark):
    children = [(k, f"k{k % 7}", k % 10) for k in range(60)]
    parents = [(f"k{k}", (3 * k) % 10, None if k % 2 else 8) for k in range(6)]
    state = references.OrphanState()
    for day in range(10):
        c, p = frames(spark, [x for x in children if x[2] == day], [x for x in parents if x[1] == day])
        state = state.advance(REF, c, p, at(day))
    assert sorted((r.ref_id, r.kind) for r in state.orphans.collect()) == brute(children, parents)


def test_snapshots_resolve_and_reopen(spark):
    # a arrives in February and goes in March: its January reference is open, then resolved, then open again
    children, parents = [(1, "a", 5), (2, "a", 6), (3, "b", 70)], [("a", 40, 65)]
    got = references.snapshots(REF, *frames(spark, children, parents))
    assert sorted((r.period, r.n_open) for r in got.collect()) == [("2022-01", 2), ("2022-03", 3)]
    assert references.snapshots(REF, *frames(spark, [], parents)).count() == 0


def test_report_per_month(spark):
    found = references.orphans(REF, *frames(spark, CASES["kinds"][0], CASES["kinds"][1]))
    assert sorted((r.period, r.kind, r.n_refs) for r in references.per_period(found).collect()) == [("2022-01", "deleted", 1), ("2022-01", "late", 1), ("2022-01", "missing", 1)]
    assert references.per_period(found).select(F.sum("n_refs")).first()[0] == 3


def test_deletion_reopens(spark):
    state = references.OrphanState().advance(REF, *frames(spark, [(1, "a", 2), (2, "b", 2), (3, "b", 3)], [("a", 1, None)]))
    assert [r.n_open for r in state.open_at(at(3)).collect()] == [2]
    state = state.advance(REF, *frames(spark, [(4, "a", 6)], [("b", 4, None)]))
    assert state.open_at(at(6)).collect() == [] and {(r.ref_id, r.kind) for r in state.orphans.collect()} == {(2, "late"), (3, "late")}
    state = state.advance(REF, *frames(spark, [(5, "a", 9)], [("a", 1, 8)]))
    assert [r.n_open for r in state.open_at(at(9)).collect()] == [3] and (5, "deleted") in {(r.ref_id, r.kind) for r in state.orphans.collect()}
