import math
import random
from collections import Counter
from pathlib import Path
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile
from tidemark.operators.profile import Expected
from tidemark.plans import quality

SCHEMA = "load int, x double, s string, n bigint, value string"


def test_exact_medians(spark):
    rng = random.Random(3)
    data = {g: [rng.choice([rng.uniform(-5, 5), rng.lognormvariate(0, 4), 0.0, -1e308, 7.0]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 999), ("d", 1000))}
    counted = [(g, x, k) for g, xs in data.items() for x, k in Counter(xs).items()] + [("e", None, 3), ("c", math.nan, 50)]
    df = spark.createDataFrame(counted, "g string, num double, n bigint")
    got = {r.g: r.median for r in profile.exact_medians(df, ["g"]).collect()}
    assert got.keys() == data.keys()
    assert all(math.isclose(got[g], median(xs), rel_tol=1e-12) for g, xs in data.items())


def test_departures(spark):
    rows = [(1, 10.0, "AB", 1, ""), (1, None, "AB", 1, ""), (1, 12.0, "ab", 1, ""), (2, math.nan, "AB", 1, ""), (2, 10.0, None, 1, ""), (3, 100.0, "CD", 1, ""), (3, None, "AB\n", 1, ""), (None, 10.0, "AB", 1, ""), (4, None, None, 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = [Expected("t", "x", missing=0.2, num_min=0.0, num_max=50.0, median=10.0), Expected("t", "s", cardinality=1, pattern="[A-Z]{2}"), Expected("other", "x", missing=0.0), Expected("t", "gone", missing=0.0)]
    got = {(r.load, r.column_name, r.check_name) for r in profile.departures(df, "t", expected, "load").collect()}
    assert got == {
        (1, "x", "missing"), (1, "s", "cardinality"), (1, "s", "pattern"), (2, "x", "numeric_range"), (3, "x", "missing"), (3, "x", "numeric_range"), (3, "x", "median"),
        (3, "s", "cardinality"), (3, "s", "pattern"), (4, "x", "missing"),
    }
    assert profile.departures(df.limit(0), "t", expected, "load").count() == 0
    assert profile.departures(df, "unknown", expected, "load").count() == 0


def test_profile_columns(spark):
    rows = [(1, 1.0, "b", 5, ""), (1, -0.0, "a", 5, ""), (1, 0.0, None, 6, ""), (1, math.nan, "", 7, "")]
    got = {r.column_name: r for r in profile.profile_columns(spark.createDataFrame(rows, SCHEMA), ["x", "s", "n"], "load").collect()}
    assert (got["x"].cardinality, got["x"].num_min, got["x"].num_max, got["x"].median, got["x"].nan) == (3, 0.0, 1.0, 0.0, 1)
    assert (got["s"].n_missing, got["s"].missing, got["s"].cardinality, got["s"].top_value) == (1, 0.25, 3, "")
    assert (got["n"].top_value, got["n"].top_n) == ("5.0", 2)
    assert profile.profile_columns(spark.createDataFrame([], SCHEMA), ["x"], "load").count() == 0


def test_drift_is_zero_for_equal_loads_and_grows(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("load"), F.when(F.col("id") % 3 == 2, 500.0).otherwise((F.col("id") / 3).cast("int") % 100).cast("double").alias("x"), F.lit("same").alias("s"))
    got = {(r.column_name, r.load): r for r in profile.drift(df, ["x", "s"], "load").collect()}
    assert got.keys() == {("x", 1), ("x", 2), ("s", 1), ("s", 2)}
    assert abs(got["x", 1].psi) < 0.02 and got["x", 2].psi > 1 and abs(got["s", 2].psi) < 1e-9
    assert got["x", 2].previous == 1 and got["x", 2].chi_square > got["x", 1].chi_square


def brute_drift(then, now):
    a, b = Counter(now), Counter(then)
    cells = a.keys() | b.keys()
    k, na, nb = len(cells), len(now), len(then)
    share = lambda n, all: (n + 0.5) / (all + 0.5 * k)
    psi = sum((share(a[c], na) - share(b[c], nb)) * math.log(share(a[c], na) / share(b[c], nb)) for c in cells)
    r = math.sqrt(nb / na)
    return psi, sum((r * a[c] - b[c] / r) ** 2 / (a[c] + b[c]) for c in cells), k


def test_drift_tells_every_value_apart(spark):
    """Scores 4 and 5, and the states SP, MT and MA, once shared a bin."""
    rng = random.Random(5)
    loads = {g: [(rng.choice([1, 2, 4, 5, None]), rng.choice(states), rng.choice([4.0, 5.0, math.nan])) for _ in range(n)] for g, n, states in ((3, 60, ["SP", "RJ"]), (7, 80, ["MT", "MA", None]), (9, 70, ["SP", "RJ", "x" * 40]))}
    loads[12] = [(4 if n == 5 else n, "MT" if s == "SP" else s, 4.0 if x == 5.0 else x) for n, s, x in loads[9]]
    df = spark.createDataFrame([(g, *r) for g, rows in loads.items() for r in rows] + [(None, 1, "SP", 1.0)], "load int, n int, s string, x double")
    got = {(r.column_name, r.load): r for r in profile.drift(df, ["n", "s", "x"], "load").collect()}
    pairs = {(3, 7), (7, 9), (9, 12)}
    assert {(c, r.previous, load) for (c, load), r in got.items()} == {(c, *pair) for c in "nsx" for pair in pairs}
    for then, now in pairs:
        for i, c in enumerate("nsx"):
            psi, chi, k = brute_drift(*([("nan" if r[i] != r[i] else r[i]) for r in loads[g]] for g in (then, now)))
            r = got[c, now]
            assert math.isclose(r.psi, psi, rel_tol=1e-9) and math.isclose(r.chi_square, chi, rel_tol=1e-9) and r.bins == k
    assert all(got[c, 12].psi > 0.3 and got[c, 12].chi_square > 5 for c in "nsx")


def test_drift_of_dates_is_that_of_their_distance(spark):
    rows = [(g, f"2024-0{g}-01 03:00:00", None if i % 4 == 0 and g == 3 else f"2024-0{g}-{1 + i % 5 + 9 * (g == 4):02d} 04:00:00") for g in (1, 2, 3, 4) for i in range(40)]
    df = spark.createDataFrame([*rows, (4, None, "2024-04-09 00:00:00")], "load int, at string, d string").withColumns({c: F.col(c).cast("timestamp") for c in ("at", "d")})
    got = {r.load: r for r in profile.drift(df, ["d"], "load", {"d": "at"}).collect()}
    assert (got[2].psi, got[2].chi_square, got[2].bins) == (0, 0, 5)  # the dates are others, the distances are not
    assert got[3].bins == 6 and got[3].chi_square > 5 and got[4].bins == 6 + 5 + 1 and got[4].psi > 1


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_drift_covers_every_column(spark):
    got = {(r.table_name, r.column_name) for r in quality.p3_drift(spark, "/root/testdata/sf0.001").select("table_name", "column_name").distinct().collect()}
    assert got == {(name, c) for name in quality.PROFILED for c in quality.table(spark, "/root/testdata/sf0.001", name).columns if c not in ("ingest_id", "load_id")}


def test_agreed_reads_nulls_and_nans(spark):
    df = spark.createDataFrame([("t", "c", math.nan, None, 1.0, None, None, "x")], "table_name string, column_name string, missing double, cardinality bigint, num_min double, num_max double, median double, pattern string")
    assert profile.agreed(df) == [Expected("t", "c", num_min=1.0, pattern="x")]
