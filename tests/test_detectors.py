import math
import random
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels, pvalues
from tidemark.operators import causal, discovery, graph, periods, segments, significance
from tidemark.plans import evidence
from tidemark.sources import tables

FACT = "order_id string, quarter string, month string, day date, customer_state string, customer_city string, product_category_name_english string, seller_state string, price double, freight_value double, review_score double, revenue double"


@pytest.fixture(scope="module")
def fact(spark):
    """Four quarters of 90 rows, prices 40, 80, 55 and 60, one order per row and day."""
    rng, rows = random.Random(1), []
    for q, price in enumerate((40, 80, 55, 60)):
        for k in range(90):
            day = pd.Timestamp(2024, 3 * q + 1, 1) + pd.Timedelta(days=k)
            p, f = price + rng.gauss(0, 3), 8 + rng.gauss(0, 2)
            rows.append((f"o{q}_{k}", f"2024Q{q + 1}", day.strftime("%Y-%m"), day.date(), rng.choice(["SP", "RJ", "MG"]), "x", rng.choice(["books", "electronics"]), "SP", p, f, None, p + f))
    return spark.createDataFrame(rows, FACT).persist()


def test_series(fact):
    got = periods.series(fact).orderBy("period").collect()
    assert [r.period for r in got] == ["2024Q1", "2024Q2", "2024Q3", "2024Q4"] and all(r.items == 90 and r.orders == 90 and r.items_per_order == 1 for r in got)
    assert periods.monthly_filled(fact).count() == 12
    assert periods.series(fact.limit(0)).count() == 0 and periods.monthly_filled(fact.limit(0)).count() == 0


def test_gaps_are_filled(spark, fact):
    gap = fact.where("month IN ('2024-01', '2024-04')")
    got = {r.period: (r.revenue, r.orders) for r in periods.monthly_filled(gap).collect()}
    assert list(sorted(got)) == ["2024-01", "2024-02", "2024-03", "2024-04"] and got["2024-02"] == (0.0, 0)


def test_changes(spark, fact):
    got = {(r.metric, r.period): r for r in periods.changes(fact).collect()}
    assert got["revenue", "2024Q2"].delta_pct > 0.5 and not [k for k in got if k[0] == "orders"]
    assert periods.changes(fact, min_rows=91).count() == 0 and periods.changes(fact.where("quarter <> '2024Q2'")).where("period = '2024Q3'").first().prev_period == "2024Q1"
    no_time = fact.withColumn("quarter", F.lit(None).cast("string"))
    assert periods.changes(no_time).count() == 0


def test_rolling_z_like_a_centred_window(spark):
    rng = random.Random(2)
    values = [rng.gauss(100, 10) if k != 17 else 900.0 for k in range(30)]
    values[5] = None
    df = spark.createDataFrame([(f"{k:03d}", v) for k, v in enumerate(values)], "period string, revenue double")
    s = pd.Series(values, dtype=float)
    med = s.rolling(6, center=True, min_periods=3).median()
    mad = (s - med).abs().rolling(6, center=True, min_periods=3).median()
    want = (s - med) / mad.replace(0, np.nan)
    got = [r.z_score for r in periods.rolling_z(df).orderBy("period").collect()]
    assert all((a is None and math.isnan(b)) or abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_drill_down(spark, fact):
    steps = segments.drill_down(fact, "2024Q2", "2024Q1").collect()
    assert [s.dimension for s in steps] == ["customer_state", "customer_city", "product_category_name_english"]
    assert all(0 < s.contribution_pct <= 1.1 for s in steps) and steps[0].n >= steps[2].n > 0
    assert segments.drill_down(fact, "2024Q2", "1999Q1").count() == 0 and segments.drill_down(fact.limit(0), "a", "b").count() == 0


def test_drill_down_tie_takes_the_first(spark):
    rows = [(f"{q}{s}", q, "m", None, s, "c", "k", "x", 1.0, 0.0, None, v) for q, v in (("2024Q1", 1.0), ("2024Q2", 3.0)) for s in ("b", "a", None)]
    df = spark.createDataFrame(rows, FACT)
    assert segments.drill_down(df, "2024Q2", "2024Q1", max_depth=1).first().entity == "a"


def jobs(spark, group, work):
    """What work() gives, and how many jobs it ran."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_many_changes_are_drilled_and_tested_at_once(spark, fact):
    pairs = [("2024Q2", "2024Q1"), ("2024Q3", "2024Q2"), ("2024Q4", "2024Q3")]
    asked = [(*pair, metric) for metric in ("revenue", "orders") for pair in pairs]
    found, several = jobs(spark, "several", lambda: segments.drill_downs(fact, [*asked, ("2024Q2", "1999Q1", "revenue")]))
    alone, one = jobs(spark, "one", lambda: segments.drill_downs(fact, asked[:1]))
    assert several <= one + 2 and found[0] == alone[0] and found[-1] == [] and segments.drill_downs(fact, []) == []
    assert found[:-1] == [[tuple(r) for r in segments.drill_down(fact, *x).collect()] for x in asked]
    tests = segments.daily_tests_of(fact, pairs).collect()
    for i, pair in enumerate(pairs):
        own, alone = ({r.name: r for r in rows} for rows in ([r for r in tests if r.pair == i], segments.daily_tests(fact, *pair).collect()))
        assert len(own) == 5 and own.keys() == alone.keys() and all(x == (y if y is None else pytest.approx(y, rel=1e-9)) for k in own for x, y in zip(own[k][2:5], alone[k][1:4]))


def test_evidence_runs_once_over_a_join_that_is_kept(spark):
    when = pd.Timestamp(2022, 10, 5).to_pydatetime()
    made = {"olist_order_items_dataset": spark.createDataFrame([("o1", 1, "p", "s", 10.0, 2.0), ("o2", 1, "p", "s", 5.0, None)], "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value double"),
            "olist_orders_dataset": spark.createDataFrame([("o1", "c", "delivered", when), ("o2", "c", None, when)], "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz")}
    tables.register(made)
    month = lambda expected, column="revenue": evidence.Asked(evidence.MONTHLY, {"year": 2022, "month": 10}, expected, column, 0.02, "code")
    got, few = jobs(spark, "evidence", lambda: evidence.check(spark, [month(17.0)]))
    _, many = jobs(spark, "more evidence", lambda: evidence.check(spark, [month(17.0)] * 3))
    assert got[0][0].verified and got[0][0].preview == "revenue | orders\n17.0 | 2" and got[0][1].code == "code" and many <= 3 * few
    wrong, broken, none = evidence.check(spark, [month(30.0), evidence.Asked("SELECT nothing FROM nowhere", {}, 1.0, "x", 0.02), month(2.0, "orders")])
    assert not wrong[0].verified and broken[0].preview.startswith("# failed") and not broken[0].verified and none[0].verified
    joined = evidence.sold(spark).persist()
    assert "InMemoryRelation" in spark.sql(evidence.MONTHLY, args={"year": 2022, "month": 10})._jdf.queryExecution().withCachedData().toString()
    joined.unpersist()


def test_panels_of_several_quarters_are_those_of_each_pair(fact):
    cells = causal.cells(fact, ["2024Q1", "2024Q2", "2024Q3"])
    for pair in (("2024Q2", "2024Q1"), ("2024Q3", "2024Q2")):
        assert sorted(map(tuple, causal.sided(cells, *pair).collect())) == sorted(map(tuple, causal.panel(fact, *pair).collect()))


def test_movers(spark, fact):
    got = segments.movers(fact, "customer_state", "2024Q1", "2024Q2", min_orders=5).collect()
    assert len(got) == 3 and all(r.delta_pct > 0 and r.significant for r in got)
    assert segments.movers(fact, "customer_state", "2024Q1", "2024Q2", min_orders=1000).count() == 0
    assert [r.entity for r in segments.top_movers(segments.movers(fact, "customer_state", "2024Q1", "2024Q2", 5), 2).collect()] == [r.entity for r in sorted(got, key=lambda r: -r.delta_pct)[:2]]


def test_daily_tests(fact):
    got = {r.name: r for r in segments.daily_tests(fact, "2024Q2", "2024Q1").collect()}
    assert set(got) >= {"revenue | Welch t-test", "revenue | Mann-Whitney U", "volume share test (binomial)"}
    assert got["revenue | Welch t-test"].p_value < 1e-10 and got["volume share test (binomial)"].p_value == 1.0


def mann_whitney(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_two_samples(spark):
    rng = random.Random(4)
    groups = {"p": ([rng.gauss(0, 1) for _ in range(40)], [rng.gauss(1, 2) for _ in range(25)]), "ties": ([float(rng.randrange(4)) for _ in range(30)], [float(rng.randrange(5)) for _ in range(30)]), "same": ([1.0] * 9, [1.0] * 9), "few": ([1.0, 2.0], [3.0] * 20)}
    rows = [(g, s, x) for g, ab in groups.items() for s in (0, 1) for x in ab[s]] + [("p", 0, None), ("p", 1, math.nan), ("p", None, 5.0)]
    got = {r.g: r for r in significance.two_samples(spark.createDataFrame(rows, "g string, side int, x double"), ["g"], F.col("side"), "x").collect()}
    assert set(got) == {"p", "ties", "same"}
    for g in ("p", "ties"):
        a, b = map(np.array, groups[g])
        va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        t, df = (a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
        assert got[g].t == pytest.approx(t) and got[g].df == pytest.approx(df) and got[g].p_t == pytest.approx(kernels.t_two_sided(t, df), rel=1e-9)
        u = mann_whitney(a, b)
        assert got[g].u == pytest.approx(u) and got[g].r == pytest.approx(1 - 2 * u / (len(a) * len(b))) and 0 <= got[g].p_u <= 1
    assert got["same"].t is None and got["same"].d == 0 and got["same"].p_u == 1


def test_exact_rank_sum_by_enumeration(spark):
    a, b = [1.0, 4.0, 6.0], [2.0, 3.0, 5.0, 7.0]
    u, values = mann_whitney(a, b), a + b
    far = max(u, 12 - u)
    hits = [mann_whitney(p[:3], p[3:]) for p in permutations(values)]
    want = min(1.0, 2 * sum(h >= far for h in hits) / len(hits))
    assert kernels.exact_rank_sum(u, 3, 4) == pytest.approx(want)


def test_exact_rank_sum_in_closed_form_counts_all_arrangements():
    for small, large in ((1, 1), (1, 9), (2, 5), (3, 4), (3, 11), (4, 6), (5, 7), (8, 9)):
        ways = np.zeros(small * large + 1, dtype="int64")
        table = {(0, n): {0: 1} for n in range(large + 1)} | {(m, 0): {0: 1} for m in range(small + 1)}
        for m in range(1, small + 1):
            for n in range(1, large + 1):
                table[m, n] = dict(table[m, n - 1])
                for u, k in table[m - 1, n].items():
                    table[m, n][u + n] = table[m, n].get(u + n, 0) + k
        for u, k in table[small, large].items():
            ways[u] = k
        upto = np.cumsum(ways)
        assert [kernels._arrangements_up_to(u, small, large) for u in range(small * large + 1)] == upto.tolist()
        assert kernels.exact_rank_sum(small * large, small, large) == pytest.approx(min(1, 2 / math.comb(small + large, small)))
    assert 0.99 < kernels.exact_rank_sum(4e9 + 1, 8, 10**9) <= 1 and kernels.exact_rank_sum(0, 8, 10**9) < 1e-60


def test_p_values(spark):
    df = spark.createDataFrame([(2.0, 10.0, 40, 100), (0.0, 5.0, 50, 100), (20.0, 1e5, 0, 10), (None, 3.0, 0, 0)], "t double, df double, k bigint, n bigint")
    got = df.select(pvalues.t_two_sided(F.col("t"), F.col("df")), pvalues.binomial_half(F.col("k"), F.col("n")), pvalues.normal_two_sided(F.col("t"))).collect()
    exact = lambda k, n: min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
    assert got[0][0] == pytest.approx(0.0733880348, rel=1e-8) and got[0][1] == pytest.approx(exact(40, 100), rel=1e-9) and got[0][2] == pytest.approx(math.erfc(math.sqrt(2)))
    assert got[1][0] == 1 and got[1][1] == 1 and got[2][0] < 1e-80 and got[2][1] == pytest.approx(exact(0, 10)) and got[3][0] is None and got[3][1] is None
    for x, a, b in ((0.3, 2.0, 5.0), (0.99, 50.0, 0.5), (0.5, 300.0, 301.0)):
        jvm = spark.range(1).select(pvalues.regularized_beta(x, a, b)).first()[0]
        assert kernels.beta_inc(x, a, b) == pytest.approx(jvm, rel=1e-10)


def test_correlations(spark):
    rng = random.Random(6)
    x = [float(rng.randrange(20)) for _ in range(300)]
    y = [v * v + rng.gauss(0, 20) for v in x]
    df = spark.createDataFrame([*zip(x, y), (None, 1.0), (1.0, math.nan)], "x double, y double")
    got = significance.correlations(df, ["x", "y"]).first()
    s = pd.DataFrame({"x": x, "y": y})
    assert got.n == 300 and got.pearson == pytest.approx(s.corr().loc["x", "y"]) and got.spearman == pytest.approx(s.rank().corr().loc["x", "y"])
    assert got.r == max(got.pearson, got.spearman) and got.p < 1e-10
    assert significance.correlations(df, ["x", "y"], min_rows=301).count() == 0
    constant = df.withColumn("x", F.lit(1.0))
    assert significance.correlations(constant, ["x", "y"]).first().r is None


def test_geo_lift(spark):
    cells = [("RJ", "audio", 30.0), ("RJ", "games", 10.0), ("SP", "audio", 10.0), ("SP", "games", 50.0), (None, "audio", 99.0)]
    rows = [(f"o{i}{k}", "q", "m", None, s, "c", c, "x", v, 0.0, None, v) for i, (s, c, v) in enumerate(cells) for k in range(2)]
    got = {(r.state, r.category): r for r in graph.geo_lift(spark.createDataFrame(rows, FACT), min_orders=2).collect()}
    assert len(got) == 4 and got["RJ", "audio"].lift == pytest.approx((30 / 40) / (40 / 100)) and got["RJ", "audio"].n_orders == 2
    assert graph.geo_lift(spark.createDataFrame(rows, FACT), min_orders=3).count() == 0


def test_pair_lift_counts_orders_with_blank_categories(spark):
    baskets = {"a": ["x", "y"], "b": ["x", "y", ""], "c": ["x"], "d": [""], "e": [None]}
    rows = [(o, "q", "m", None, "s", "c", c, "x", 1.0, 0.0, None, 1.0) for o, cs in baskets.items() for c in cs]
    got = graph.pair_lift(spark.createDataFrame(rows, FACT), 0.0, 1).collect()
    assert [(r.item_a, r.item_b, r.n_orders) for r in got] == [("x", "y", 2)] and got[0].lift == pytest.approx(2 * 4 / (3 * 2)) and got[0].support == 0.5


def test_communities():
    two = [(a, b, 1.0) for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x", 0.1), ("q", "r", -1.0)]
    assert kernels.communities(two) == [["a", "b", "c"], ["x", "y", "z"]]
    assert kernels.communities([]) == []


def test_least_squares_and_verdicts():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 2, 200), rng.normal(size=200), np.ones(200)])
    y = x @ [3.0, 1.0, 0.5] + rng.normal(size=200)
    coef, p, df = kernels.least_squares(x, y)
    assert np.allclose(coef, np.linalg.lstsq(x, y, rcond=None)[0]) and p[0] < 1e-6 and df == 197
    low, high = kernels.coefficient_interval(x, y)
    assert low < 3 < high
    doubled, p, df = kernels.least_squares(np.column_stack([x[:, 0], x]), y)
    assert np.allclose(doubled[:2], coef[0] / 2) and df == 197


def test_mean_difference_interval():
    low, high = kernels.mean_difference_interval(np.arange(100.0) + 50, np.arange(100.0))
    assert low < 50 < high and math.isnan(kernels.mean_difference_interval(np.array([]), np.array([1.0]))[0])


def test_skeleton_drops_the_indirect_link():
    rng = np.random.default_rng(1)
    a = rng.normal(size=2000)
    b = a + rng.normal(size=2000)
    c = b + rng.normal(size=2000)
    assert kernels.skeleton(np.column_stack([a, b, c])) == {(0, 1), (1, 2)}


def test_panel_and_gram_sums(spark, fact):
    cells = causal.panel(fact, "2024Q2", "2024Q1")
    rows = cells.collect()
    assert len(rows) == 12 and {r.treatment for r in rows} == {0, 1} and all(r.reviews_mean is None and r.review_rate == 0 for r in rows)
    sums = {(r.a, r.b): r.total for r in causal.gram_sums(cells, ["revenue", "n_items"]).collect()}
    assert sums["const", "const"] == 12 and sums["n_items", "const"] == 180 and sums["revenue", "n_items"] == pytest.approx(sum(r.revenue * r.n_items for r in rows))
    assert causal.test_change(cells).verdict == "insufficient_data" and causal.test_segment(cells, "state", "SP") is None


def test_discovery(spark):
    a = spark.createDataFrame([("1", 5, None, "2022-01-01"), ("2", 6, "x", "2022-01-02"), (None, 7, "x", "2022-01-03")], "order_id string, size int, word string, created_at string")
    b = spark.createDataFrame([("2", 1), ("3", 2)], "order_id string, size int")
    p = discovery.profile_table("a", a)
    assert p.n_rows == 3 and p.cardinality["word"] == 1 and p.missing["order_id"] == pytest.approx(1 / 3) and p.numeric_range == {"size": (5.0, 7.0)}
    assert discovery.discover_joins({"a": a, "b": b}) == [discovery.Join("a", "b", "order_id", 0.5)]
    assert discovery.discover_joins({"a": a, "b": b.withColumn("order_id", F.col("order_id").cast("int"))}) == []
    assert [discovery.logical_type(a, c) for c in a.columns] == ["text", "numeric", "categorical", "datetime"]
    assert discovery.profile_table("e", a.limit(0)).missing["word"] == 0 and "order_id" in discovery.joins_text([discovery.Join("a", "b", "order_id", 0.5)])
