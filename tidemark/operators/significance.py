"""Two-sample tests and correlations, computed for all groups at once.

Values enter as counts of equal values. Ranks are found in two steps, like exact medians: counts per size bin say how many values
lie below a bin, and only inside a bin are values ordered, so that no task orders a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels, pvalues
from ..session import cut, ship
from .profile import _size_bin
from .skew import lookup

#: The rank-sum test is exact if the smaller side has at most so many values, none tied: a rule of the reference's statistics, for any size of the other side.
EXACT_ROWS = 8


def average_ranks(counted: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """counted (one row per keys and value, ``n`` times each) with ``rank``: the mean rank of the equal values within the keys, from 1."""
    rows = counted.withColumn("_bin", _size_bin(F.col(value)))
    bins = rows.groupBy(*keys, "_bin").agg(F.sum(n).alias("_m"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bin")
    bins = bins.withColumn("_below", F.sum("_m").over(before) - F.col("_m")).drop("_m")
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    bins = bins.withColumnsRenamed({**names, "_bin": "_b"})
    same = F.col("_bin") == F.col("_b")
    for k, o in names.items():
        same = same & F.col(k).eqNullSafe(F.col(o))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value)
    both = rows.join(bins, same)
    rank = F.col("_below") + F.sum(n).over(inside) - F.col(n) + (F.col(n) + 1) / 2
    return both.withColumn("rank", rank).drop("_bin", "_b", "_below", *names.values())


def two_samples(df: DataFrame, keys: Sequence[str], side: Column, value: str, min_rows: int = 8) -> DataFrame:
    """Per group the tests of side 0 (base) against side 1: n_a, n_b, mean_a, mean_b, t, df, p_t, d, u, p_u, r.

    t: Welch's test; d: Cohen's d over the pooled variance (0 if that is 0); u: Mann-Whitney statistic of the base with its p (normal with tie and continuity
    correction, or exact, see EXACT_ROWS); r = 1 - 2u / (n_a n_b). Null and NaN values and rows of neither side are left out, and so are
    groups with fewer than ``min_rows`` values on a side. Without variance on both sides t, df and p_t are null.
    """
    ship(df.sparkSession)
    v = F.col(value).cast("double")
    rows = df.select(*keys, side.cast("int").alias("_side"), v.alias("_x")).where("_side IN (0, 1) AND _x IS NOT NULL AND NOT isnan(_x)")
    counted = cut(rows.groupBy(*keys, "_x").agg(*(F.sum((F.col("_side") == s).cast("bigint")).alias(f"_{s}") for s in (0, 1))))
    counted = counted.withColumn("_n", F.col("_0") + F.col("_1"))
    ranked = average_ranks(counted, keys, "_x", "_n")
    x, a, b = F.col("_x"), F.col("_0"), F.col("_1")
    sums = ranked.groupBy(*keys).agg(
        F.sum(a).alias("n_a"), F.sum(b).alias("n_b"), F.try_divide(F.sum(a * x), F.sum(a)).alias("mean_a"), F.try_divide(F.sum(b * x), F.sum(b)).alias("mean_b"),
        F.sum(a * F.col("rank")).alias("_ranks"), F.sum(F.col("_n") * (F.col("_n") * F.col("_n") - 1).cast("double")).alias("_ties"),
    )
    sums = sums.where((F.col("n_a") >= min_rows) & (F.col("n_b") >= min_rows))
    # squares around the means, in a second pass over the counts: no cancellation
    means = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "mean_a", "mean_b")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    off = counted.join(means, same).groupBy(*keys).agg(F.sum(a * F.pow(x - F.col("mean_a"), 2)).alias("_sa"), F.sum(b * F.pow(x - F.col("mean_b"), 2)).alias("_sb"))
    off = off.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    both = sums.join(off, same)
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    va, vb = F.try_divide(F.col("_sa"), na - 1), F.try_divide(F.col("_sb"), nb - 1)
    spread = va / na + vb / nb
    t = F.when(spread > 0, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(spread))
    df_ = F.when(spread > 0, spread * spread / (F.pow(va / na, 2) / (na - 1) + F.pow(vb / nb, 2) / (nb - 1)))
    pooled = (F.col("_sa") + F.col("_sb")) / (na + nb - 2)
    d = F.when(pooled > 0, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled)).otherwise(F.lit(0.0))
    u, n = F.col("_ranks") - na * (na + 1) / 2, na + nb
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = F.when(sd > 0, (F.greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sd)
    # z below 0 (the continuity correction at the very middle) has p 1
    p_u = F.when(sd > 0, F.least(F.lit(1.0), pvalues.erfc(z / F.sqrt(F.lit(2.0))))).otherwise(F.lit(1.0))
    found = both.withColumns({"t": t, "df": df_, "d": d, "u": u, "r": 1 - 2 * u / (na * nb), "_p": p_u})
    exact = (F.least("n_a", "n_b") <= EXACT_ROWS) & (F.col("_ties") == 0)
    found = found.withColumn("p_t", pvalues.t_two_sided(F.col("t"), F.col("df"))).withColumn("p_u", _exact(F.col("_p"), exact, F.col("u"), F.col("n_a"), F.col("n_b")))
    return found.select(*keys, "n_a", "n_b", "mean_a", "mean_b", "t", "df", "p_t", "d", "u", "p_u", "r")


@F.pandas_udf(T.DoubleType())
def _exact(p, exact, u, na, nb):  # one row per group
    import pandas as pd

    return pd.Series([kernels.exact_rank_sum(x, int(m), int(n)) if e else q for q, e, x, m, n in zip(p, exact, u, na, nb)])


def _corr(x: Column, y: Column) -> Column:
    """Pearson's correlation, null without variance (the built-in one fails there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, columns: Sequence[str], min_rows: int = 100) -> DataFrame:
    """(a, b, n, pearson, spearman, r, p) of each pair of the columns: r is the one further from 0 (Pearson on a tie), p its p-value.

    Rows in which either value is null or NaN are left out of a pair, and so are pairs with fewer than ``min_rows`` rows; without variance all is null.
    Spearman is Pearson over average ranks. Other columns of df are not read.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        raise ValueError("at least two columns")
    names = list(dict.fromkeys(columns))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0))  # noqa: E731  (-0.0 is 0.0)
    # the columns alone are written out: what df is made of is then computed once, not for each pass below
    rows = cut(df.select(*(number(c).alias(f"_v{i}") for i, c in enumerate(names))))
    at = {c: i for i, c in enumerate(names)}
    within = {(i, j): F.col(f"_v{i}").isNotNull() & F.col(f"_v{j}").isNotNull() for i, j in ((at[a], at[b]) for a, b in pairs)}
    # every value of a column is counted once for each pair it takes part in, and ranked within each
    cells = [F.struct(F.lit(i).alias("col"), F.col(f"_v{i}").alias("x"), F.array(*(both.cast("bigint") for both in within.values())).alias("in")) for i in range(len(names))]
    counts = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("x IS NOT NULL").groupBy("col", "x")
    counts = counts.agg(F.array(*(F.sum(F.col("in")[k]) for k in range(len(within)))).alias("n"))
    takes_part = F.array(*(F.struct(F.lit(k).alias("pair"), F.array(F.lit(i), F.lit(j)).alias("cols")) for k, (i, j) in enumerate(within)))
    each = counts.withColumn("p", F.explode(F.filter(takes_part, lambda p: F.array_contains(p["cols"], F.col("col")))))
    each = each.select("col", "x", "p.pair", F.get("n", F.col("p.pair")).alias("n")).where("n > 0")
    ranks = average_ranks(each, ["col", "pair"], "x", "n")
    ranks = cut(ranks.groupBy("col", "x").agg(*(F.max(F.when(F.col("pair") == k, F.col("rank"))).alias(f"r{k}") for k in range(len(within)))))
    # back to the rows, once for each column; a value that very many rows have is split over many tasks
    for i in range(len(names)):
        mine = [k for k, ends in enumerate(within) if i in ends]
        own = ranks.where(F.col("col") == i).select(F.col("x").alias(f"_v{i}"), *(F.col(f"r{k}").alias(f"_r{i}_{k}") for k in mine))
        rows = lookup(rows, own, f"_v{i}", [f"_v{j}" for j in range(len(names)) if j != i])
    figures = []
    for k, ((i, j), both) in enumerate(within.items()):
        x, y, rx, ry = (F.when(both, F.col(c)) for c in (f"_v{i}", f"_v{j}", f"_r{i}_{k}", f"_r{j}_{k}"))
        figures.append(F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.count(x).alias("n"), _corr(x, y).alias("pearson"), _corr(rx, ry).alias("spearman")))
    found = rows.agg(F.array(*figures).alias("f")).select(F.explode("f").alias("f")).select("f.*").where(F.col("n") >= min_rows)
    bounded = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c))))
    found = found.withColumns({"pearson": bounded("pearson"), "spearman": bounded("spearman")})
    found = found.withColumn("r", F.when(F.abs("spearman") > F.abs("pearson"), F.col("spearman")).otherwise(F.col("pearson")))
    return found.withColumn("p", pvalues.correlation(F.col("r"), F.col("n")))


def volume_share(base: Column, comp: Column) -> tuple[Column, Column, Column]:
    """(share of comp, exact two-sided p that it is a half, relative change) of two counts."""
    return F.try_divide(comp.cast("double"), (base + comp).cast("double")), pvalues.binomial_half(comp, base + comp), F.try_divide((comp - base).cast("double"), base.cast("double"))
