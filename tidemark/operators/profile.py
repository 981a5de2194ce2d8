"""Column-level data quality profile, exact, from unpivoted column-value counts.

Every cell of the watched columns becomes (group, column, value), counted with a map-side combine. Frequencies, distinct
counts, ranges, pattern violations, medians and the drift between loads are all read from these counts, so the table
itself is scanned once and skewed values cost one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, hinted

#: Rows an agreed profile may have; it is read by the driver to build the checks.
PROFILE_ROWS = 10_000
#: Whole numbers up to this size are bins of their own in drift, in columns with fractions too.
WHOLE = 1000


@dataclass(frozen=True)
class Expected:
    """Agreed figures of one column; None means not checked."""

    table: str
    column: str
    missing: float | None = None
    cardinality: int | None = None
    num_min: float | None = None
    num_max: float | None = None
    median: float | None = None
    pattern: str | None = None

    @property
    def needs_values(self) -> bool:
        return any(x is not None for x in (self.cardinality, self.num_min, self.num_max, self.median, self.pattern))


def agreed(profiles: DataFrame) -> list[Expected]:
    """The rows of a profile table (table_name, column_name and the figures; NaN counts as null)."""
    rows = profiles.limit(PROFILE_ROWS + 1).collect()
    if len(rows) > PROFILE_ROWS:
        raise ValueError(f"an agreed profile has at most {PROFILE_ROWS} rows")
    number = lambda x: None if x is None or x != x else x
    return [Expected(r["table_name"], r["column_name"], number(r["missing"]), number(r["cardinality"]), number(r["num_min"]), number(r["num_max"]), number(r["median"]), r["pattern"]) for r in rows]


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def value_counts(df: DataFrame, columns: Mapping[str, bool] | Sequence[str], by: str | None = None) -> DataFrame:
    """(group, column_name, value, num, n): how often each value of each column occurs per group (one null group without ``by``).

    columns: names, or name -> whether its values are wanted; where not, only null and not null are told apart. Numbers
    come in ``num`` (-0.0 as 0.0, NaN as itself), all else as text in ``value``; null has neither. Other columns of df
    are not read. A null in ``by`` is a group of its own; an empty table gives no rows.
    """
    wanted = dict(columns) if isinstance(columns, Mapping) else dict.fromkeys(columns, True)
    cells = []
    for name, values in wanted.items():
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        text, num = F.lit(None).cast("string"), F.lit(None).cast("double")
        if not values:
            text = F.when(c.isNotNull(), F.lit(""))
        elif is_number(kind):
            num = c.cast("double") + F.lit(0.0)
        else:
            text = c.cast("string")
        cells.append(F.struct(F.lit(name).alias("column_name"), text.alias("value"), num.alias("num")))
    group = (F.col(f"`{by}`") if by else F.lit(None).cast("int")).alias("group")
    return df.select(group, F.explode(F.array(*cells)).alias("cell")).groupBy("group", "cell.column_name", "cell.value", "cell.num").agg(F.count("*").alias("n"))


def _size_bin(num: Column) -> Column:
    """A whole number that never falls as num rises: some 350 steps per factor e, a few thousand for money-like ranges."""
    return (F.signum(num) * F.floor(F.log1p(F.abs(F.greatest(F.least(num, F.lit(1e300)), F.lit(-1e300)))) * 350)).cast("bigint")


def exact_medians(counts: DataFrame, keys: Sequence[str], num: str = "num", n: str = "n") -> DataFrame:
    """(keys, median): the exact median of counted values, the mean of the two middle ones; NaN and null are no values.

    In two steps, so that no task sorts a whole group: counts per size bin tell which bins hold the two middle ranks, then
    only those bins' values are ranked. Groups without values are left out.
    """
    rows = counts.where(F.col(num).isNotNull() & ~F.isnan(num)).select(*keys, F.col(num).alias("_x"), F.col(n).alias("_n"), _size_bin(F.col(num)).alias("_bin"))
    bins = rows.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin")
    bins = bins.withColumn("_upto", F.sum("_n").over(before)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    start = F.col("_upto") - F.col("_n")
    middle = bins.where(((start < low) & (low <= F.col("_upto"))) | ((start < high) & (high <= F.col("_upto"))))
    own = [f"_k{i}" for i in range(len(keys))]
    middle = middle.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col("_bin").alias("_b"), start.alias("_start"), low.alias("_low"), high.alias("_high"))
    same = F.col("_bin") == F.col("_b")
    for k, o in zip(keys, own):
        same = same & F.col(k).eqNullSafe(F.col(o))
    inside = rows.join(middle, same).select(*keys, "_bin", "_x", "_n", "_start", "_low", "_high")
    order = Window.partitionBy(*keys, "_bin").orderBy("_x")
    inside = inside.withColumn("_to", F.col("_start") + F.sum("_n").over(order)).withColumn("_from", F.col("_to") - F.col("_n"))
    at = lambda rank: F.max(F.when((F.col("_from") < F.col(rank)) & (F.col(rank) <= F.col("_to")), F.col("_x")))
    return inside.groupBy(*keys).agg(((at("_low") + at("_high")) / 2).alias("median"))


def departures(df: DataFrame, table: str, expected: Sequence[Expected], load: str) -> DataFrame:
    """(table_name, load, column_name, check_name): where a load of the table departs from the agreed figures.

    missing: null fraction > agreed + 0.05 (NaN is not null). cardinality: more distinct non-null values than agreed.
    numeric_range: a non-null value outside num_min..num_max or NaN. median: the exact median of the values neither null
    nor NaN is below half or above twice the agreed one. pattern: a non-null value that does not match as a whole.
    A load of nulls alone departs in ``missing`` only; an empty table departs nowhere; a null load is a load.
    """
    mine = [e for e in expected if e.table == table and e.column in df.columns]
    if not mine:
        return df.select(F.lit(table).alias("table_name"), F.col(load), F.lit("").alias("column_name"), F.lit("").alias("check_name")).limit(0)
    medians_wanted = [e.column for e in mine if e.median is not None]
    counts = value_counts(df, {e.column: e.needs_values for e in mine}, load)
    if medians_wanted:
        counts = cut(counts)  # read twice: for the medians and for all else
    present = F.col("value").isNotNull() | F.col("num").isNotNull()
    bad = {"range": F.lit(False), "pattern": F.lit(False)}
    for e in mine:
        here = F.col("column_name") == e.column
        if e.num_min is not None or e.num_max is not None:
            out = F.isnan("num")
            if e.num_min is not None:
                out = out | (F.col("num") < e.num_min)
            if e.num_max is not None:
                out = out | (F.col("num") > e.num_max)
            bad["range"] = bad["range"] | (here & F.col("num").isNotNull() & out)
        if e.pattern is not None:
            text = F.col("num").cast("string") if is_number(df.schema[e.column].dataType) else F.col("value")
            bad["pattern"] = bad["pattern"] | (here & present & ~text.rlike(rf"\A(?:{e.pattern})\z"))
    figures = counts.groupBy("group", "column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(present, 0).otherwise(F.col("n"))).alias("nulls"),
        F.sum(present.cast("bigint")).alias("distinct"),
        F.max(F.coalesce(bad["range"], F.lit(False)).cast("int")).alias("out_of_range"),
        F.max(F.coalesce(bad["pattern"], F.lit(False)).cast("int")).alias("off_pattern"),
    )
    if medians_wanted:
        medians = exact_medians(counts.where(F.col("column_name").isin(medians_wanted)), ["group", "column_name"])
        m = medians.select(F.col("group").alias("_g"), F.col("column_name").alias("_c"), "median")
        figures = figures.join(m, F.col("group").eqNullSafe(F.col("_g")) & (F.col("column_name") == F.col("_c")), "left")
    else:
        figures = figures.withColumn("median", F.lit(None).cast("double"))
    checks = []
    for e in mine:
        here = F.col("column_name") == e.column
        for name, fails in (
            ("missing", F.col("nulls") / F.col("rows") > e.missing + 0.05 if e.missing is not None else None),
            ("cardinality", F.col("distinct") > e.cardinality if e.cardinality is not None else None),
            ("numeric_range", F.col("out_of_range") == 1 if e.num_min is not None or e.num_max is not None else None),
            ("median", (F.col("median") < 0.5 * e.median) | (F.col("median") > 2 * e.median) if e.median is not None else None),
            ("pattern", F.col("off_pattern") == 1 if e.pattern is not None else None),
        ):
            if fails is not None:
                checks.append(F.when(here & fails, F.lit(name)))
    return figures.select(F.lit(table).alias("table_name"), F.col("group").alias(load), "column_name", F.explode(F.array_compact(F.array(*checks))).alias("check_name")).distinct()


def profile_columns(df: DataFrame, columns: Sequence[str], by: str | None = None, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """(group, column_name, n_rows, n_missing, missing, cardinality, num_min, num_max, median, nan, off_pattern, top_value, top_n) of each column per group.

    off_pattern counts the non-null values that do not match the column's pattern as a whole, and is null for columns without one in ``patterns``.

    Numbers are compared as doubles; num_min, num_max and median leave NaN out, cardinality counts it once. top_value is the most frequent value as
    text, the smallest on a tie. A column of nulls has cardinality 0 and null figures; an empty table gives no rows.
    """
    counts = cut(value_counts(df, columns, by))
    present = F.col("value").isNotNull() | F.col("num").isNotNull()
    number = F.when(~F.isnan("num"), F.col("num"))
    text = F.coalesce("value", F.col("num").cast("string"))
    off = F.lit(None).cast("bigint")
    for name, pattern in (patterns or {}).items():
        off = F.when(F.col("column_name") == name, F.when(present & ~text.rlike(rf"\A(?:{pattern})\z"), F.col("n")).otherwise(0)).otherwise(off)
    figures = counts.groupBy("group", "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(present, 0).otherwise(F.col("n"))).alias("n_missing"),
        F.sum(present.cast("bigint")).alias("cardinality"),
        F.min(number).alias("num_min"),
        F.max(number).alias("num_max"),
        F.sum(F.when(F.isnan("num"), F.col("n")).otherwise(0)).alias("nan"),
        F.sum(off).alias("off_pattern"),
        F.min(F.when(present, F.struct((-F.col("n")).alias("m"), text.alias("v")))).alias("top"),
    )
    medians = exact_medians(counts, ["group", "column_name"]).select(F.col("group").alias("_g"), F.col("column_name").alias("_c"), "median")
    both = figures.join(medians, F.col("group").eqNullSafe(F.col("_g")) & (F.col("column_name") == F.col("_c")), "left")
    return both.select(
        "group", "column_name", "n_rows", "n_missing", (F.col("n_missing") / F.col("n_rows")).alias("missing"), "cardinality", "num_min", "num_max", "median", "nan", "off_pattern",
        F.col("top.v").alias("top_value"), (-F.col("top.m")).alias("top_n"),
    )


def _amount_cell(num: Column) -> Column:
    """Text that tells amounts apart by size: steps of a fifth of a factor e, whole numbers up to WHOLE each on their own; null stays null."""
    x = num.cast("double") + F.lit(0.0)
    whole = (F.abs(x) <= WHOLE) & (x == F.floor(x))
    return F.when(F.isnan(x), "nan").when(whole, F.concat(F.lit("="), x.cast("bigint").cast("string"))).otherwise(F.concat(F.lit("n"), F.floor(_size_bin(x) / 70).cast("string")))


def _distance_cell(date: Column, since: Column) -> Column:
    """Text for the whole days from since to date; null stays null, and a date without since is told apart."""
    seconds = lambda c: c.cast("timestamp").cast("double")
    days = _amount_cell(F.floor((seconds(date) - seconds(since)) / 86400))
    return F.when(date.isNotNull(), F.coalesce(days, F.lit("undated")))


def drift(df: DataFrame, columns: Sequence[str], load: str, since: Mapping[str, str] | None = None) -> DataFrame:
    """(column_name, load, previous, psi, chi_square, bins): change of each column's distribution against the load before it.

    Every value is a bin of its own, and so is null; only numbers with fractions are told apart by size (NaN by itself). With p and
    q the shares of a bin in the load and in the one before, each raised by half a row so that none is 0, PSI is the sum of (p - q) ln(p / q) and
    chi-square the two-sample statistic over the bins. Null loads are left out; the first load has no row. For identifiers both say how many values are new.

    since: date column -> the date column that its values are measured from, in whole days: dates themselves are new in each load.
    """
    kinds = {c: df.schema[c].dataType for c in columns}

    def cell(c: str) -> Column:
        if since and c in since:
            return _distance_cell(F.col(f"`{c}`"), F.col(f"`{since[c]}`"))
        return _amount_cell(F.col(f"`{c}`")) if isinstance(kinds[c], (T.FractionalType, T.DecimalType)) else F.col(f"`{c}`").cast("string")

    cells = [cell(c).alias(c) for c in kinds]
    rows = df.where(F.col(f"`{load}`").isNotNull()).select(F.col(f"`{load}`").alias("_load"), *cells)
    numbered = Window.partitionBy("_one").orderBy("group")
    loads = rows.select(F.col("_load").alias("group")).distinct().withColumn("_one", F.lit(1))  # one row per load
    loads = cut(loads.select("group", F.row_number().over(numbered).alias("at"), F.lag("group").over(numbered).alias("previous")))
    counts = value_counts(rows, list(kinds), "_load").join(hinted(loads), "group").select("column_name", "value", "at", "n")
    # each count meets that of the load before; where the next load lacks the value, it is the one before of a 0
    value = Window.partitionBy("column_name", "value").orderBy("at")
    near = counts.withColumns({"_n": F.when(F.lag("at").over(value) == F.col("at") - 1, F.lag("n").over(value)), "_next": F.lead("at").over(value)})
    zero = F.lit(0).cast("bigint")
    own = F.struct("at", F.col("n").alias("a"), F.coalesce("_n", zero).alias("b"))
    gone = F.when(~F.col("_next").eqNullSafe(F.col("at") + 1), F.struct((F.col("at") + 1).alias("at"), zero.alias("a"), F.col("n").alias("b")))
    pairs = near.select("column_name", F.explode(F.array_compact(F.array(own, gone))).alias("pair"))
    # the figures depend on the two counts alone, so equal pairs are counted: few rows however many values there are
    pairs = pairs.groupBy("column_name", "pair.at", "pair.a", "pair.b").agg(F.count("*").alias("m"))
    whole = Window.partitionBy("column_name", "at")
    pairs = pairs.withColumns({"na": F.sum(F.col("m") * F.col("a")).over(whole), "nb": F.sum(F.col("m") * F.col("b")).over(whole), "k": F.sum("m").over(whole)})
    p = (F.col("a") + 0.5) / (F.col("na") + 0.5 * F.col("k"))
    q = (F.col("b") + 0.5) / (F.col("nb") + 0.5 * F.col("k"))
    ratio = F.sqrt(F.col("nb") / F.col("na"))
    chi = F.pow(ratio * F.col("a") - F.col("b") / ratio, 2) / (F.col("a") + F.col("b"))
    pairs = pairs.join(hinted(loads.where("previous IS NOT NULL")), "at")  # also drops the first load's own pairs and those after the last
    return pairs.groupBy("column_name", F.col("group").alias("load"), "previous").agg(F.sum(F.col("m") * (p - q) * F.log(p / q)).alias("psi"), F.sum(F.col("m") * chi).alias("chi_square"), F.sum("m").alias("bins"))
