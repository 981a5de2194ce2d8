import sys
from pathlib import Path

import pytest

TABLES = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools import compare  # noqa: E402

CHECKED = ("fact_table", "period_changes", "monthly_rolling_z", "correlation_pairs", "geo_category_lift", "p1_found", "p2_found", "p3_found", "p4_found", "p4_rows", "p5_found", "p5_totals")


def test_every_text_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in range(1, 6)} <= set(entry.queries())


@pytest.mark.skipif(not TABLES.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in TABLES.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    own, other = entry.queries()[name](spark, str(TABLES)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(other.columns) and compare.rows(own) == compare.rows(other)


@pytest.mark.skipif(not TABLES.exists(), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["metric", "period", "prev_period", "base_value", "comp_value", "delta_pct", "n_base", "n_comp"]
