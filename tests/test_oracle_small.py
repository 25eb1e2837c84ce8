"""Registered queries against their DuckDB oracle SQL on sf0.001."""

from collections import Counter

import pytest

from tests.conftest import SF_SMALL
from tools.check_oracles import TABLES, rows_of

FAST = ["tide_yearly_pivot", "tide_daily_extremes", "wave_pivot_full_join", "nearest_station",
        "panel_build", "erosion_points", "panel_impute_mean", "first_line_per_order",
        "every_50th_customer", "orders_sample_n", "scored_test_rows", "describe_scored",
        "tukey_outliers", "residual_histogram", "residual_box", "corr_matrix",
        "knn_graph", "mutual_graph", "graph_components", "denser_parent",
        "label_calinski_harabasz", "meanshift_bandwidth", "series_with_forecast",
        "customer_one_hot", "panel_series"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as entry
    sdf = entry.queries()[name](spark, SF_SMALL)
    a, ac = rows_of(sdf.columns, sdf.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    b, bc = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert ac == bc
    assert Counter(a) == Counter(b)


def test_every_query_has_docs_and_oracles_are_subset():
    import __spark_entry__ as entry
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert all(fn.__doc__ for fn in q.values())
