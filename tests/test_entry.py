import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

FAST = ["rollup_one_hour", "resample_grid", "resample_keep_off_grid", "features_flagship",
        "rolling_folds", "fold_counts", "ar1_rolling", "trend_rolling", "train_fraction",
        "exogenous_features", "epoch_roundtrip", "resample_off_phase", "resample_empty_range",
        "skipped_series", "keep_grid_folds", "rollup_stream", "select_long_list", "range_after_features"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"lag_1", "lag_2", "avg_2", "hour", "pr", "is_train"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _canon(pdf):
    cols = sorted(pdf.columns)
    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return str(v)
    return sorted(tuple(norm(x) for x in row) for row in pdf[cols].itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    s = entry.queries()[name](spark, SF_SMALL).toPandas()
    d = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    for c in s.columns:
        if str(s[c].dtype).startswith("datetime"):
            s[c] = s[c].astype("datetime64[us]")
            d[c] = d[c].astype("datetime64[us]")
    assert _canon(s) == _canon(d)
