"""A sample of registered queries against their DuckDB twins at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, _hash

from paths import SF

NAMES = ["layer1_monitor", "profile_nulls", "exact_sample", "stratified_split_counts", "clean_all",
         "category_shift", "permute_column", "fill_mode_by_class", "dedup_keep_first", "word_entropy",
         "ks_two_sample", "statistics_report", "word_tfidf", "window_quality", "composite_numeric",
         "robustness_suite", "drift_report", "auto_clean_chain", "validate_against_schema",
         "profile_json_roundtrip", "two_layer_monitor", "percentiles_by_segment", "onehot_scaled"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql_twin(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    drows = [tuple(r[dcols.index(c)] for c in df.columns) for r in rel.fetchall()]
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _hash(srows, df.columns, 6) == _hash(drows, df.columns, 6)


def test_entry_runs(spark):
    out = E.entry(spark)
    assert [f.name for f in out.schema.fields] == ["stage", "n_rows", "missing_pct", "range_violations",
                                                   "mean_distance", "layer1_pass"]
    assert out.count() == 3
