"""A spread of registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as e
from tools.check import canon

D = "/root/testdata/sf0.001"
NAMES = ["a01_source_distribution", "x02_incremental_merge_batch", "a16_merge_report", "f02_catalogue_filters", "l03_w02_j18_recommendation_feed",
         "w07_calibrated_ranking", "f10_f14_constraint_flags", "j09_gazetteer", "j07_w06_nearest_labels", "j10_w05_related_postings",
         "j11_similar_posting_pairs", "p12_p14_e02_loose_records", "h06_links", "p33_violations", "x05_latest_per_key"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    got, want = e.queries()[name](spark, D).toPandas(), con.sql(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_registry():
    qs, os_ = e.queries(), e.oracle_sql()
    assert set(os_) <= set(qs) and len(qs) > 150
