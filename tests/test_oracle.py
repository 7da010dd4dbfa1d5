"""Registered queries against their DuckDB twins on the
smallest driver tables.  The driver runs the full set at sf0.01."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck

SAMPLE = [
    "p01_prep", "p03_classify_protocol", "p07_ip_to_host", "p08_session_id", "p16_event_routing", "p16_event_rows",
    "f04_capture_filter", "f09_pivot_slice", "j05_post_drop_exclusion", "j06_mitigation_active", "j07_asof_port",
    "a01_scenario_summary", "a05_attacker_stats", "a08_latency", "a16_size_histogram", "a17_box_stats",
    "w01_dense_mean_rate", "w08_ewma_rate", "w09_flow_features", "w10_phase_segments", "w13_detection_state",
    "w16_near_duplicates", "w18_throttle", "t01_top_sources", "m02_stratified_split", "m08_threshold_sweep",
    "st02_detector_stream", "s04_capture_text_scan", "m10_class_weights", "t02_sorted_counts",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_registry_consistent():
    qs, sq = E.queries(), E.oracle_sql()
    assert set(sq) <= set(qs)
    assert set(SAMPLE) <= set(qs)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, con, name):
    qs, sq = E.queries(), E.oracle_sql()
    r = compare(spark, con, name, qs[name], sq.get(name), SF_SMALL)
    assert r["status"] in ("OK", "rows-only"), r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "src_ip" in df.columns
