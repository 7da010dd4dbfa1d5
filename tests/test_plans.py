"""Plan guards for scale: the per-packet operators never funnel rows through
one partition (no global window or sort over packets)."""

from floodlens.operators.detect import detection_state, mitigation_trigger
from floodlens.operators.rates import packet_rates, session_id
from floodlens.plans.detector import attack_slice
from floodlens.plans.fixture import ALL_SOURCES, CHUNK_S, FIXTURE_TH as TH
from floodlens.sources.adapter import packets
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_detector_has_no_single_partition_exchange(spark):
    s = attack_slice(packets(spark, SF_SMALL), ALL_SOURCES).withColumn("session_id", session_id())
    r = packet_rates(s, "session_id", TH, CHUNK_S)
    d = mitigation_trigger(detection_state(r, TH), TH)
    for df in (r, d):
        p = _plan(df)
        assert "SinglePartition" not in p
        assert "Exchange hashpartitioning(session_id" in p  # rows are partitioned by session (and chunk)


def test_scan_prunes_columns(spark):
    p = _plan(packets(spark, SF_SMALL).select("pkt_id", "ts_us"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p
