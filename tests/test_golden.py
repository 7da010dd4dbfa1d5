"""Golden input: the four published mitigation rows, naive
local time (UTC+7), read by the S2 scan and converted to UTC (Q1)."""

import datetime as dt
import uuid

from floodlens.operators import clean as CL
from floodlens.operators.mitigate import first_drops
from floodlens.session import checkpoint_dir
from floodlens.sources import io as IO

# The published mitigation log (header + four DROP rows)
MITIGATION_LOG = """timestamp,src_ip,attacker_hostname,dpid,dpid_name,segment_description,action,reason,idle_timeout,hard_timeout,note
2026-05-21 00:29:51.147745,10.0.0.1,h1,2,s2,s2-segment-attacker-h1,DROP_ICMP,ATTACK_CONFIRMED_DELAY_PASSED,0,300,DROP rule installed
2026-05-21 00:30:04.338347,10.0.0.7,h7,3,s3,s3-segment-attacker-h7,DROP_ICMP,ATTACK_CONFIRMED_DELAY_PASSED,0,300,DROP rule installed
2026-05-21 00:30:21.626488,10.0.0.13,h13,4,s4,s4-segment-attacker-h13,DROP_ICMP,ATTACK_CONFIRMED_DELAY_PASSED,0,300,DROP rule installed
2026-05-21 00:30:30.578716,10.0.0.18,h18,5,s5,s5-segment-attacker-h18,DROP_ICMP,ATTACK_CONFIRMED_DELAY_PASSED,0,300,DROP rule installed
"""


def _us(s):
    t = dt.datetime.strptime(s, "%Y-%m-%d %H:%M:%S.%f").replace(tzinfo=dt.timezone.utc)
    return int(t.timestamp()) * 1_000_000 + t.microsecond


def test_mitigation_log_in_utc(spark):
    d = f"{checkpoint_dir(spark).rstrip('/')}/golden-{uuid.uuid4().hex[:8]}"
    lines = MITIGATION_LOG.strip().split("\n")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(d)
    log = CL.prep(IO.read_mitigation_log(spark, d), tz="Asia/Jakarta", numeric=())
    got = {r["src_ip"]: r["drop_us"] for r in first_drops(log).collect()}
    assert got == {
        "10.0.0.1": _us("2026-05-20 17:29:51.147745"),
        "10.0.0.7": _us("2026-05-20 17:30:04.338347"),
        "10.0.0.13": _us("2026-05-20 17:30:21.626488"),
        "10.0.0.18": _us("2026-05-20 17:30:30.578716"),
    }


def test_missing_log_is_empty(spark):
    assert IO.read_event_log(spark, f"{checkpoint_dir(spark).rstrip('/')}/nothing-here").count() == 0


def test_feature_scan_requires_both_files(spark):
    import pytest
    base = checkpoint_dir(spark).rstrip("/")
    with pytest.raises(FileNotFoundError):
        IO.read_feature_sessions(spark, f"{base}/no-normal", f"{base}/no-attack")
