import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.plans import dashboard as DB
from flowlens.schemas import LABELED_FLOWS

BASE = 1_704_067_200.0


def _flows(spark, rows):
    """rows: (start_s, pkts_per_sec, entropy, label, proto, total_bytes)"""
    out = []
    for i, (t, pps, ent, lab, proto, b) in enumerate(rows):
        d = {f.name: None for f in LABELED_FLOWS.fields}
        d.update(src_ip="10.0.0.1", src_port=40000, dst_ip="10.0.1.1", dst_port=80, proto=proto,
                 start_time=BASE + t, end_time=BASE + t, duration=0.0, total_packets=i + 1, total_bytes=b,
                 pkts_per_sec=pps, dst_ip_entropy=ent, label=lab, segment_id=0, seq=i)
        out.append(tuple(d[f.name] for f in LABELED_FLOWS.fields))
    return spark.createDataFrame(out, LABELED_FLOWS)


def test_empty_table_kpis_and_timeline(spark):
    empty = DB.empty_flows(spark)
    k = DB.kpis(empty).first().asDict()
    assert k == {"avg_throughput_pkts": 0.0, "total_bytes": 0, "active_flows": 0, "flagged_flows": 0,
                 "avg_anomaly_score": 0.0, "detection_rate": 0.0}
    tl = DB.timeline(empty, now_s=BASE + 100.7).orderBy("bucket").collect()
    assert len(tl) == 30 and tl[0].label == "00:01:10" and tl[-1].label == "00:01:39"
    assert all(r.pkts == 0.0 and r.anomaly == 0.0 for r in tl)


def test_null_label_counts_as_attack(spark):
    df = _flows(spark, [(0, 1.0, 1.0, None, 6, 10), (1, 3.0, 1.0, "NORMAL", 6, 20)])
    k = DB.kpis(df).first()
    assert k.flagged_flows == 1 and k.detection_rate == 50.0 and k.avg_throughput_pkts == 2.0
    assert k.avg_anomaly_score == pytest.approx(round((0.12 + 0.02) / 2, 3))


def test_all_equal_starts_fall_in_bin_4(spark):
    df = _flows(spark, [(5, 1.0, 0.0, "NORMAL", 6, 1)] * 3)
    b, _ = DB.with_bucket(df)
    assert {r.bucket for r in b.collect()} == {4}
    tl = DB.timeline(df).orderBy("bucket").collect()
    assert len(tl) == 10 and tl[4].pkts == 1.0 and tl[4].label == "00:00:05"


def test_buckets_equal_pandas_cut(spark):
    rng = np.random.default_rng(4)
    for span in (7.3, 45.0, 500.0):
        ts = np.round(rng.uniform(0, span, 300), 6)
        ts[0], ts[1] = 0.0, span
        df = _flows(spark, [(float(t), 1.0, 0.0, "NORMAL", 6, 1) for t in ts])
        b, st = DB.with_bucket(df)
        got = [r.bucket for r in b.orderBy("seq").collect()]
        bins = st.first().bins
        dt = pd.to_datetime(BASE + ts, unit="s")
        exp = pd.cut(pd.Series(dt), bins=bins, labels=False).tolist()
        assert got == exp


def test_gap_labels_carry_previous_plus_step(spark):
    # span 120 s -> 60 bins of 2 s; flows only in the first and last bucket
    df = _flows(spark, [(0, 1.0, 0.0, "NORMAL", 6, 1), (120, 1.0, 0.0, "NORMAL", 6, 1)])
    tl = DB.timeline(df).orderBy("bucket").collect()
    assert len(tl) == 60 and tl[0].label == "00:00:00" and tl[1].label == "00:00:02" and tl[2].label == "00:00:04"
    assert tl[59].label == "00:02:00" and tl[1].pkts == 0.0


def test_flows_page_filters_sorts_and_validates(spark):
    df = _flows(spark, [(0, 1.0, 0.0, "NORMAL", 6, 300), (1, 2.0, 0.5, "RECON", 17, 100),
                        (2, 3.0, 0.2, "NORMAL", 6, None), (3, 4.0, 0.1, "NORMAL", 1, 200)])
    p = DB.flows_page(df, proto="TCP", sort_col="total_bytes", sort_dir="desc", limit=10).collect()
    assert [r.total_bytes for r in p] == [300, None] and p[0].total == 4 and p[0].filtered == 2
    p = DB.flows_page(df, search="udp").collect()
    assert [r.label for r in p] == ["RECON"]
    p = DB.flows_page(df, sort_col="nope", limit=2).collect()
    assert [r.seq for r in p] == [0, 1]
    with pytest.raises(ValueError):
        DB.flows_page(df, limit=501)
    with pytest.raises(ValueError):
        DB.flows_page(df, limit=-1)


def test_events_feed_keeps_last_n(spark):
    rows = [(i, 1.0, 0.0, "NORMAL" if i % 2 else "RECON", 6, 1) for i in range(10)]
    df = _flows(spark, rows)
    feed = DB.events_feed(df, "2024-02-01 00:00:00", limit=3).collect()
    assert len(feed) == 3 and any(r.msg == "ML inference · 5 anomalous flows detected" for r in feed)
    ch = DB.status_changes(df).count()
    assert ch == 9
    assert F is not None
