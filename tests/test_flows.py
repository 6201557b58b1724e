import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import flows as FL
from helpers import BASE_US, packets_df

A, X, Y = "10.0.0.1", "10.0.1.1", "10.0.1.2"
GOLDEN = [
    (0.0, A, 40000, X, 80, 6, 100),
    (1.0, A, 40000, X, 80, 6, 200),
    (2.0, A, 0, Y, 0, 1, 84),
    (3.0, A, 40000, X, 80, 6, 300),
    (5.0, X, 80, A, 40000, 6, 500),
    (11.0, A, 40001, X, 4444, 6, 60),
]


def _by_key(df):
    return {(r.src_ip, r.src_port, r.dst_ip, r.dst_port): r for r in df.collect()}


def test_hand_derived_flow_features(spark):
    f = _by_key(FL.flow_extract(packets_df(spark, GOLDEN)))
    assert len(f) == 4
    a = f[(A, 40000, X, 80)]
    assert a.start_time == pytest.approx(BASE_US / 1e6) and a.duration == pytest.approx(3.0)
    assert (a.total_packets, a.total_bytes, a.fwd_packets, a.bwd_packets, a.fwd_bytes, a.bwd_bytes) == (3, 600, 3, 0, 600, 0)
    assert a.mean_pkt_len == pytest.approx(200) and a.std_pkt_len == pytest.approx(81.649658, abs=1e-6)
    assert a.mean_iat == pytest.approx(1.5) and a.std_iat == pytest.approx(0.5)
    assert a.pkts_per_sec == pytest.approx(1.0) and a.bytes_per_sec == pytest.approx(200)
    assert a.uncommon_port == 0 and a.dst_ip_entropy == 0.0
    icmp = f[(A, 0, Y, 0)]
    assert icmp.uncommon_port == 1 and icmp.dst_ip_entropy == pytest.approx(1.0)
    assert icmp.duration == 0.0 and icmp.pkts_per_sec == 0.0 and icmp.std_pkt_len == 0.0 and icmp.mean_iat == 0.0
    reply = f[(X, 80, A, 40000)]
    assert reply.bwd_packets == 0 and reply.dst_ip_entropy == 0.0 and reply.uncommon_port == 1
    late = f[(A, 40001, X, 4444)]
    assert late.dst_ip_entropy == pytest.approx(1.0)   # the flow at t=0 is older than 11 - 10


def test_non_ip_frames_dropped_but_counted(spark):
    rows = GOLDEN + [(4.0, None, 0, None, 0, 0, 60, False)]
    pk = packets_df(spark, rows)
    assert FL.flow_extract(pk).count() == 4
    s = FL.capture_summary(pk).first()
    assert (s.total_packets, s.ip_packets, s.raw_flows) == (7, 6, 4)


def _random_packets(seed, n=400, sources=3, dsts=5, span_s=60.0):
    rnd = random.Random(seed)
    t, rows = 0.0, []
    for _ in range(n):
        t += rnd.expovariate(n / span_s)
        src = f"10.0.0.{rnd.randrange(sources)}"
        dst = f"10.0.1.{rnd.randrange(dsts)}"
        proto = rnd.choice([6, 6, 17, 1])
        sp, dp = (0, 0) if proto == 1 else (40000 + rnd.randrange(3), rnd.choice([80, 443, 53, 4444]))
        rows.append((round(t, 6), src, sp, dst, dp, proto, 60 + rnd.randrange(1400)))
    return rows


def _naive_flows(rows):
    """The reference rules written as a loop (per segment = one list here)."""
    flows, order = {}, []
    for t, src, sp, dst, dp, pr, ln in rows:
        k = (src, sp, dst, dp, pr)
        if k not in flows:
            flows[k] = []
            order.append(k)
        flows[k].append((t, ln))
    hist, out = {}, {}
    for k in order:
        ts = [p[0] for p in flows[k]]
        sz = [p[1] for p in flows[k]]
        n = len(ts)
        mean = sum(sz) / n
        std = math.sqrt(sum((x - mean) ** 2 for x in sz) / n) if n > 1 else 0.0
        iat = [b - a for a, b in zip(ts, ts[1:])]
        mi = sum(iat) / len(iat) if iat else 0.0
        si = math.sqrt(sum((x - mi) ** 2 for x in iat) / len(iat)) if iat else 0.0
        hist.setdefault(k[0], []).append((ts[0], k[2]))
        recent = [d for tt, d in hist[k[0]] if tt >= ts[0] - 10.0]
        c = {}
        for d in recent:
            c[d] = c.get(d, 0) + 1
        h = -sum((v / len(recent)) * math.log2(v / len(recent)) for v in c.values())
        out[k] = (n, sum(sz), mean, std, mi, si, h)
    return out


@pytest.mark.parametrize("seed,chunk,slices", [(1, 1 << 20, 1), (2, 7, 1), (3, 3, 4), (4, 1 << 20, 3)])
def test_flows_equal_naive_loop(spark, seed, chunk, slices):
    rows = _random_packets(seed)
    got = FL.flow_extract(packets_df(spark, rows), chunk_packets=chunk, slices_per_window=slices).collect()
    exp = _naive_flows(rows)
    assert len(got) == len(exp)
    for r in got:
        n, b, mean, std, mi, si, h = exp[(r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.proto)]
        assert (r.total_packets, r.total_bytes) == (n, b)
        assert r.mean_pkt_len == pytest.approx(mean) and r.std_pkt_len == pytest.approx(std, abs=1e-9)
        assert r.mean_iat == pytest.approx(mi, abs=1e-9) and r.std_iat == pytest.approx(si, abs=1e-6)
        assert r.dst_ip_entropy == pytest.approx(h, abs=1e-9)


def test_packet_iat_exact_across_chunks(spark):
    rows = _random_packets(5, n=120)
    pk = packets_df(spark, rows)
    a = {r.pkt_idx: r.iat for r in FL.packet_iat(pk, chunk_packets=4).collect()}
    b = {r.pkt_idx: r.iat for r in FL.packet_iat(pk).collect()}
    assert a == b and sum(v is None for v in a.values()) == FL.flow_extract(pk).count()


def test_subnet_filter(spark):
    pk = packets_df(spark, GOLDEN)
    got = FL.filter_subnet(pk, "10.0.1.2/32").count()
    assert got == 1
    assert FL.filter_subnet(pk, "10.0.0.0/24").count() == 6


def test_entropy_hot_source_split_over_slices(spark):
    # one source, many flows in one segment: the result must not depend on the slicing
    rows = [(i * 0.05, A, 40000 + (i % 7), f"10.0.1.{i % 9}", 80, 6, 100) for i in range(600)]
    pk = packets_df(spark, rows)
    e10 = {r.seq: r.dst_ip_entropy for r in FL.flow_extract(pk).collect()}
    exp = _naive_flows(rows)
    got = FL.flow_extract(pk).collect()
    for r in got:
        assert r.dst_ip_entropy == pytest.approx(exp[(r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.proto)][6], abs=1e-9)
    assert len(e10) == len(got)


def test_shannon_entropy_group_form(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z")], "g string, v string")
    got = {r.g: r.entropy for r in FL.shannon_entropy(df, ["g"], "v").collect()}
    assert got["b"] == 0.0
    assert got["a"] == pytest.approx(-(1 / 3) * math.log2(1 / 3) - (2 / 3) * math.log2(2 / 3))
    assert F is not None


@pytest.mark.parametrize("slices", [1, 8])
def test_out_of_order_capture_in_first_packet_order(spark, slices):
    rng, t, rows = random.Random(11 + slices), 0.0, []
    for i in range(240):
        t += rng.choice([0.01, 0.3, 0.7, -0.4, -3.0 if i % 40 == 0 else 0.2, 12.0 if i % 90 == 0 else 0.1]) + rng.random() * 1e-3
        t = max(t, 0.0)
        rows.append((round(t, 6), f"10.0.0.{rng.randint(1, 2)}", 40000 + i % 5, f"10.0.1.{rng.randint(1, 4)}", rng.choice([80, 443]), 6, 100))
    got = FL.flow_extract(packets_df(spark, rows), slices_per_window=slices, capture_order=True).collect()
    exp = _naive_flows(rows)
    assert len(got) == len(exp) > 50
    for r in got:
        assert r.dst_ip_entropy == pytest.approx(exp[(r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.proto)][6], abs=1e-9)
    by_time = FL.flow_extract(packets_df(spark, rows), slices_per_window=slices).collect()
    assert {r.seq: r.dst_ip_entropy for r in by_time} != {r.seq: r.dst_ip_entropy for r in got}


def test_a_hot_sources_slices_shrink(spark):
    """Events that one slice of a hot source sorts: with finer slices fewer, and none is copied."""
    rows = [(i * 0.01, A, 40000 + i % 701, f"10.0.1.{i % 9}", 80, 6, 100) for i in range(3000)]
    stats = FL.flow_stats(FL.filter_ip(packets_df(spark, rows))).select("segment_id", "src_ip", "dst_ip", "t0", "seq")
    n, largest = stats.count(), {}
    for m in (1, 8, 64):
        wlen = 10_000_000
        ev = FL._events(stats, "t0", "seq", wlen, wlen // m, 1 if m == 1 else 0)
        sizes = [r["count"] for r in ev.groupBy("segment_id", "src_ip", "_sl").count().collect()]
        largest[m] = max(sizes)
        assert sum(sizes) == (3 * n if m == 1 else 2 * n)
    assert largest[8] * 3 < largest[1] and largest[64] * 3 < largest[8]
    a, b = ({r.seq: r.dst_ip_entropy for r in FL.dst_ip_entropy(stats, slices_per_window=m).collect()} for m in (1, 64))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
