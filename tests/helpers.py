"""Tiny packet tables for hand-derived tests."""
from flowlens.schemas import PACKETS

BASE_US = 1_704_067_200_000_000


def packets_df(spark, rows, segment_id=0):
    """rows: (t_s, src, sport, dst, dport, proto, len[, is_ip]) in capture order."""
    out = []
    for i, r in enumerate(rows):
        t, src, sp, dst, dp, pr, ln = r[:7]
        is_ip = r[7] if len(r) > 7 else True
        out.append((segment_id, i, BASE_US + int(round(t * 1_000_000)), is_ip, src, sp, dst, dp, pr, ln))
    return spark.createDataFrame(out, PACKETS)
