"""Packets -> flow records (the 22 feature columns).

Plan shape (see README "Scale"):

1. IAT per packet: ``lag(t_us)`` inside (flow key, packet chunk) where a chunk is a
   contiguous range of ``pkt_idx``; one shuffle of the packets.  An elephant flow is
   split into chunks instead of landing in one task.
2. Per (flow, chunk) partial statistics (count, sums, population M2) — same partitioning,
   no extra shuffle.
3. Per flow: chunk boundary gaps by ``lag`` over the (small) chunk table, then the chunk
   moments are merged with the parallel variance formula.  One shuffle of chunk rows.
4. Destination entropy over the last 10 s per (segment, source) with enter/exit events and
   running sums (no arrays, no pair joins); a hot source is split into slices of time, whose
   state is carried from slice to slice where they are shorter than the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import in_subnet, safe_rate, uncommon_port
from .ordered import chunked_lag
from ..schemas import ENTROPY_WINDOW_S, FIVE_TUPLE, FLOW_COLUMNS, FLOW_KEY, US
from ..session import cut_lineage

# Packets per chunk of the capture index; bounds the rows one task sorts for one flow.
DEFAULT_CHUNK_PACKETS = 1 << 20


def filter_ip(packets: DataFrame) -> DataFrame:
    """keep IP packets (non-IP frames still count in ``capture_summary``)."""
    return packets.where(F.col("is_ip"))


def filter_subnet(packets: DataFrame, cidr: str) -> DataFrame:
    """capture filter ``net <cidr>`` — source or destination inside the subnet."""
    return packets.where(in_subnet("src_ip", cidr) | in_subnet("dst_ip", cidr))


def extract_5tuple(frames: DataFrame) -> DataFrame:
    """Ports only for TCP (6) / UDP (17), else 0; drops the raw L4 columns."""
    p = F.col("proto")
    l4 = p.isin(6, 17)
    return (frames
            .withColumn("src_port", F.when(l4, F.col("src_port")).otherwise(F.lit(0)).cast("int"))
            .withColumn("dst_port", F.when(l4, F.col("dst_port")).otherwise(F.lit(0)).cast("int")))


def _chunk_iat(packets: DataFrame, chunk_packets: int) -> DataFrame:
    """Gap to the previous packet of the same flow inside its capture chunk."""
    chunk = F.floor(F.col("pkt_idx") / F.lit(chunk_packets)).cast("long")
    w = Window.partitionBy(*FLOW_KEY, "chunk").orderBy("pkt_idx")
    return (packets.select(*FLOW_KEY, "pkt_idx", "t_us", "len", chunk.alias("chunk"))
            .withColumn("iat", F.col("t_us") - F.lag("t_us").over(w)))


def packet_iat(packets: DataFrame, chunk_packets: int = DEFAULT_CHUNK_PACKETS) -> DataFrame:
    """``np.diff`` of a flow's timestamps — gap (µs) to the previous packet of the same
    flow in capture order; NULL for the first packet.  Exact across chunks."""
    chunk = F.floor(F.col("pkt_idx") / F.lit(chunk_packets)).cast("long")
    d = packets.select(*FLOW_KEY, "pkt_idx", "t_us", chunk.alias("_chunk"))
    lagged = chunked_lag(d, FLOW_KEY, "_chunk", ["pkt_idx"], "t_us", "_prev")
    return lagged.select(*FLOW_KEY, "pkt_idx", "t_us", (F.col("t_us") - F.col("_prev")).alias("iat"))


def flow_stats(ip_packets: DataFrame, chunk_packets: int = DEFAULT_CHUNK_PACKETS) -> DataFrame:
    """A1-A5: per flow ``seq, t0, t1, total_packets, total_bytes, mean/std len, iat``.

    ``seq`` is the capture index of the flow's first packet (flow order in its segment).
    Start/end are the first/last packet in capture order, not min/max time.
    """
    per_chunk = (_chunk_iat(ip_packets, chunk_packets)
                 .groupBy(*FLOW_KEY, "chunk")
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.sum("len").alias("s_len"),
                      (F.var_pop("len") * F.count(F.lit(1))).alias("m2_len"),
                      F.min("pkt_idx").alias("first_idx"),
                      F.min_by("t_us", "pkt_idx").alias("first_t"),
                      F.max_by("t_us", "pkt_idx").alias("last_t"),
                      F.count("iat").alias("m_iat"),
                      F.sum("iat").alias("s_iat"),
                      F.coalesce(F.var_pop("iat") * F.count("iat"), F.lit(0.0)).alias("m2_iat")))
    whole = Window.partitionBy(*FLOW_KEY)
    ordered = whole.orderBy("first_idx")
    gap = F.col("first_t") - F.lag("last_t").over(ordered)
    m_all = F.sum("m_iat").over(whole) + F.count(gap).over(whole)
    mu_iat = ((F.coalesce(F.sum("s_iat").over(whole), F.lit(0)) + F.coalesce(F.sum(gap).over(whole), F.lit(0)))
              / m_all)
    c = per_chunk.select("*", gap.alias("gap"), (F.sum("s_len").over(whole) / F.sum("n").over(whole)).alias("mu_len"),
                         m_all.alias("m_all"), F.when(m_all > 0, mu_iat).alias("mu_iat"))
    chunk_mu_len = F.col("s_len") / F.col("n")
    chunk_mu_iat = F.col("s_iat") / F.col("m_iat")
    m2_len = F.col("m2_len") + F.col("n") * F.pow(chunk_mu_len - F.col("mu_len"), 2)
    m2_iat = (F.col("m2_iat")
              + F.when(F.col("m_iat") > 0, F.col("m_iat") * F.pow(chunk_mu_iat - F.col("mu_iat"), 2))
              .otherwise(F.lit(0.0))
              + F.coalesce(F.pow(F.col("gap") - F.col("mu_iat"), 2), F.lit(0.0)))
    return (c.groupBy(*FLOW_KEY)
            .agg(F.min("first_idx").alias("seq"),
                 F.min_by("first_t", "first_idx").alias("t0"),
                 F.max_by("last_t", "first_idx").alias("t1"),
                 F.sum("n").alias("total_packets"),
                 F.sum("s_len").alias("total_bytes"),
                 F.first("mu_len").alias("mean_len"),
                 F.sum(m2_len).alias("m2_len"),
                 F.first("m_all").alias("m_iat"),
                 F.first("mu_iat").alias("mu_iat_us"),
                 F.sum(m2_iat).alias("m2_iat")))


def _g(c: Column) -> Column:
    """c * log2(c), 0 for c = 0."""
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def _events(flows: DataFrame, t_col: str, seq_col: str, wlen: int, slen: int, context: int) -> DataFrame:
    """Enter (``_ph`` 0) and exit (1) events of the flows, cut into slices ``_sl`` of ``slen`` µs; other columns only on
    the flow's own enter event.  With ``context`` every slice gets a copy of the events that lead up to it."""
    t, cols = F.col(t_col), flows.columns
    sl = F.floor(t / F.lit(slen)).cast("long")

    def event(at: Column, time: Column, phase: int, own: bool) -> Column:
        return F.struct(at.alias("_sl"), time.alias("_et"), F.lit(phase).alias("_ph"), F.lit(1 - 2 * phase).alias("_d"),
                        F.lit(own).alias("_own"))

    events = [event(sl, t, 0, True)]
    if not context:
        events.append(event(F.floor((t + F.lit(wlen)) / F.lit(slen)).cast("long"), t + F.lit(wlen), 1, False))
    for j in range(1, context + 1):
        events += [event(sl + j, t, 0, False), event(sl + j, t + F.lit(wlen), 1, False)]
    shared = ("segment_id", "src_ip", "dst_ip", t_col, seq_col)
    ex = flows.select(*cols, F.explode(F.array(*events)).alias("_e"))
    return (ex.select(*[F.col(c) if c in shared else F.when(F.col("_e._own"), F.col(c)).alias(c) for c in cols],
                      "_e._sl", "_e._et", "_e._ph", "_e._d", "_e._own").repartition("segment_id", "src_ip", "_sl"))


_SOURCE = ("segment_id", "src_ip")


def _entropy(n: Column, s: Column, k: Column) -> Column:
    """log2 n - S / n from the number of flows, the sum of c log2 c and the number of destinations."""
    return (F.when(k <= 1, F.lit(0.0)).when(k == n, F.log2(n))
            .otherwise(F.greatest(F.log2(n) - s / n, F.lit(0.0))))


def dst_ip_entropy(flows: DataFrame, window_s: int = ENTROPY_WINDOW_S, t_col: str = "t0",
                   seq_col: str = "seq", slices_per_window: int = 1, capture_order: bool = False) -> DataFrame:
    """W1 + A6: Shannon entropy (base 2) of the destinations a source contacted over the
    last ``window_s`` seconds, per capture segment, including the current flow.

    Window of flow *a*: flows *b* of the same (segment, src_ip) with
    ``(t_b, seq_b) <= (t_a, seq_a)`` and ``t_b >= t_a - window``.  For captures in time order
    this equals the reference's first-packet order; with ``capture_order`` flows whose window
    holds a time inversion are judged by first-packet order (``seq_b <= seq_a``) through a join.

    Each flow is an *enter* event at ``t`` and an *exit* event at ``t + window``.  Running
    counts per destination give ``g(c) = c log2 c`` increments; their running sum ``S`` and
    the running flow count ``n`` give ``H = log2 n - S / n``.  No collect_list, no self-join.

    A source is spread over slices of time.  With one slice per window, a slice receives the
    events of the window before it as context and is self-contained (one shuffle).  With more,
    every event lies in one slice only and state is carried: the counts of the destinations
    that a slice touches, and n, S and the number of destinations, come from tables with a row
    per (slice, destination) and per slice, so the task of a hot source shrinks with its slices.
    """
    wlen, m = window_s * US, max(1, int(slices_per_window))
    cols = flows.columns
    if m == 1:
        out = _by_context(flows, cols, wlen, t_col, seq_col)
    else:
        out = _by_carried_state(flows, cols, wlen, -(-wlen // m), t_col, seq_col)
    return _in_capture_order(out, flows, wlen, t_col, seq_col) if capture_order else out


def _by_context(flows: DataFrame, cols: list[str], wlen: int, t_col: str, seq_col: str) -> DataFrame:
    ev = _events(flows, t_col, seq_col, wlen, wlen, 1)
    order = ("_et", "_ph", seq_col)
    per_src = _until_now(Window.partitionBy(*_SOURCE, "_sl").orderBy(*order))
    ev = ev.select("*", F.sum("_d").over(_until_now(Window.partitionBy(*_SOURCE, "_sl", "dst_ip").orderBy(*order))).alias("_c"))
    ev = ev.select("*", *_increments(F.col("_c")))
    ev = ev.select("*", *[F.sum(c).over(per_src).alias(o) for c, o in (("_d", "_n"), ("_dS", "_S"), ("_dk", "_k"))])
    return ev.where("_own").select(*cols, _entropy(F.col("_n"), F.col("_S"), F.col("_k")).alias("dst_ip_entropy"))


def _until_now(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _increments(c: Column) -> list[Column]:
    """What an event changes: sum of c log2 c, and number of destinations; ``c`` is its destination's count after it."""
    d = F.col("_d")
    return [(_g(c) - _g(c - d)).alias("_dS"),
            F.when((d == 1) & (c == 1), 1).when((d == -1) & (c == 0), -1).otherwise(0).alias("_dk")]


def _by_carried_state(flows: DataFrame, cols: list[str], wlen: int, slen: int, t_col: str, seq_col: str) -> DataFrame:
    order = ("_et", "_ph", seq_col)
    slice_ = [*_SOURCE, "_sl"]
    ev = cut_lineage(_events(flows, t_col, seq_col, wlen, slen, 0))

    def handed_on(totals: DataFrame, key: list[str], values: list[str]) -> DataFrame:
        """Sums over the slices before, a row for each (key, slice) that has events."""
        before = Window.partitionBy(*key).orderBy("_sl").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*key, "_sl", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_in{v}") for v in values])

    touched = ev.groupBy(*slice_, "dst_ip").agg(F.sum("_d").alias("_d"))
    counts = handed_on(touched, [*_SOURCE, "dst_ip"], ["_d"])
    here = F.sum("_d").over(_until_now(Window.partitionBy(*slice_, "dst_ip").orderBy(*order)))
    joined = _null_safe_join(ev.select("*", here.alias("_c")), counts, [*slice_, "dst_ip"])
    ev = cut_lineage(joined.select(*ev.columns, *_increments(F.col("_c") + F.col("_in_d"))))
    sums = ("_d", "_dS", "_dk")
    totals = handed_on(ev.groupBy(*slice_).agg(*[F.sum(c).alias(c) for c in sums]), list(_SOURCE), list(sums))
    per_src = _until_now(Window.partitionBy(*slice_).orderBy(*order))
    ev = ev.select(*cols, "_sl", "_own", *[F.sum(c).over(per_src).alias(f"_s{c}") for c in sums]).where("_own")
    n, s, k = (F.col(f"_in{c}") + F.col(f"_s{c}") for c in sums)
    return _null_safe_join(ev, totals, slice_).select(*cols, _entropy(n, s, k).alias("dst_ip_entropy"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are left out."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def _in_capture_order(judged: DataFrame, flows: DataFrame, wlen: int, t_col: str, seq_col: str,
                      chunk_flows: int = 1 << 20) -> DataFrame:
    """Replace the entropy of flows around a time inversion by the one over ``seq_b <= seq_a, t_b >= t_a - window``.

    A flow is concerned if an earlier one (by ``seq``) has a later time or a later one an earlier time: running maximum
    and minimum of the time along ``seq``, local to chunks of the capture with one row a chunk to carry.  The concerned
    flows meet the flows of the windows they reach into, and destinations are counted for each."""
    f = flows.select(*_SOURCE, "dst_ip", F.col(t_col).alias("t"), F.col(seq_col).alias("q"),
                     F.floor(F.col(seq_col) / F.lit(chunk_flows)).cast("long").alias("_sl"))
    by = Window.partitionBy(*_SOURCE, "_sl").orderBy("q")
    up = Window.partitionBy(*_SOURCE).orderBy("_sl")
    chunks = f.groupBy(*_SOURCE, "_sl").agg(F.max("t").alias("hi"), F.min("t").alias("lo"))
    chunks = chunks.select(*_SOURCE, "_sl", F.max("hi").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("hi_in"),
                           F.min("lo").over(up.rowsBetween(1, Window.unboundedFollowing)).alias("lo_in"))
    f = f.select("*", F.max("t").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("hi_here"),
                 F.min("t").over(by.rowsBetween(1, Window.unboundedFollowing)).alias("lo_here"))
    f = _null_safe_join(f, chunks, [*_SOURCE, "_sl"]).select(
        *_SOURCE, "dst_ip", "t", "q", F.greatest("hi_in", "hi_here").alias("hi"), F.least("lo_in", "lo_here").alias("lo"))
    f = cut_lineage(f)
    slot = F.floor(F.col("t") / F.lit(wlen)).cast("long")
    reach = F.sequence(F.floor((F.col("t") - F.lit(wlen)) / F.lit(wlen)).cast("long"),
                       F.floor(F.greatest("t", F.coalesce("hi", "t")) / F.lit(wlen)).cast("long"))
    odd = f.where("hi > t or lo < t").select(*_SOURCE, F.col("t").alias("t_a"), F.col("q").alias("q_a"),
                                             F.explode(reach).alias("_slot"))
    peers = f.select(*_SOURCE, slot.alias("_slot"), F.col("dst_ip").alias("d"), "t", "q")
    met = _null_safe_join(odd, peers, [*_SOURCE, "_slot"]).where((F.col("q") <= F.col("q_a"))
                                                                 & (F.col("t") >= F.col("t_a") - F.lit(wlen)))
    c = met.groupBy(*_SOURCE, "q_a", "d").agg(F.count(F.lit(1)).alias("c"))
    right = c.groupBy(*_SOURCE, F.col("q_a").alias(seq_col)).agg(
        _entropy(F.sum("c"), F.sum(_g(F.col("c"))), F.count(F.lit(1))).alias("_h"))
    return _null_safe_join(judged, right, [*_SOURCE, seq_col], "left").withColumn(
        "dst_ip_entropy", F.coalesce("_h", "dst_ip_entropy")).drop("_h")


def assemble_flows(stats: DataFrame) -> DataFrame:
    """Stats (+ entropy) -> the flow table in reference column order (+ segment_id, seq)."""
    dur_us = F.col("t1") - F.col("t0")
    dur = dur_us.cast("double") / F.lit(float(US))
    m = F.col("m_iat")
    cols = {
        "src_ip": F.col("src_ip"), "src_port": F.col("src_port"), "dst_ip": F.col("dst_ip"),
        "dst_port": F.col("dst_port"), "proto": F.col("proto"),
        "start_time": F.col("t0").cast("double") / F.lit(float(US)),
        "end_time": F.col("t1").cast("double") / F.lit(float(US)),
        "duration": F.when(F.col("total_packets") > 1, dur).otherwise(F.lit(0.0)),
        "total_packets": F.col("total_packets"), "total_bytes": F.col("total_bytes"),
        "fwd_packets": F.col("total_packets"), "bwd_packets": F.lit(0).cast("long"),
        "fwd_bytes": F.col("total_bytes"), "bwd_bytes": F.lit(0).cast("long"),
        "mean_pkt_len": F.col("mean_len").cast("double"),
        "std_pkt_len": F.sqrt(F.greatest(F.col("m2_len") / F.col("total_packets"), F.lit(0.0))),
        "mean_iat": F.when(m > 0, F.col("mu_iat_us") / F.lit(float(US))).otherwise(F.lit(0.0)),
        "std_iat": F.when(m > 0, F.sqrt(F.greatest(F.col("m2_iat") / m, F.lit(0.0))) / F.lit(float(US)))
                    .otherwise(F.lit(0.0)),
        "pkts_per_sec": None, "bytes_per_sec": None,
        "uncommon_port": uncommon_port("dst_port"),
        "dst_ip_entropy": F.col("dst_ip_entropy"),
        "segment_id": F.col("segment_id"), "seq": F.col("seq"),
    }
    duration = F.when(F.col("total_packets") > 1, dur).otherwise(F.lit(0.0))
    cols["pkts_per_sec"] = safe_rate("total_packets", duration)
    cols["bytes_per_sec"] = safe_rate("total_bytes", duration)
    return stats.select(*[cols[c].alias(c) for c in FLOW_COLUMNS])


def flow_extract(packets: DataFrame, chunk_packets: int = DEFAULT_CHUNK_PACKETS,
                 window_s: int = ENTROPY_WINDOW_S, slices_per_window: int = 1, capture_order: bool = False) -> DataFrame:
    """A1 (flagship): IP packets -> one row per (segment, directed 5-tuple).

    ``fwd_* = total`` and ``bwd_* = 0``: the key is the directed 5-tuple, so a reply is its
    own flow.  ``capture_order`` is for captures whose time may go back (see ``dst_ip_entropy``).
    """
    stats = flow_stats(filter_ip(packets), chunk_packets)
    return assemble_flows(dst_ip_entropy(stats, window_s, slices_per_window=slices_per_window, capture_order=capture_order))


def capture_summary(packets: DataFrame) -> DataFrame:
    """Per segment — total packets (non-IP included), IP packets, raw flow count."""
    ip_key = F.when(F.col("is_ip"), F.struct(*[F.col(c) for c in FIVE_TUPLE]))
    return (packets.groupBy("segment_id")
            .agg(F.count(F.lit(1)).alias("total_packets"),
                 F.count_if(F.col("is_ip")).alias("ip_packets"),
                 F.count_distinct(ip_key).alias("raw_flows")))


def shannon_entropy(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """A6 in group form: entropy (base 2) of the multiset of ``value_col`` per group.

    Two partial aggregations (value counts, then per group), no collect_list.
    """
    counts = df.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c"))
    return (counts.groupBy(*group_cols)
            .agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log2("_c")).alias("_s"),
                 F.count(F.lit(1)).alias("_k"))
            .select(*group_cols,
                    F.when(F.col("_k") <= 1, F.lit(0.0))
                    .otherwise(F.greatest(F.log2("_n") - F.col("_s") / F.col("_n"), F.lit(0.0)))
                    .alias("entropy")))
