"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Tables ``events``, ``labels``, ... are the driver's pre-registered views.  The SQL uses
the same integer arithmetic as the Spark adapter; every double result is rounded to
6 decimals in both engines.
"""

from __future__ import annotations

PACKETS = """
packets as (
  select t_us // 30000000 as segment_id, * from (
    select event_id as pkt_idx,
           (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000 + 1704067200000000 as t_us,
           value >= 1.0 as is_ip,
           '10.0.0.' || (user_id % 4) as src_ip,
           cast(case when event_type = 'error' then 0 else 40000 + user_id % 2 end as integer) as src_port,
           '10.0.1.' || (cast(json_extract(props, '$.k') as integer) % 3) as dst_ip,
           cast(case event_type when 'error' then 0 when 'purchase' then 53 when 'signup' then 1883
                when 'view' then 443 else case when cast(json_extract(props, '$.k') as integer) >= 90
                then 4444 else 80 end end as integer) as dst_port,
           cast(case event_type when 'error' then 1 when 'purchase' then 17 else 6 end as integer) as proto,
           cast(60 + cast(floor(value) as integer) as integer) as len
    from events))"""

FLOW_STATS = """
ip_pk as (
  select *, t_us - lag(t_us) over (partition by segment_id, src_ip, src_port, dst_ip, dst_port, proto
                                   order by pkt_idx) as iat
  from packets where is_ip),
st as (
  select segment_id, src_ip, src_port, dst_ip, dst_port, proto, min(pkt_idx) as seq,
         arg_min(t_us, pkt_idx) as t0, arg_max(t_us, pkt_idx) as t1,
         count(*) as n, cast(sum(len) as bigint) as bytes, avg(len) as mean_len,
         coalesce(stddev_pop(len), 0.0) as std_len, count(iat) as m,
         avg(iat) as mean_iat_us, stddev_pop(iat) as std_iat_us
  from ip_pk group by all),
ent_pairs as (
  select a.segment_id, a.seq, b.dst_ip, count(*) as c
  from st a join st b on a.segment_id = b.segment_id and a.src_ip = b.src_ip
   and b.seq <= a.seq and b.t0 >= a.t0 - 10000000
  group by all),
ent as (
  select segment_id, seq, 0.0 - sum((c / tot) * log2(c / tot)) as h
  from (select *, sum(c) over (partition by segment_id, seq) as tot from ent_pairs)
  group by all)"""

FLOWS_RAW = """
flows as (
  select st.src_ip, st.src_port, st.dst_ip, st.dst_port, st.proto,
         t0 / 1000000.0 as start_time, t1 / 1000000.0 as end_time,
         case when n > 1 then (t1 - t0) / 1000000.0 else 0.0 end as duration,
         n as total_packets, bytes as total_bytes, n as fwd_packets, cast(0 as bigint) as bwd_packets,
         bytes as fwd_bytes, cast(0 as bigint) as bwd_bytes,
         cast(mean_len as double) as mean_pkt_len, std_len as std_pkt_len,
         case when m > 0 then mean_iat_us / 1000000.0 else 0.0 end as mean_iat,
         case when m > 0 then std_iat_us / 1000000.0 else 0.0 end as std_iat,
         case when n > 1 and t1 > t0 then n / ((t1 - t0) / 1000000.0) else 0.0 end as pkts_per_sec,
         case when n > 1 and t1 > t0 then bytes / ((t1 - t0) / 1000000.0) else 0.0 end as bytes_per_sec,
         cast(case when dst_port in (80, 443, 22, 1883, 8080, 53) then 0 else 1 end as integer) as uncommon_port,
         ent.h as dst_ip_entropy, st.segment_id, st.seq, t0, t1
  from st join ent on st.segment_id = ent.segment_id and st.seq = ent.seq)"""

FIXTURE_LOG = """
attack_log(line_no, line) as (values
  (1, '2024-01-01T00:03:00Z,RECON_START,10.0.0.1,10.0.1.0'),
  (2, '2024-01-01T00:04:00Z,RECON_END,10.0.0.1,10.0.1.0'),
  (3, ''),
  (4, 'bad-time,RECON_START,10.0.0.1,10.0.1.0'),
  (5, '2024-01-01T00:10:00Z,BRUTEFORCE_END,10.0.0.2,10.0.1.1'),
  (6, '2024-01-01T00:11:00Z,C2_BEACON_START,10.0.0.3,10.0.1.2'),
  (7, '2024-01-01T00:12:00Z,EXFIL_RANSOMWARE_START,10.0.0.3,10.0.1.2'),
  (8, '2024-01-01T00:12:30Z,EXFIL_RANSOMWARE_START,10.0.0.3,10.0.1.2'),
  (9, '2024-01-01T00:13:00Z,EXFIL_RANSOMWARE_END,10.0.0.3,10.0.1.2'),
  (10, '2024-01-01T00:14:00Z,C2_BEACON_END,10.0.0.3,10.0.1.2'),
  (11, '2024-01-01T00:15:00Z,EXFIL_RANSOMWARE_END,10.0.0.3,10.0.1.2'),
  (12, '2024-01-01T00:20:00Z,BRUTEFORCE_START,10.0.0.2,10.0.1.1'),
  (13, '2024-01-01T00:22:00Z,BRUTEFORCE_END,10.0.0.2,10.0.1.1'),
  (14, '2024-01-01T00:40:00Z,RECON_START,10.0.0.1,10.0.1.0'),
  (15, '2024-01-01T00:41:00Z,RECON_END,10.0.0.1'))"""

DERIVED_LOG = """
attack_log as (
  select event_id as line_no,
    case when event_type = 'view' and value < 2 then ''
         when event_type = 'error' and value < 3 then concat_ws(',', 'bad-time', ev, src, dst)
         when event_type = 'click' and value < 3 then concat_ws(',', tstext, ev, src)
         else concat_ws(',', tstext, ev, src, dst) end as line
  from (
    select *,
      strftime(to_timestamp(((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000
               + 1704067200000000) // 1000000), '%Y-%m-%dT%H:%M:%SZ') as tstext,
      (['RECON', 'BRUTEFORCE', 'C2_BEACON', 'EXFIL_RANSOMWARE'])[cast(json_extract(props, '$.k') as integer) % 4 + 1]
        || case when user_id % 2 = 0 then '_START' else '_END' end as ev,
      '10.0.0.' || (user_id % 4) as src,
      '10.0.1.' || (cast(json_extract(props, '$.k') as integer) % 3) as dst
    from events))"""

# Parse + LIFO pairing (stack semantics written directly as a recursive walk per base).
LOG_EVENTS = """
log_lines as (
  select line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as l from attack_log),
log_parts as (
  select line_no, string_split(l, ',') as p from log_lines where l <> ''),
log_ev as (
  select line_no, p[2] as event,
         epoch_us(try_strptime(p[1], '%Y-%m-%dT%H:%M:%SZ')) as ts_us,
         p[3] as src, p[4] as dst
  from log_parts where len(p) >= 4 and try_strptime(p[1], '%Y-%m-%dT%H:%M:%SZ') is not null),
log_typed as (
  select line_no, ts_us, src, dst,
         case when contains(event, '_') then regexp_replace(event, '_[^_]*$', '') else event end as base,
         ends_with(event, '_END') as is_end
  from log_ev)"""

# Stack pairing by depth: depth after each event is the running sum reflected at zero; a
# START at depth L is closed by the next event at level L when that event is an END.
INTERVALS = """
depth as (
  select *, s - least(min(s) over w, 0) as d
  from (select *, sum(case when is_end then -1 else 1 end) over w as s from log_typed
        window w as (partition by base order by line_no rows between unbounded preceding and current row))
  window w as (partition by base order by line_no rows between unbounded preceding and current row)),
lvl as (
  select *, case when is_end then coalesce(lag(d) over (partition by base order by line_no), 0)
                 else d end as level,
         min(line_no) over (partition by base) as base_line
  from depth),
paired as (
  select *, lead(is_end) over (partition by base, level order by line_no) as nxt_end,
            lead(ts_us) over (partition by base, level order by line_no) as nxt_ts
  from lvl where level >= 1),
intervals as (
  select base as name, ts_us as start_us, nxt_ts as end_us, base_line, line_no as start_line
  from paired where not is_end and nxt_end)"""


def with_ctes(*parts: str, body: str) -> str:
    return "with " + ",".join(p.strip("\n") for p in parts) + "\n" + body


def r6(expr: str, alias: str | None = None, digits: int = 6) -> str:
    """Same rounding steps as the Spark side: floor(x * 10^d + 0.5) / 10^d."""
    scale = f"{10 ** digits}.0"
    return f"floor(({expr}) * {scale} + 0.5) / {scale} as {alias or expr}"


FLOW_OUT_COLS = ", ".join(
    r6(c) if c in ("start_time", "end_time", "duration", "mean_pkt_len", "std_pkt_len", "mean_iat",
                   "std_iat", "pkts_per_sec", "bytes_per_sec", "dst_ip_entropy") else c
    for c in ("src_ip", "src_port", "dst_ip", "dst_port", "proto", "start_time", "end_time", "duration",
              "total_packets", "total_bytes", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes",
              "mean_pkt_len", "std_pkt_len", "mean_iat", "std_iat", "pkts_per_sec", "bytes_per_sec",
              "uncommon_port", "dst_ip_entropy", "segment_id", "seq"))


LABELED = """
labeled as (
  select f.*, coalesce((select i.name from intervals i where i.start_us <= f.t1 and i.end_us >= f.t0
                        order by i.base_line, i.start_line limit 1), 'NORMAL') as label
  from flows f)"""

PREP = """
prep as (
  select *, case proto when 6 then 'TCP' when 17 then 'UDP' when 1 then 'ICMP' else 'OTHER' end as proto_name,
         t0 as start_us, make_timestamp(t0) as start_time_dt,
         case when label is distinct from 'NORMAL' then dst_ip_entropy * 0.12
              else dst_ip_entropy * 0.02 end as anomaly_score
  from labeled)"""

# Everything up to the prepared labelled flow table.
LABELED_CHAIN = (PACKETS, FLOW_STATS, FLOWS_RAW, FIXTURE_LOG, LOG_EVENTS, INTERVALS, LABELED, PREP)
DERIVED_LOG_CHAIN = (DERIVED_LOG, LOG_EVENTS)

FEATURE_LIST = ("duration", "total_packets", "total_bytes", "fwd_packets", "bwd_packets", "fwd_bytes",
                "bwd_bytes", "mean_pkt_len", "std_pkt_len", "mean_iat", "std_iat", "pkts_per_sec",
                "bytes_per_sec", "uncommon_port", "dst_ip_entropy")

CLASS_PRED = """
cp_raw as (
  select vec_id, label,
         list_transform(range(10), lambda c: cast(((vec_id * 7 + c * 13) % 23)
                        + case when c = label then 10 else 0 end as double)) as s
  from embeddings),
cpred as (
  select 'class_rule' as model, vec_id as row_id, 'C' || label as label,
         'C' || (list_position(s, list_max(s)) - 1) as prediction,
         list_transform(s, lambda x: x / list_sum(s)) as probability
  from cp_raw)"""

FLOW_PRED = """
fpred as (
  select 'port_rule' as model, segment_id, seq, y, uncommon_port as yhat, cast(uncommon_port as double) as score
  from (select *, case when label is not distinct from 'NORMAL' then 0 else 1 end as y from labeled)
  union all
  select 'entropy_rule', segment_id, seq, y, cast(dst_ip_entropy > 1.0 as integer),
         floor(dst_ip_entropy * 1000000000.0 + 0.5) / 1000000000.0
  from (select *, case when label is not distinct from 'NORMAL' then 0 else 1 end as y from labeled)),
fpred2 as (
  select *, case when y = 1 then 'ATTACK' else 'NORMAL' end as label,
            case when yhat = 1 then 'ATTACK' else 'NORMAL' end as prediction from fpred)"""


def auc_sql(src: str, keys: str, y: str = "y", score: str = "score") -> str:
    """Exact AUC per ``keys`` over table ``src`` (ties count 1/2)."""
    return f"""(
  select {keys}, case when sum(pos) > 0 and sum(neg) > 0
                 then sum(pos * (negb + neg * 0.5)) / (sum(pos) * sum(neg)) end as roc_auc
  from (select *, coalesce(sum(neg) over (partition by {keys} order by sc
                   rows between unbounded preceding and 1 preceding), 0) as negb
        from (select {keys}, {score} as sc, count(*) filter (where {y} = 1) as pos,
                     count(*) filter (where {y} <> 1) as neg
              from {src} group by all))
  group by all)"""


def f1w_sql(src: str, keys: str) -> str:
    """Support-weighted F1 per ``keys`` (label / prediction columns)."""
    return f"""(
  select {keys}, case when sum(support) > 0 then sum(support * case when support + predicted > 0
                 then cast(2 as double) * tp / (support + predicted) else 0.0 end) / sum(support)
                 else 0.0 end as f1_weighted
  from (select {keys}, cls, sum(sup) as support, sum(prd) as predicted, sum(tp) as tp
        from (select {keys}, label as cls, n as sup, 0 as prd, case when label = prediction then n else 0 end as tp
              from (select {keys}, label, prediction, count(*) as n from {src} group by all)
              union all
              select {keys}, prediction, 0, n, 0
              from (select {keys}, label, prediction, count(*) as n from {src} group by all))
        group by all)
  group by all)"""


def grid_sql(src: str, keys: str) -> str:
    """Zero-filled k x k grid of the sorted true classes per ``keys``."""
    return f"""(
  select t.{keys}, t.cls as true_label, p.cls as pred_label, t.idx as true_idx, p.idx as pred_idx,
         coalesce(c.n, 0) as count
  from (select {keys}, cls, cast(row_number() over (partition by {keys} order by cls) - 1 as integer) as idx
        from (select distinct {keys}, label as cls from {src} where label is not null)) t
  join (select {keys}, cls, cast(row_number() over (partition by {keys} order by cls) - 1 as integer) as idx
        from (select distinct {keys}, label as cls from {src} where label is not null)) p on t.{keys} = p.{keys}
  left join (select {keys}, label, prediction, count(*) as n from {src} group by all) c
    on c.{keys} = t.{keys} and c.label = t.cls and c.prediction = p.cls)"""


def fpr_sql(grid: str, keys: str) -> str:
    return f"""(
  select {keys}, case when max(true_idx) = 1 and sum(count) filter (where true_idx = 0) > 0
         then (sum(count) filter (where true_idx = 0 and pred_idx = 1))
              / (sum(count) filter (where true_idx = 0)) end as false_positive_rate
  from {grid} group by all)"""


def matrix_text_sql(grid: str, keys: str) -> str:
    return f"""(
  select {keys}, '[' || string_agg(r, ', ' order by true_idx) || ']' as confusion_matrix
  from (select {keys}, true_idx, '[' || string_agg(cast(count as varchar), ', ' order by pred_idx) || ']' as r
        from {grid} group by all)
  group by all)"""
