"""Attack log -> intervals -> flow labels.

* ``parse_attack_log``  (S4, P20, P6, P7, F3): text lines -> typed events.
* ``attack_intervals``  (J2 / W4, F4): LIFO START/END pairing per attack name with window
  functions only (running depth, then the next event at the same depth).
* ``label_flows``        (J1): first matching interval in list order, else NORMAL.
  List order = attack names by their first valid line, then START order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import event_base, event_is_end, parse_log_ts
from ..schemas import NORMAL, SEGMENT_S, US
from ..session import cut_lineage
from . import cover
from .ordered import chunked_lead

# Largest bucketed interval list (one row per interval and bucket it covers) and bucket
# range that are broadcast as one dense array; above them the step function of cover.py is used.
# Bucket width: the mean interval length, at least one capture segment (a flow then covers
# at most two buckets) and at most one hour.
BROADCAST_INTERVAL_ROWS = 10_000
BROADCAST_BUCKET_RANGE = 100_000
MIN_BUCKET_S, MAX_BUCKET_S = SEGMENT_S, 3600


def parse_attack_log(log: DataFrame) -> DataFrame:
    """``attack_log(line_no, line)`` -> ``(line_no, ts_us, event, base, is_end, src, dst)``.

    Lines are stripped; blank lines, lines with fewer than four comma fields and lines
    whose timestamp is not ``%Y-%m-%dT%H:%M:%SZ`` are skipped.
    """
    stripped = F.regexp_replace(F.col("line"), r"^\s+|\s+$", "")
    parts = F.split(stripped, ",")
    p = log.select("line_no", stripped.alias("l"), parts.alias("p"))
    p = p.where((F.col("l") != "") & (F.size("p") >= 4))
    ts = parse_log_ts(F.col("p")[0])
    ev = p.select("line_no", ts.alias("ts"), F.col("p")[1].alias("event"),
                  F.col("p")[2].alias("src"), F.col("p")[3].alias("dst"))
    return (ev.where(F.col("ts").isNotNull())
            .select("line_no", F.unix_micros("ts").alias("ts_us"), "event",
                    event_base("event").alias("base"), event_is_end("event").alias("is_end"),
                    "src", "dst"))


# Lines per chunk of the pairing windows (a chunk is the unit one task orders).
PAIR_CHUNK_LINES = 1 << 20


def _step() -> Column:
    return F.when(F.col("is_end"), F.lit(-1)).otherwise(F.lit(1))


def _levels(ev: DataFrame, chunk_lines: int) -> DataFrame:
    """Events of several chunks with ``level`` (0 = stray END) and ``base_line``.

    Stack depth per attack name: ``s`` = running sum of +1 / -1 and ``d = s - min(0, running
    min of s)``.  Running sum and minimum are local to a (name, chunk); one row per chunk
    carries in the sum and minimum of earlier chunks and the depth that they end at.
    """
    chunk = F.floor(F.col("line_no") / F.lit(chunk_lines)).cast("long")
    part = Window.partitionBy("base", "_ch").orderBy("line_no")
    local = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.select("*", chunk.alias("_ch")).select("*", F.sum(_step()).over(local).alias("_sl"))
    # read twice from here on (chunk rows, then the events)
    ev = cut_lineage(ev.select("*", F.min("_sl").over(local).alias("_ml")))
    chunks = ev.groupBy("base", "_ch").agg(F.sum(_step()).alias("_t"), F.min("_sl").alias("_mc"),
                                           F.min("line_no").alias("_first"))
    order = Window.partitionBy("base").orderBy("_ch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("*", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_soff"))
    chunks = chunks.select("*", F.least(F.lit(0), F.min(F.col("_soff") + F.col("_mc")).over(before)).alias("_moff"))
    ends_at = F.col("_soff") + F.col("_t") - F.least("_moff", F.col("_soff") + F.col("_mc"))
    chunks = chunks.select("base", "_ch", "_soff", "_moff", F.coalesce(F.lag(ends_at).over(order), F.lit(0)).alias("_d0"),
                           F.min("_first").over(Window.partitionBy("base")).alias("base_line"))
    ev = ev.join(chunks, ["base", "_ch"])
    d = F.col("_soff") + F.col("_sl") - F.least("_moff", F.col("_soff") + F.col("_ml"))
    return ev.select("*", d.alias("_d")).select("*", F.when(F.col("is_end"), F.coalesce(F.lag("_d").over(part), "_d0"))
                                                .otherwise(F.col("_d")).alias("level"))


def _levels_at_once(ev: DataFrame) -> DataFrame:
    """The same for a log that is one chunk: everything from one sort by (name, line)."""
    name = Window.partitionBy("base").orderBy("line_no")
    local = name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.select("*", F.sum(_step()).over(local).alias("_s"), F.min("line_no").over(local).alias("base_line"))
    ev = ev.select("*", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(local))).alias("_d"))
    return ev.select("*", F.when(F.col("is_end"), F.coalesce(F.lag("_d").over(name), F.lit(0)))
                     .otherwise(F.col("_d")).alias("level"))


def attack_intervals(log: DataFrame, closed_only: bool = True, chunk_lines: int | None = None) -> DataFrame:
    """J2 via W4: ``(name, start_us, end_us, base_line, start_line, src, dst)``.

    Per attack name in line order the stack depth ``d`` is a running sum reflected at
    zero (stray ENDs are ignored).  A START sits at level ``d``; an END at the level of
    the row before it (0 = stray, dropped).  Among the rows of one (name, level) the row
    after a START is its closing END, if it is an END.  ``(base_line, start_line)`` is the
    reference's list order.  Never-closed STARTs are dropped unless ``closed_only=False``
    (then ``end_us`` is NULL).  A log of more than ``chunk_lines`` lines is paired per
    (name, chunk) with carries between chunks, so one very common attack name is still
    spread over many tasks.
    """
    chunk_lines = chunk_lines or PAIR_CHUNK_LINES
    ev = parse_attack_log(log)
    lines = log.agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi")).first()
    at_once = lines["lo"] is None or lines["lo"] // chunk_lines == lines["hi"] // chunk_lines
    at_level = (_levels_at_once(ev) if at_once else _levels(ev, chunk_lines)).where(F.col("level") >= 1).select(
        "*", F.struct("is_end", "ts_us").alias("_ev"))
    if at_once:
        paired = at_level.select("*", F.lead("_ev").over(Window.partitionBy("base", "level").orderBy("line_no"))
                                 .alias("_next"))
    else:
        paired = chunked_lead(at_level, ["base", "level"], "_ch", ["line_no"], "_ev", "_next")
    iv = paired.where(~F.col("is_end")).select(
        F.col("base").alias("name"), F.col("ts_us").alias("start_us"),
        F.when(F.col("_next.is_end"), F.col("_next.ts_us")).alias("end_us"),
        "base_line", F.col("line_no").alias("start_line"), "src", "dst")
    return iv.where(F.col("end_us").isNotNull()) if closed_only else iv


def _bucketed(iv: DataFrame, bucket_us: int) -> DataFrame:
    b0 = F.floor(F.col("start_us") / F.lit(bucket_us)).cast("long")
    b1 = F.floor(F.col("end_us") / F.lit(bucket_us)).cast("long")
    return iv.select(F.explode(F.sequence(b0, F.greatest(b0, b1))).alias("_b"),
                     F.struct(F.col("base_line"), F.col("start_line"), F.col("start_us"),
                              F.col("end_us"), F.col("name")).alias("_iv"))


def plan_label_join(intervals: DataFrame, bucket_s: float | None = None,
                    broadcast_rows: int = BROADCAST_INTERVAL_ROWS) -> tuple[str, int, cover.ListSize]:
    """Strategy, bucket width (µs) and size from one small aggregate over the intervals (count, mean length, time
    range).  Bucketed rows are estimated as ``n * (1 + mean / bucket)``."""
    size = cover.measure(intervals)
    if bucket_s is None:
        bucket_us = int(min(max(size.mean_us, MIN_BUCKET_S * US), MAX_BUCKET_S * US))
    else:
        bucket_us = int(bucket_s * US)
    est = size.n * (1.0 + size.mean_us / bucket_us)
    span = ((size.hi - size.lo) // bucket_us + 1) if size.n else 0
    small = est <= broadcast_rows and span <= BROADCAST_BUCKET_RANGE
    return ("broadcast" if small else "cover"), bucket_us, size


_IV_TYPE = "array<struct<base_line:bigint,start_line:bigint,start_us:bigint,end_us:bigint,name:string>>"


def label_flows(flows: DataFrame, intervals: DataFrame, bucket_s: float | None = None,
                broadcast_rows: int = BROADCAST_INTERVAL_ROWS, strategy: str | None = None,
                checkpointed: bool = False) -> DataFrame:
    """Add ``label`` = first interval in list order that overlaps the flow, else NORMAL.

    Overlap is closed at both ends: ``flow.start <= iv.end and flow.end >= iv.start``;
    the attack's src/dst are ignored, as in the reference.  Intervals are cut into time
    buckets.  A small bucketed list (checked by a bounded estimate) becomes one broadcast
    row holding a dense array indexed by bucket; each flow reads only the buckets it
    covers (O(1) access) — no shuffle of the flows, no nested loop over all intervals.
    A large list becomes the step function of its first-ranked active interval, which the
    flows read by time chunk (``cover``), so joined rows grow with flows and intervals and
    not with the pairs that overlap.
    """
    # the interval table is read twice (sizing, then the join): compute it once, unless the caller has
    intervals = intervals if checkpointed else cut_lineage(intervals)
    planned, bucket_us, size = plan_label_join(intervals, bucket_s, broadcast_rows)
    strategy = strategy or planned
    t0 = F.round(F.col("start_time") * F.lit(float(US))).cast("long")
    t1 = F.round(F.col("end_time") * F.lit(float(US))).cast("long")
    b = _bucketed(intervals, bucket_us)
    fb0 = F.floor(t0 / F.lit(bucket_us)).cast("long")
    fb1 = F.floor(t1 / F.lit(bucket_us)).cast("long")
    if strategy == "broadcast":
        per_bucket = b.groupBy("_b").agg(F.array_sort(F.collect_list("_iv")).alias("_ivs"))
        rng = per_bucket.agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
        grid = rng.select("_lo", F.explode(F.sequence("_lo", "_hi")).alias("_b"))
        dense = (grid.join(per_bucket, "_b", "left")
                 .groupBy("_lo").agg(F.array_sort(F.collect_list(F.struct("_b", "_ivs"))).alias("_e"))
                 .select("_lo", F.transform("_e", lambda e: F.coalesce(e["_ivs"], F.array().cast(_IV_TYPE)))
                         .alias("_dense")))
        def at(x):
            i = (x - F.col("_lo") + 1).cast("int")
            inside = (i >= 1) & (i <= F.size("_dense"))
            return F.when(inside, F.element_at(F.col("_dense"), F.when(inside, i).otherwise(F.lit(1))))\
                .otherwise(F.array().cast(_IV_TYPE))

        cand = F.flatten(F.transform(F.sequence(fb0, F.greatest(fb0, fb1)), at))
        hit = F.filter(cand, lambda iv: (iv["start_us"] <= t1) & (iv["end_us"] >= t0))
        j = flows.join(F.broadcast(dense), how="left")  # 1-row (or empty) build side
        return (j.withColumn("label", F.coalesce(F.array_min(hit)["name"], F.lit(NORMAL)))
                .drop("_dense", "_lo"))
    if not size.n:
        return flows.withColumn("label", F.lit(NORMAL))
    spans = flows.select(F.struct("segment_id", "seq").alias("flow"), t0.alias("t0"), t1.alias("t1"))
    first = cover.first_match(spans, intervals, size, bucket_s).select(
        F.col("flow.segment_id").alias("segment_id"), F.col("flow.seq").alias("seq"), F.col("iv.name").alias("_first"))
    return (flows.join(first, ["segment_id", "seq"], "left")
            .withColumn("label", F.coalesce("_first", F.lit(NORMAL))).drop("_first"))


def label_distribution(labeled: DataFrame) -> DataFrame:
    """``value_counts`` of ``label``, largest first."""
    return (labeled.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("label")))
