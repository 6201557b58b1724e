"""The monitoring queries over the labelled flow table (one DataFrame per endpoint).

* ``kpis``        — A9 + P19 (+ J6 ``kpi_with_scores``)
* ``flows_page``  — F5 + F6 -> A11 -> O1 (filter, count, sort, page)
* ``timeline``    — A24 -> W5 -> A10 -> W6 (equal-width buckets, gap fill)
* ``events_feed`` — W7 status changes U2 the "anomalous flows" line -> W9
* ``models``      — A23 evaluation rows -> map
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (anomaly_score, fixed_text, format_bytes, fround, is_attack, label_display, proto_name,
                               tod_from_seconds, utc_timestamp)
from ..operators.ordered import CHUNK_ROWS, chunked_lag, count_chunks, idiv
from ..schemas import (PAGE_DEFAULT, PAGE_MAX, TIMELINE_EMPTY_ROWS, TIMELINE_MAX_BINS,
                       TIMELINE_MIN_BINS, US)


def prepare(flows: DataFrame) -> DataFrame:
    """What the API does on load: numeric proto -> name (P4), start timestamp (P5),
    anomaly score (P11)."""
    df = flows
    if "proto" in df.columns and isinstance(df.schema["proto"].dataType, T.NumericType):
        df = df.withColumn("proto", proto_name("proto"))
    if "start_time" in df.columns:
        df = df.withColumn("start_us", F.round(F.col("start_time") * F.lit(float(US))).cast("long"))
        df = df.withColumn("start_time_dt", F.timestamp_micros("start_us"))
    if "dst_ip_entropy" in df.columns:
        df = df.withColumn("anomaly_score", anomaly_score("dst_ip_entropy",
                                                          "label" if "label" in df.columns else None))
    return df


def kpis(flows: DataFrame) -> DataFrame:
    """One row — mean pkts/s (1 dp), total bytes, flow count, attack count (NULL label
    counts as attack), detection rate % (1 dp), mean anomaly score (3 dp).  Missing columns
    give 0; an empty table gives all zeros."""
    df = prepare(flows)
    cols = set(df.columns)
    aggs = [F.count(F.lit(1)).alias("n"),
            (F.avg("pkts_per_sec") if "pkts_per_sec" in cols else F.lit(None).cast("double")).alias("pps"),
            (F.sum("total_bytes") if "total_bytes" in cols else F.lit(None).cast("long")).alias("bytes"),
            (F.count_if(is_attack("label")) if "label" in cols else F.lit(0).cast("long")).alias("att"),
            (F.avg("anomaly_score") if "anomaly_score" in cols else F.lit(None).cast("double")).alias("an")]
    a = df.agg(*aggs)
    n = F.col("n")
    return a.select(
        fround(F.coalesce(F.col("pps"), F.lit(0.0)), 1).alias("avg_throughput_pkts"),
        F.coalesce(F.col("bytes"), F.lit(0)).cast("long").alias("total_bytes"),
        n.alias("active_flows"),
        F.col("att").cast("long").alias("flagged_flows"),
        fround(F.coalesce(F.col("an"), F.lit(0.0)), 3).alias("avg_anomaly_score"),
        F.when(n > 0, fround(F.col("att") / n * F.lit(100.0), 1)).otherwise(F.lit(0.0)).alias("detection_rate"))


def kpi_with_scores(flows: DataFrame, evaluation: DataFrame, as_map: bool = False) -> DataFrame:
    """The KPI row with each model's F1 (4 dp).  Long form: one row per model (a
    cross join of a 1-row frame with the small evaluation table); ``as_map`` gives the
    API's single row with ``f1_scores map<string,double>``."""
    k = kpis(flows)
    scores = evaluation.select("model", fround(F.coalesce(F.col("f1_score"), F.lit(0.0)), 4).alias("f1_score"))
    if as_map:
        m = scores.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "f1_score"))))
                       .alias("f1_scores"))
        return k.crossJoin(F.broadcast(m))
    return k.crossJoin(scores)


def search_regex(q: str) -> Column:
    """case-insensitive regex 'contains' over IPs, ports and protocol name."""
    q = q.lower()
    cols = [F.lower(F.col("src_ip")), F.lower(F.col("dst_ip")), F.col("src_port").cast("string"),
            F.col("dst_port").cast("string"), F.lower(F.col("proto"))]
    cond = None
    for c in cols:
        m = F.coalesce(c.rlike(q), F.lit(False))
        cond = m if cond is None else (cond | m)
    return cond


def search_literal(q: str) -> Column:
    """the client's literal substring filter: the query is lower-cased, of the columns only the protocol name."""
    q = q.lower()
    cols = [F.col("src_ip"), F.col("dst_ip"), F.col("src_port").cast("string"),
            F.col("dst_port").cast("string"), F.lower(F.col("proto"))]
    cond = None
    for c in cols:
        m = F.coalesce(c.contains(q), F.lit(False))
        cond = m if cond is None else (cond | m)
    return cond


def proto_filter(df: DataFrame, proto: str) -> Column:
    """``proto == name`` on the name, or on the stored number so it reaches the scan."""
    if "proto" in df.columns and isinstance(df.schema["proto"].dataType, T.NumericType):
        from ..schemas import PROTO_NAMES, PROTO_OTHER
        nums = [n for n, name in PROTO_NAMES.items() if name == proto]
        if nums:
            return F.col("proto").isin(*nums)
        if proto == PROTO_OTHER:
            return ~F.col("proto").isin(*PROTO_NAMES) | F.col("proto").isNull()
        return F.lit(False)
    return F.col("proto") == proto


def filter_eq(df: DataFrame, proto: str = "", label: str = "") -> DataFrame:
    """optional equality filters; an empty string means no filter.  Applied before the
    protocol number is turned into a name, so both predicates are pushed to the scan."""
    if proto:
        df = df.where(proto_filter(df, proto))
    if label:
        df = df.where(F.col("label") == label)
    return df


def flows_page(flows: DataFrame, proto: str = "", label: str = "", search: str = "",
               sort_col: str = "total_packets", sort_dir: str = "desc", limit: int = PAGE_DEFAULT) -> DataFrame:
    """O1 (GET /api/flows): filter, count, sort (nulls last), first ``limit`` rows.

    Adds ``total`` and ``filtered`` counts (A11); with no hit the one row has only them.  Unknown sort column keeps
    capture order; ties are broken by (segment_id, seq) so a page is deterministic.
    """
    if limit < 0 or limit > PAGE_MAX:
        raise ValueError(f"limit must be in 0..{PAGE_MAX}")
    df = prepare(flows)
    cond = F.lit(True)
    if proto:
        cond = cond & (F.col("proto") == proto)
    if label:
        cond = cond & (F.col("label") == label)
    if search:
        cond = cond & search_regex(search)
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(cond).alias("filtered"))
    # the page itself: equality filters first on the stored columns (pushed to the scan)
    page = prepare(filter_eq(flows, proto, label))
    if search:
        page = page.where(search_regex(search))
    ties = [F.col("segment_id").asc(), F.col("seq").asc()]
    if sort_col in page.columns:
        c = F.col(sort_col)
        key = c.asc_nulls_last() if sort_dir == "asc" else c.desc_nulls_last()
        page = page.orderBy(key, *ties)
    else:
        page = page.orderBy(*ties)
    # from the counts' side: a page without a hit is one row with the counts and null flow columns
    page = page.limit(limit)
    return counts.join(F.broadcast(page), how="left").select(*page.columns, *counts.columns)


def flow_counts(flows: DataFrame, proto: str = "", label: str = "", search: str = "") -> DataFrame:
    """``total`` and ``filtered`` in one aggregate pass."""
    df = prepare(flows)
    cond = F.lit(True)
    if proto:
        cond = cond & (F.col("proto") == proto)
    if label:
        cond = cond & (F.col("label") == label)
    if search:
        cond = cond & search_regex(search)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(cond).alias("filtered"))


def time_span(flows: DataFrame) -> DataFrame:
    """Min, max and span (s) of the start time."""
    df = prepare(flows)
    return df.agg(F.min("start_us").alias("min_us"), F.max("start_us").alias("max_us")).select(
        "min_us", "max_us", ((F.col("max_us") - F.col("min_us")) / F.lit(float(US))).alias("span_s"))


def _bins(span: Column) -> Column:
    b = F.when(span < 60, F.greatest(F.lit(TIMELINE_MIN_BINS), F.floor(span).cast("int") + 1)) \
        .otherwise(F.least(F.lit(TIMELINE_MAX_BINS), F.floor(span).cast("int")))
    return F.greatest(b, F.lit(2))


def with_bucket(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pd.cut(start, bins)`` bucket index in exact integer arithmetic.

    Right-closed equal-width bins with the lowest edge widened; all-equal starts fall in
    bin 4 of 10.  Returns (rows with ``bucket``, 1-row stats with ``bins``)."""
    df = prepare(flows)
    st = time_span(flows).withColumn("bins", _bins(F.col("span_s")))
    j = df.crossJoin(F.broadcast(st))
    num = (F.col("start_us") - F.col("min_us")) * F.col("bins")
    den = F.col("max_us") - F.col("min_us")
    ceil = idiv(num + den - F.lit(1), den)
    bucket = F.when(den == 0, F.lit(4)).otherwise(F.greatest(ceil - 1, F.lit(0)))
    return j.withColumn("bucket", bucket.cast("int")), st


def timeline(flows: DataFrame, now_s: float | None = None) -> DataFrame:
    """A10 + W6 (GET /api/flows/timeline): per bucket the mean start time as HH:MM:SS,
    mean pkts/s (1 dp) and mean anomaly score (3 dp).  Empty buckets get 0 / 0 and the
    previous label plus ``k * floor(max(1, span / bins))`` seconds.  No flows: 30 zero rows
    labelled with the 30 seconds before ``now_s``."""
    b, st = with_bucket(flows)
    # the mean of the offsets: absolute microseconds summed as doubles would lose digits
    per = b.groupBy("bucket").agg((F.avg(F.col("start_us") - F.col("min_us")) + F.first("min_us")).alias("_mu"), F.avg("pkts_per_sec").alias("_pps"),
                                  F.avg("anomaly_score").alias("_an"))
    grid = st.where(F.col("min_us").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bucket"),
        F.floor(F.greatest(F.lit(1.0), F.col("span_s") / F.col("bins"))).cast("long").alias("_step"))
    g = grid.join(F.broadcast(per), "bucket", "left")
    sec = F.floor(F.col("_mu") / F.lit(float(US))).cast("long")
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = (g.withColumn("_sec", sec)
         .withColumn("_last_sec", F.last("_sec", ignorenulls=True).over(w))
         .withColumn("_last_b", F.last(F.when(F.col("_mu").isNotNull(), F.col("bucket")), ignorenulls=True).over(w)))
    label_sec = F.when(F.col("_mu").isNotNull(), F.col("_sec")).otherwise(
        F.col("_last_sec") + (F.col("bucket") - F.col("_last_b")) * F.col("_step"))
    out = g.select(
        "bucket",
        tod_from_seconds(label_sec).alias("label"),
        F.when(F.col("_mu").isNotNull(), fround(F.coalesce(F.col("_pps"), F.lit(0.0)), 1))
        .otherwise(F.lit(0.0)).alias("pkts"),
        F.when(F.col("_mu").isNotNull(), fround(F.coalesce(F.col("_an"), F.lit(0.0)), 3))
        .otherwise(F.lit(0.0)).alias("anomaly"))
    if now_s is None:
        return out
    empty = st.where(F.col("min_us").isNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(TIMELINE_EMPTY_ROWS - 1))).alias("bucket"))
    empty = empty.select(
        "bucket",
        tod_from_seconds(F.floor(F.lit(float(now_s)) - (F.lit(TIMELINE_EMPTY_ROWS) - F.col("bucket"))))
        .alias("label"), F.lit(0.0).alias("pkts"), F.lit(0.0).alias("anomaly"))
    return out.unionByName(empty)


def status_changes(df: DataFrame, key: str = "src_ip", status: str = "label",
                   order: tuple[str, ...] = ("start_us", "segment_id", "seq"),
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows whose status differs from the previous row of the same key.

    A key's rows are ordered in chunks of about ``chunk_rows`` rows, cut by the key's own
    histogram over time, so a hot key is spread over many tasks (``chunked_lag`` carries
    the last status from chunk to chunk).  Returns the rows with ``prev_status``.
    """
    d = prepare(df) if "start_us" not in df.columns else df
    d = count_chunks(d.where(F.col(key).isNotNull()), [key], order[0], "_slice", chunk_rows)
    lagged = chunked_lag(d, [key], "_slice", list(order), status, "prev_status")
    return lagged.where(F.col("prev_status").isNotNull() & ~F.col(status).eqNullSafe(F.col("prev_status"))) \
        .drop("_slice")


def change_events(df: DataFrame, key: str = "src_ip") -> DataFrame:
    """W7 as ``events_log(t, level, msg)``: attack onset = ``attack``, back to NORMAL =
    ``ok``, attack to attack = ``warn``."""
    ch = status_changes(df, key)
    lvl = (F.when(is_attack("label") & ~is_attack("prev_status"), F.lit("attack"))
           .when(~is_attack("label"), F.lit("ok")).otherwise(F.lit("warn")))
    msg = F.concat(F.col(key), F.lit(" · "), F.col("prev_status"), F.lit(" → "), F.coalesce(F.col("label"), F.lit("NULL")))
    return ch.select(F.col("start_time_dt").alias("t"), lvl.alias("level"), msg.alias("msg"))


def attack_event(flows: DataFrame, now: str) -> DataFrame:
    """``ML inference · N anomalous flows detected`` at ``now`` if N > 0."""
    n = flows.agg(F.count_if(is_attack("label")).alias("n"))
    return n.where(F.col("n") > 0).select(
        utc_timestamp(now).alias("t"), F.lit("attack").alias("level"),
        F.format_string("ML inference · %d anomalous flows detected", F.col("n")).alias("msg"))


def recent_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """The last ``limit`` events by time (top-k, no global window), oldest first."""
    if limit < 0 or limit > PAGE_MAX:
        raise ValueError(f"limit must be in 0..{PAGE_MAX}")
    return events.orderBy(F.col("t").desc(), F.col("msg").desc()).limit(limit)


def events_feed(flows: DataFrame, now: str, limit: int = 100, history: DataFrame | None = None) -> DataFrame:
    """U2 (GET /api/events): status changes (or a given history) + the attack line, then
    the last ``limit``."""
    hist = history if history is not None else change_events(flows)
    return recent_events(hist.unionByName(attack_event(flows, now)), limit)


def models(evaluation: DataFrame) -> DataFrame:
    """A23 (GET /api/models): evaluation rows -> one row ``map<model, metrics>``."""
    v = F.struct(*[F.col(c) for c in evaluation.columns if c != "model"])
    return evaluation.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", v)))).alias("models"))


def empty_flows(spark: SparkSession) -> DataFrame:
    from ..schemas import LABELED_FLOWS
    return spark.createDataFrame([], LABELED_FLOWS)


def flow_display(prepared: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The display row of each prepared flow (after ``keep``): attack flag, label with its first underscore as a
    space, label class in lower case, numbers as texts of 1 / 0 / 1 / 2 decimals."""
    return prepared.select(
        *keep, is_attack("label").alias("attack_row"), "src_ip", "src_port", "dst_ip", "dst_port", "proto", "total_packets",
        format_bytes("total_bytes").alias("bytes_text"), fixed_text("pkts_per_sec", 1).alias("pkts_per_sec"),
        fixed_text("bytes_per_sec", 0).alias("bytes_per_sec"), F.concat(fixed_text("duration", 1), F.lit("s")).alias("duration"),
        fixed_text("dst_ip_entropy", 2).alias("dst_ip_entropy"), label_display("label").alias("label_text"),
        F.regexp_replace(F.lower("label"), " ", "_").alias("label_class"))


def _page_order(page: DataFrame, column: str, descending: bool) -> list[Column]:
    key = F.lower(column) if dict(page.dtypes)[column] == "string" else F.col(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("segment_id"), F.col("seq")]


def sort_rows(page: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """O2: rows by any column, strings without regard to case, nulls last, ties by (segment_id, seq)."""
    return page.orderBy(*_page_order(page, column, descending))


def numbered(page: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """The rows of one page (at most 500) with their place ``pos`` in ``sort_rows`` order."""
    place = F.row_number().over(Window.orderBy(*_page_order(page, column, descending)))
    return page.withColumn("pos", place.cast("int"))
