"""First-ranked interval overlapping each flow, for interval lists of any size.

The list is turned into the step function g(t) = first-ranked interval active at time t, which has at most two steps for
each interval.  An interval runs over a range of step numbers; the range is written as at most two nodes a level of a
binary tree over the numbers, so a year-long interval costs as many rows as its logarithm, and a step's value is the
minimum over its ancestors.  Steps are then laid into time chunks (an array of the steps of a chunk, and the minimum of
every aligned run of chunks); a flow reads the chunk where it starts and the one where it ends, and aligned runs for
what lies between.  No (flow, interval) pair is ever formed.

Two odd cases are kept exact by an equi-join on tree nodes: intervals whose END is earlier than their START (they match
flows that hold both times), and flows that end before they start (they match intervals that hold both times).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import US
from ..session import cut_lineage

#: Steps that a time chunk should hold, and the longest chunk.  Attack logs have whole seconds, so a chunk never holds
#: more than two steps a second, however the intervals are spread.
CHUNK_STEPS = 64
MAX_CHUNK_S = 1024
MAX_LEVELS = 62


@dataclass(frozen=True)
class ListSize:
    """Interval count, mean length (µs), time range (µs) and number of intervals that end before they start."""
    n: int
    mean_us: float
    lo: int
    hi: int
    backward: int


def measure(intervals: DataFrame) -> ListSize:
    length = (F.col("end_us") - F.col("start_us")).cast("double")
    s = intervals.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean"),
                      F.min(F.least("start_us", "end_us")).alias("lo"), F.max(F.greatest("start_us", "end_us")).alias("hi"),
                      F.count_if(F.col("end_us") < F.col("start_us")).alias("backward")).first()
    return ListSize(s["n"], s["mean"] or 0.0, s["lo"] or 0, s["hi"] or 0, s["backward"])


def _node(k: Column, at: Column) -> Column:
    return F.struct(k.cast("int").alias("k"), at.cast("long").alias("node"))


def range_nodes(lo: Column, end: Column, levels: int) -> Column:
    """The aligned nodes (k, node) that together are [lo, end): at most two a level, none if the range is empty."""
    def at(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        # positions may be negative; an arithmetic shift is a floor
        left, right = _shift(lo + width - 1, k), _shift(end, k)
        some = left < right
        return F.array(F.when(some & (F.pmod(left, F.lit(2)) == 1), _node(k, left)),
                       F.when(some & (F.pmod(right, F.lit(2)) == 1), _node(k, right - 1)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda x: x.isNotNull())


def ancestors(at: Column, levels: int) -> Column:
    """The nodes that hold a position, itself included."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: _node(k, _shift(at, k)))


def _shift(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x.cast("long"), k.cast("int"))


def _levels(n: int) -> int:
    return min(MAX_LEVELS, max(1, n).bit_length())


def steps(intervals: DataFrame, size: ListSize, chunk_us: int) -> DataFrame:
    """(t, next, best): the steps of g where an interval is active, best = struct(base_line, start_line, name)."""
    iv = intervals.where("end_us >= start_us").select(
        "start_us", (F.col("end_us") + 1).alias("stop_us"), F.struct("base_line", "start_line", "name").alias("iv"))
    times = iv.select(F.col("start_us").alias("t")).unionByName(iv.select(F.col("stop_us").alias("t"))).distinct()
    part = F.floor((F.col("t") - F.lit(size.lo)) / F.lit(chunk_us)).cast("long")
    local = Window.partitionBy("part").orderBy("t")
    numbered = times.select("t", part.alias("part")).select(
        "t", "part", F.row_number().over(local).alias("r"), F.lead("t").over(local).alias("next"))
    # one row a part: its first time and number of times
    parts = numbered.groupBy("part").agg(F.count("*").alias("c"), F.min("t").alias("first"))
    order = Window.orderBy("part")
    parts = parts.select("part", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                         .alias("before"), F.lead("first").over(order).alias("after"))
    times = cut_lineage(numbered.join(parts, "part").select(
        "t", (F.col("before") + F.col("r") - 1).alias("i"), F.coalesce("next", "after").alias("next")))
    start = times.select(F.col("t").alias("start_us"), F.col("i").alias("i0"))
    stop = times.select(F.col("t").alias("stop_us"), F.col("i").alias("i1"))
    levels = _levels(2 * size.n)
    cover = (iv.groupBy("start_us", "stop_us").agg(F.min("iv").alias("iv")).join(start, "start_us").join(stop, "stop_us")
             .select(F.explode(range_nodes(F.col("i0"), F.col("i1"), levels)).alias("x"), "iv")
             .groupBy("x").agg(F.min("iv").alias("iv")))
    return (times.select("t", "next", F.explode(ancestors(F.col("i"), levels)).alias("x")).join(cover, "x")
            .groupBy("t", "next").agg(F.min("iv").alias("best")))


def _chunk(t: Column, size: ListSize, chunk_us: int) -> Column:
    """Time chunk; -1 before the list's first time and one past the last chunk after its last."""
    c = F.floor((t - F.lit(size.lo)) / F.lit(chunk_us)).cast("long")
    return F.least(F.greatest(c, F.lit(-1)), F.lit((size.hi + 1 - size.lo) // chunk_us + 1))


def _odd_pairs(spans: DataFrame, intervals: DataFrame, size: ListSize, chunk_us: int, levels: int) -> list[DataFrame]:
    """Matches (flow key, iv) of flows that end before they start and of intervals that do."""
    def rows(df: DataFrame, nodes: Column) -> DataFrame:
        return df.select("*", F.explode(nodes).alias("x"))

    iv = intervals.select(F.col("start_us").alias("s"), F.col("end_us").alias("e"),
                          F.struct("base_line", "start_line", "name").alias("iv"))
    first, last = _chunk(F.col("s"), size, chunk_us), _chunk(F.col("e"), size, chunk_us)
    forward = rows(iv.where("e >= s"), range_nodes(first, last + 1, levels))
    turned = spans.where("t1 < t0")
    found = [rows(turned, ancestors(_chunk(F.col("t0"), size, chunk_us), levels)).join(forward, "x")]
    if size.backward:
        own = range_nodes(_chunk(F.col("t0"), size, chunk_us), _chunk(F.col("t1"), size, chunk_us) + 1, levels)
        found.append(rows(spans.where("t1 >= t0"), own).join(rows(iv.where("e < s"), ancestors(first, levels)), "x"))
    return [x.where("s <= t1 and e >= t0").select("flow", "iv") for x in found]


def first_match(spans: DataFrame, intervals: DataFrame, size: ListSize, chunk_s: float | None = None) -> DataFrame:
    """(flow, iv): the first-ranked interval that overlaps each of ``spans(flow, t0, t1)``; flows without one are left
    out.  ``iv`` is struct(base_line, start_line, name)."""
    span_us = size.hi - size.lo + 2
    chunk_us = int(chunk_s * US) if chunk_s else int(min(MAX_CHUNK_S * US, max(US, span_us * CHUNK_STEPS // (2 * size.n + 1))))
    levels = _levels(span_us // chunk_us + 1)
    g = cut_lineage(steps(intervals, size, chunk_us))
    touched = F.sequence(_chunk(F.col("t"), size, chunk_us), _chunk(F.col("next") - 1, size, chunk_us))
    by_chunk = g.select("t", "next", "best", F.explode(touched).alias("c")).groupBy("c").agg(
        F.collect_list(F.struct("t", "next", "best")).alias("steps"), F.min("best").alias("best"))
    by_chunk = cut_lineage(by_chunk)
    ends = by_chunk.select(F.struct(F.lit(-1).alias("k"), F.col("c").alias("node")).alias("x"), "steps",
                           F.lit(None).cast(by_chunk.schema["best"].dataType).alias("best"))
    runs = (by_chunk.select(F.explode(ancestors(F.col("c"), levels)).alias("x"), "best").groupBy("x")
            .agg(F.min("best").alias("best"))
            .select("x", F.lit(None).cast(by_chunk.schema["steps"].dataType).alias("steps"), "best"))
    table = ends.unionByName(runs)
    c0, c1 = _chunk(F.col("t0"), size, chunk_us), _chunk(F.col("t1"), size, chunk_us)
    edge = F.transform(F.array_distinct(F.array(c0, c1)), lambda c: _node(F.lit(-1), c))
    inside = F.when(c1 - c0 > 1, range_nodes(c0 + 1, c1, levels)).otherwise(F.array().cast("array<struct<k:int,node:bigint>>"))
    near = spans.where((F.col("t1") >= F.col("t0")) & (F.col("t1") >= size.lo) & (F.col("t0") <= size.hi))
    active = F.filter("steps", lambda s: (s["t"] <= F.col("t1")) & (s["next"] > F.col("t0")))
    met = near.select("flow", "t0", "t1", F.explode(F.concat(edge, inside)).alias("x")).join(table, "x").select(
        "flow", F.coalesce("best", F.array_min(F.transform(active, lambda s: s["best"]))).alias("iv"))
    for more in _odd_pairs(spans, intervals, size, chunk_us, levels):
        met = met.unionByName(more)
    return met.where("iv is not null").groupBy("flow").agg(F.min("iv").alias("iv"))


__all__ = ["first_match", "measure", "steps", "range_nodes", "ancestors", "ListSize"]
