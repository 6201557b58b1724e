"""Order-dependent building blocks that stay parallel when one key is hot.

A plain ``Window.partitionBy(key).orderBy(...)`` puts every row of a key into one task.
These helpers cut each key into ordered chunks (a column that is monotone in the order),
compute chunk totals with a partial aggregate, turn them into per-chunk offsets with a
window over the (small) chunk table, and finish inside (key, chunk) partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked_row_number(df: DataFrame, part: Sequence[str], chunk: str, order: Sequence[str | Column],
                       out: str = "rn") -> DataFrame:
    """``row_number() over (partition by part order by chunk, *order)`` computed per
    (part, chunk), plus the count of rows of earlier chunks of the same key.

    ``chunk`` must be non-decreasing along the order.
    """
    part = list(part)
    counts = df.groupBy(*part, chunk).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, chunk, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*part, chunk).orderBy(*order)
    return (df.withColumn("_rn_local", F.row_number().over(local))
            .join(offsets, [*part, chunk], "inner")
            .withColumn(out, (F.col("_off") + F.col("_rn_local")).cast("long"))
            .drop("_rn_local", "_off"))


#: Rows of one key that one task orders, and the time slots in which they are counted.
CHUNK_ROWS = 1 << 20
SLOTS = 1 << 16


def count_chunks(df: DataFrame, part: Sequence[str], time: str, out: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out``: chunks of each key, monotone in ``time`` (an integer column), of about ``rows`` rows each.

    The rows of every (key, time slot) are counted (a histogram of at most ``SLOTS`` slots a key); a slot belongs to the
    chunk that the rows of the key's earlier slots have filled.  A chunk exceeds ``rows`` by at most one slot.  ``df`` is
    read twice or more, so it should be stored."""
    part = list(part)
    ends = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if ends["lo"] is None or ends["n"] <= rows:
        return df.withColumn(out, F.lit(0).cast("long"))
    width = (ends["hi"] - ends["lo"]) // SLOTS + 1
    slot = F.coalesce(F.floor((F.col(time) - F.lit(ends["lo"])) / F.lit(width)), F.lit(-1)).cast("long")
    d = df.withColumn("_slot", slot)
    counts = d.groupBy(*part, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(rows)).cast("long")
    chunks = counts.select(*[F.col(c).alias(f"_r_{c}") for c in part], F.col("_slot").alias("_r_slot"), chunk.alias(out))
    on = [d[c].eqNullSafe(F.col(f"_r_{c}")) for c in part] + [d["_slot"] == F.col("_r_slot")]
    return d.join(chunks, on).drop("_slot", "_r_slot", *[f"_r_{c}" for c in part])


def running_sums(df: DataFrame, part: Sequence[str], chunk: str, order: Sequence[str | Column],
                 values: Sequence[str], inclusive: bool = True) -> DataFrame:
    """Running sums of ``values`` along (chunk, *order) per ``part`` (``cum_<v>`` columns).

    ``inclusive=False`` gives the sum of strictly earlier rows.
    """
    part = list(part)
    totals = df.groupBy(*part, chunk).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, chunk, *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0))
                                            .alias(f"_o_{v}") for v in values])
    end = Window.currentRow if inclusive else -1
    local = Window.partitionBy(*part, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    out = df
    for v in values:
        out = out.withColumn(f"_l_{v}", F.coalesce(F.sum(v).over(local), F.lit(0)))
    out = out.join(offsets, [*part, chunk], "inner")
    for v in values:
        out = out.withColumn(f"cum_{v}", F.col(f"_o_{v}") + F.col(f"_l_{v}")).drop(f"_o_{v}", f"_l_{v}")
    return out


def chunked_lag(df: DataFrame, part: Sequence[str], chunk: str, order: Sequence[str], value: str,
                out: str = "prev") -> DataFrame:
    """``lag(value) over (partition by part order by chunk, *order)`` without putting a
    whole key into one task: inside (part, chunk) a plain ``lag``; the first row of a chunk
    takes the last value of the nearest earlier non-empty chunk (from a per-chunk
    ``max_by`` table and a window over chunks)."""
    part = list(part)
    okey = F.struct(*[F.col(c) for c in order])
    last = df.groupBy(*part, chunk).agg(F.max_by(F.col(value), okey).alias("_last"))
    prev_chunk = last.select(*part, chunk, F.lag("_last").over(Window.partitionBy(*part).orderBy(chunk))
                             .alias("_carry"))
    local = Window.partitionBy(*part, chunk).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(local))
            .withColumn(out, F.lag(value).over(local))
            .join(prev_chunk, [*part, chunk], "inner")
            .withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col(out)))
            .drop("_rn", "_carry"))


def idiv(a: Column, b: Column) -> Column:
    """Exact floor division of BIGINTs (no double rounding)."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def chunked_lead(df: DataFrame, part: Sequence[str], chunk: str, order: Sequence[str], value: str,
                 out: str = "next") -> DataFrame:
    """``lead(value) over (partition by part order by chunk, *order)`` computed per
    (part, chunk); the last row of a chunk takes the first value of the nearest later
    non-empty chunk."""
    part = list(part)
    okey = F.struct(*[F.col(c) for c in order])
    first = df.groupBy(*part, chunk).agg(F.min_by(F.col(value), okey).alias("_first"))
    next_chunk = first.select(*part, chunk, F.lead("_first").over(Window.partitionBy(*part).orderBy(chunk))
                              .alias("_carry"))
    local = Window.partitionBy(*part, chunk).orderBy(*order)
    last = Window.partitionBy(*part, chunk).orderBy(*[F.col(c).desc() for c in order])
    return (df.withColumns({"_rl": F.row_number().over(last), out: F.lead(value).over(local)})
            .join(next_chunk, [*part, chunk], "inner")
            .withColumn(out, F.when(F.col("_rl") == 1, F.col("_carry")).otherwise(F.col(out)))
            .drop("_rl", "_carry"))
