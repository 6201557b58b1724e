"""Writers of the pipeline tables (K1-K6).

Flow tables are Parquet partitioned by ``segment_id`` (K1, K3) or by ``batch`` and ``segment_id`` (K2): what one append
writes lies in partitions of its own, so a replay of the append replaces its own rows and no other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink_flows(flows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: overwrite the flow table (CSV with header, or Parquet)."""
    w = flows.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def append_flows(flows: DataFrame, path: str, batch: int | str = 0) -> None:
    """K2: add a batch of flows to the growing table.

    ``batch`` names the append (a micro-batch id, a segment run).  Its rows lie below ``batch=<name>``, so a segment that
    arrives in several batches keeps the rows of all of them, and writing the same batch again replaces, not
    duplicates, it.  An empty batch writes nothing.
    """
    (flows.withColumn("batch", F.lit(str(batch))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", "segment_id").parquet(path))


def sink_labeled(labeled: DataFrame, path: str, segments_only: bool = True) -> None:
    """K3: write labelled flows; with ``segments_only`` only the segments present in
    ``labeled`` are replaced (re-labelling after a log change touches only those)."""
    w = labeled.write.mode("overwrite").partitionBy("segment_id")
    if segments_only:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def sink_holdout(holdout: DataFrame, path: str) -> None:
    """K4: the test split with all columns."""
    holdout.write.mode("overwrite").parquet(path)


def sink_eval(evaluation: DataFrame, path: str, fmt: str = "json") -> None:
    """K6: evaluation rows; CSV cannot hold the nested matrix, so it is written as text
    ``[[a, b], [c, d]]`` there."""
    if fmt == "csv":
        from ..operators.metrics import matrix_text
        (evaluation.withColumn("confusion_matrix", matrix_text()).coalesce(1)
         .write.mode("overwrite").option("header", True).csv(path))
    else:
        evaluation.coalesce(1).write.mode("overwrite").format(fmt).save(path)


__all__ = ["sink_flows", "append_flows", "sink_labeled", "sink_holdout", "sink_eval"]
