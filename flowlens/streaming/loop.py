"""The composed live loop (T1, T2, T4, T5): segments -> flows -> labels -> models -> evaluations.

One ``foreachBatch`` turns new segments into flows, labels what is new or touched by a changed attack log, and after
``every`` new segments trains, publishes a model bundle and evaluates it.  Everything that a batch leaves behind bears its
batch id, so a batch that is run again after a failure replaces its own results: flows, intervals and counters lie in
``batch=<id>`` partitions, and a batch reads only the state of the batches before it.  The counter is reset when training
is due, even if there are too few rows or training fails.

Tables below ``root``: flows, labeled, state/intervals, state/counter, models (bundles), evaluation.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flows as FL
from ..operators import labels as LB
from ..operators import ml as ML
from ..operators.metrics import matrix_text
from ..plans import bundle as BU
from ..plans import pipeline as PL
from ..session import cut_lineage, path_exists
from ..sources.files import read_attack_log_text
from ..sources.sinks import append_flows
from .live import relabel_on_change, segment_stream

_KEY = ("name", "start_us", "end_us", "base_line", "start_line")
log = logging.getLogger(__name__)


def _state(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The rows of the newest batch before ``before`` in a state table, or None."""
    if not path_exists(spark, path):
        return None
    table = spark.read.parquet(path).where(F.col("batch") < before)
    newest = table.agg(F.max("batch").alias("b")).first()["b"]
    return None if newest is None else table.where(F.col("batch") == newest).drop("batch")


def _keep(df: DataFrame, path: str, batch_id: int) -> None:
    """Replace a batch's rows of a state table; an empty state is a folder of its own."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def relabel(spark: SparkSession, root: str, log_path: str, batch_id: int) -> bool:
    """T4: label new segments, and those with a flow that a changed interval overlaps; False without a log or flows.
    Also for the poll of a log that changed while no segment came (then with the id of the batch to come)."""
    if not path_exists(spark, log_path) or not path_exists(spark, f"{root}/flows"):
        return False
    intervals = cut_lineage(LB.attack_intervals(read_attack_log_text(spark, log_path)).select(*_KEY))
    old = _state(spark, f"{root}/state/intervals", batch_id)
    relabel_on_change(spark, f"{root}/flows", f"{root}/labeled", old, intervals)
    _keep(intervals, f"{root}/state/intervals", batch_id)
    return True


def train_and_evaluate(spark: SparkSession, root: str, batch_id: int, **train) -> bool:
    """T5: train on the labelled table, publish the bundle, and evaluate it from what was published."""
    labeled = spark.read.parquet(f"{root}/labeled")
    if not ML.has_min_rows(labeled, 20):
        return False
    version = BU.save_bundle(spark, PL.train_models(labeled, **train), f"{root}/models")
    ev = BU.evaluate_bundle(BU.load_bundle(spark, f"{root}/models", version), labeled)
    _keep(ev.withColumn("confusion_matrix", matrix_text()).withColumn("version", F.lit(version)).coalesce(1),
          f"{root}/evaluation", batch_id)
    return True


def live_loop(spark: SparkSession, segments_path: str, log_path: str, root: str, checkpoint: str, every: int = 5,
              trigger: dict | None = None, min_age_s: float = 5.0, **train):
    """Start the loop (a streaming query).  ``train`` goes to ``train_models``."""
    def batch(df: DataFrame, batch_id: int) -> None:
        append_flows(FL.flow_extract(df), f"{root}/flows", batch_id)
        mine = f"{root}/flows/batch={batch_id}"
        new = spark.read.parquet(mine).select("segment_id").distinct().count() if path_exists(spark, mine) else 0
        labelled = relabel(spark, root, log_path, batch_id) if new else path_exists(spark, f"{root}/labeled")
        state = _state(spark, f"{root}/state/counter", batch_id)
        count = new + (state.first()["count"] if state is not None else 0)
        due = count >= every and labelled
        _keep(spark.createDataFrame([(0 if due else count,)], "count long").coalesce(1), f"{root}/state/counter", batch_id)
        if due:
            try:
                train_and_evaluate(spark, root, batch_id, **train)
            except Exception:  # the flows and labels of the batch stand; the next due batch trains again
                log.exception("training after batch %d failed", batch_id)

    return (segment_stream(spark, segments_path, min_age_s).writeStream.foreachBatch(batch)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start())


__all__ = ["live_loop", "relabel", "train_and_evaluate"]
