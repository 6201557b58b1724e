"""Train once, publish, load, score and evaluate later.

A bundle is one folder below a root: the scaler's statistics, the feature list, the models, the anomaly threshold and
the holdout rows, all as they came out of one training run.  It is written under a new version name and counts only once
its marker file is there, which is written last, so a reader never sees half a bundle and an interrupted writer leaves
nothing behind that is read.  ``load_bundle`` takes the newest published version.  Scores and metrics come from the
bundle alone: nothing is fitted again.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCAModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import binary_label
from ..operators import ml as ML
from ..session import path_exists
from ..sources.sinks import sink_holdout
from .pipeline import TrainResult

_MARKER = "_PUBLISHED"
_INFO = "features array<string>, models array<string>, threshold double"


@dataclass
class Bundle:
    """What ``load_bundle`` read; missing pieces are None (no holdout: the full table is split again)."""
    version: str
    features: list[str]
    stats: DataFrame
    holdout: DataFrame | None
    threshold: float | None
    models: dict = field(default_factory=dict)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save_bundle(spark: SparkSession, res: TrainResult, root: str) -> str:
    """K5 + K4: write the pieces of a training run and publish them; returns the version."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    base = f"{root.rstrip('/')}/{version}"
    res.stats.coalesce(1).write.parquet(f"{base}/scaler")
    sink_holdout(res.split.where(F.col("split") == "test").drop("split"), f"{base}/holdout")
    for name in ("random_forest", "lstm"):
        if name in res.models:
            ML.save_model(res.models[name], f"{base}/{name}")
    if "autoencoder" in res.models:
        res.models["autoencoder"]["pca"].write().save(f"{base}/pca")
        res.models["autoencoder"]["mu"].coalesce(1).write.parquet(f"{base}/center")
    (spark.createDataFrame([(list(res.features), sorted(res.models), res.threshold)], _INFO).coalesce(1)
     .write.json(f"{base}/info"))
    fs, marker = _file(spark, f"{base}/{_MARKER}")
    fs.create(marker, False).close()
    return version


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, oldest first (an unpublished folder is not listed)."""
    if not path_exists(spark, root):
        return []
    fs, folder = _file(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    return [n for n in names if path_exists(spark, f"{root.rstrip('/')}/{n}/{_MARKER}")]


def load_bundle(spark: SparkSession, root: str, version: str | None = None) -> Bundle | None:
    """The given or newest published version, or None."""
    known = versions(spark, root)
    version = version or (known[-1] if known else None)
    if version not in known:
        return None
    base = f"{root.rstrip('/')}/{version}"
    info = spark.read.schema(_INFO).json(f"{base}/info").first()
    b = Bundle(version, list(info["features"]), spark.read.parquet(f"{base}/scaler"),
               spark.read.parquet(f"{base}/holdout") if path_exists(spark, f"{base}/holdout") else None, info["threshold"])
    for name in ("random_forest", "lstm"):
        if name in info["models"]:
            b.models[name] = PipelineModel.load(f"{base}/{name}")
    if "autoencoder" in info["models"]:
        b.models["autoencoder"] = {"pca": PCAModel.load(f"{base}/pca"), "mu": spark.read.parquet(f"{base}/center"),
                                   "features": b.features}
    return b


def holdout_of(bundle: Bundle, labeled: DataFrame | None) -> DataFrame:
    """The bundle's holdout, else the test part of ``labeled``."""
    if bundle.holdout is not None:
        return bundle.holdout
    sp = ML.stratified_split(ML.drop_null_features(labeled, bundle.features))
    return sp.where(F.col("split") == "test").drop("split")


def score_forest(bundle: Bundle, rows: DataFrame) -> DataFrame:
    """M6: class name and probabilities of every row by the stored forest, on features scaled by the stored statistics."""
    scaled = ML.scale_features(rows, bundle.stats, bundle.features)
    return ML.predict_table(bundle.models["random_forest"], scaled).select(
        "segment_id", "seq", "label", "prediction", "probability")


def score_sequences(bundle: Bundle, labeled: DataFrame) -> DataFrame:
    """M6: the test windows of ``labeled`` by the stored sequence model (the same split as in training)."""
    ws = ML.random_split(ML.sequence_windows(labeled, bundle.features), ["src_ip", "end_segment_id", "end_seq"])
    flat = ws.where(F.col("split") == "test").withColumn("features", array_to_vector(F.flatten("rows")))
    return ML.predict_table(bundle.models["lstm"], flat).select(
        "src_ip", "end_segment_id", "end_seq", "label", "prediction", "probability")


def score_anomalies(bundle: Bundle, rows: DataFrame) -> DataFrame:
    """M6: reconstruction error and flag of every row by the stored subspace and threshold."""
    e = ML.anomaly_errors(bundle.models["autoencoder"], ML.scale_features(rows, bundle.stats, bundle.features))
    return e.select("segment_id", "seq", "label", binary_label("label").alias("y"),
                    (F.col("error") > F.lit(bundle.threshold)).cast("int").alias("yhat"), F.col("error").alias("score"))


def evaluate_bundle(bundle: Bundle, labeled: DataFrame | None = None) -> DataFrame | None:
    """M7: a row for each stored model.  The forest and the anomaly model are judged on the holdout, the sequence model
    on the test windows of ``labeled`` (left out without it or below 20 windows); the anomaly model needs a threshold."""
    rows, out = holdout_of(bundle, labeled), []
    if "random_forest" in bundle.models:
        out.append(ML.evaluate_multiclass(score_forest(bundle, rows), "random_forest",
                                          ML.class_names(bundle.models["random_forest"])))
    if "lstm" in bundle.models and labeled is not None:
        scored = score_sequences(bundle, labeled)
        if ML.has_min_rows(ML.sequence_windows(labeled, bundle.features), 20):
            out.append(ML.evaluate_multiclass(scored, "lstm", ML.class_names(bundle.models["lstm"])))
    if "autoencoder" in bundle.models and bundle.threshold is not None:
        out.append(ML.evaluate_binary(score_anomalies(bundle, rows), "autoencoder"))
    ev = out[0] if out else None
    for o in out[1:]:
        ev = ev.unionByName(o)
    return ev


__all__ = ["Bundle", "save_bundle", "load_bundle", "versions", "score_forest", "score_sequences", "score_anomalies",
           "evaluate_bundle", "holdout_of"]
