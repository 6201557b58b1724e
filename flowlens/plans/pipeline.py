"""Batch pipeline: packets -> flows -> labels -> split/scale -> models -> evaluation.

``extract_and_label`` is one plan (flows, entropy and labels; the labelling reuses the
entropy stage's partitioning).  ``train_and_evaluate`` cuts the lineage of the split
table once (reliable checkpoint in ``spark.checkpoint.dir``) because every model and
metric reads it again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import binary_label
from ..operators import flows as FL
from ..operators import labels as LB
from ..operators import ml as ML
from ..operators.metrics import class_index
from ..session import cut_lineage


def extract_and_label(packets: DataFrame, log: DataFrame, **label_kw) -> DataFrame:
    """A1 + W1 + J1: labelled flow table from packets and an attack log table."""
    flows = FL.flow_extract(packets)
    return LB.label_flows(flows, LB.attack_intervals(log), **label_kw)


@dataclass
class TrainResult:
    split: DataFrame
    stats: DataFrame
    features: list
    models: dict = field(default_factory=dict)
    predictions: dict = field(default_factory=dict)
    threshold: float | None = None


def train_models(labeled: DataFrame, rf_trees: int = 200, rf_depth: int = 20, seq_iter: int = 100,
                 ae_include_test: bool = False, checkpoint: bool = True) -> TrainResult:
    """M1-M6: split, scale, fit the three models and score the holdout.

    * random forest on scaled features (balanced weights);
    * sequence classifier on unscaled 5-flow windows per source (skipped below 20 windows,
      F11), split 80/20 without stratification;
    * anomaly model on scaled NORMAL rows (train split only unless ``ae_include_test``,
      which reproduces the reference's use of every NORMAL row), threshold mean + 3 std.
    """
    feats = ML.select_features(labeled)
    sp = ML.stratified_split(ML.drop_null_features(labeled, feats))
    if checkpoint:
        sp = cut_lineage(sp)
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    stats = ML.scaler_stats(train, feats)
    train_s, test_s = ML.scale_features(train, stats, feats), ML.scale_features(test, stats, feats)
    res = TrainResult(split=sp, stats=stats, features=feats)

    rf = ML.train_random_forest(train_s, feats, num_trees=rf_trees, max_depth=rf_depth)
    res.models["random_forest"] = rf
    res.predictions["random_forest"] = _keep(ML.predict_table(rf, test_s).select(
        "segment_id", "seq", "label", "prediction", "probability"), checkpoint)

    win = ML.sequence_windows(labeled, feats)
    if ML.has_min_rows(win, 20):
        ws = ML.random_split(win, ["src_ip", "end_segment_id", "end_seq"])
        if checkpoint:
            ws = cut_lineage(ws)
        k = class_index(ws, "label", []).count()
        if k >= 2:
            mlp = ML.train_sequence_classifier(ws.where(F.col("split") == "train"), k, max_iter=seq_iter)
            res.models["lstm"] = mlp
            flat = ws.where(F.col("split") == "test").withColumn("features", _vec(F.flatten("rows")))
            res.predictions["lstm"] = _keep(ML.predict_table(mlp, flat).select(
                "src_ip", "end_segment_id", "end_seq", "label", "prediction", "probability"), checkpoint)

    normal_rows = sp if ae_include_test else train
    normal_s = ML.scale_features(ML.normal_only(normal_rows), stats, feats)
    if normal_s.limit(1).count() > 0:
        ae = ML.train_anomaly_model(normal_s, feats)
        res.models["autoencoder"] = ae
        thr = ML.anomaly_threshold(ML.anomaly_errors(ae, normal_s)).first()["threshold"]
        res.threshold = thr
        e = ML.anomaly_errors(ae, test_s)
        res.predictions["autoencoder"] = _keep(e.select(
            "segment_id", "seq", "label", binary_label("label").alias("y"),
            (F.col("error") > F.lit(thr)).cast("int").alias("yhat"), F.col("error").alias("score")), checkpoint)
    return res


def _keep(df: DataFrame, checkpoint: bool) -> DataFrame:
    """Holdout predictions are read by every metric: score once, keep the result."""
    return cut_lineage(df) if checkpoint else df


def _vec(c):
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(c)


def evaluate(res: TrainResult) -> DataFrame:
    """M7: one evaluation row per trained model."""
    out = []
    if "random_forest" in res.predictions:
        out.append(ML.evaluate_multiclass(res.predictions["random_forest"], "random_forest",
                                          ML.class_names(res.models["random_forest"])))
    if "lstm" in res.predictions:
        out.append(ML.evaluate_multiclass(res.predictions["lstm"], "lstm", ML.class_names(res.models["lstm"])))
    if "autoencoder" in res.predictions:
        out.append(ML.evaluate_binary(res.predictions["autoencoder"], "autoencoder"))
    ev = out[0]
    for o in out[1:]:
        ev = ev.unionByName(o)
    return ev

