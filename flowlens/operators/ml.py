"""Feature preparation, splits, models and their evaluation on the labelled flow table.

Table operators (Y oracles): M1 ``stratified_split``, J5 ``split_membership``,
A12 ``scaler_stats``, M2 ``scale_features``, A20 ``class_weights``,
A21 ``reconstruction_error``, A13 ``anomaly_threshold``, W3 ``sequence_windows``,
P12 ``select_features``, F8/F9/F11.

Models (Spark ML, rows-only checks): M3 random forest, M4 sequence classifier (a
multilayer perceptron on the flattened 5-flow window — *not* a recurrent network),
M5 anomaly model (PCA subspace reconstruction: a linear autoencoder with squared loss
spans the same subspace), M6 batch scoring, M7 evaluation rows, K5/S7 persistence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import binary_label
from ..schemas import FEATURES, NORMAL, SEQ_LEN, US
from ..session import path_exists
from . import metrics as MT
from .ordered import CHUNK_ROWS, chunked_row_number, count_chunks

# First hex digits of the md5 order key used as chunks (16^4 = 65,536 chunks per class).
SPLIT_CHUNK_HEX = 4
SEED = 42


def select_features(df: DataFrame, features: Sequence[str] = FEATURES) -> list[str]:
    """The listed features that exist, in list order."""
    return [c for c in features if c in df.columns]


def normal_only(df: DataFrame, label: str = "label") -> DataFrame:
    """F8: ``label == 'NORMAL'``."""
    return df.where(F.col(label) == NORMAL)


def drop_null_features(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """drop rows with a NULL feature."""
    return df.na.drop(subset=list(features or select_features(df)))


def has_min_rows(df: DataFrame, n: int = 20) -> bool:
    """gate on "at least n rows" with ``limit(n).count()`` (never a full count)."""
    return df.limit(n).count() >= n


def _order_key(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def _rank_by_hash(df: DataFrame, part: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    h = _order_key(keys, seed)
    d = df.withColumn("_h", h).withColumn(
        "_hc", F.conv(F.substring("_h", 1, SPLIT_CHUNK_HEX), 16, 10).cast("long"))
    return chunked_row_number(d, part, "_hc", ["_h"], "_rn")


def stratified_split(df: DataFrame, label: str = "label", keys: Sequence[str] = ("segment_id", "seq"),
                     test_pct: int = 20, seed: int = SEED) -> DataFrame:
    """M1: add ``split`` = test | train.  Per class, the first ``ceil(n_c * pct / 100)``
    rows in ``md5(keys|seed)`` order are test rows — exact class shares, reproducible in
    SQL.  The order is numbered per (class, md5 prefix) chunk, so a dominant class does
    not end up in one task."""
    d = df.withColumn("_cls", F.coalesce(F.col(label), F.lit("\u0000")))
    n = d.groupBy("_cls").agg(F.count(F.lit(1)).alias("_n"))
    r = _rank_by_hash(d, ["_cls"], keys, seed).join(F.broadcast(n), "_cls")
    n_test = ((F.col("_n") * test_pct + 99) / 100).cast("long")
    return (r.withColumn("split", F.when(F.col("_rn") <= n_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("_cls", "_n", "_h", "_hc", "_rn"))


def random_split(df: DataFrame, keys: Sequence[str], test_pct: int = 20, seed: int = SEED) -> DataFrame:
    """Unstratified 80/20 split (sequence windows): first ceil(n * pct / 100) rows in hash
    order are test rows."""
    d = df.withColumn("_all", F.lit(0))
    n = d.groupBy("_all").agg(F.count(F.lit(1)).alias("_n"))
    r = _rank_by_hash(d, ["_all"], keys, seed).join(F.broadcast(n), "_all")
    n_test = ((F.col("_n") * test_pct + 99) / 100).cast("long")
    return (r.withColumn("split", F.when(F.col("_rn") <= n_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("_all", "_n", "_h", "_hc", "_rn"))


def split_membership(df: DataFrame, ids: DataFrame, keys: Sequence[str] = ("segment_id", "seq")) -> DataFrame:
    """Rows of ``df`` whose keys are in ``ids`` (left semi join)."""
    return df.join(ids.select(*keys), list(keys), "left_semi")


def scaler_stats(train: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Per feature mean and population std (one aggregate pass); ``scale`` is the std,
    or 1 where the std is 0.  Rows: (idx, feature, mean, std, scale)."""
    feats = list(features or select_features(train))
    aggs = []
    for f in feats:
        aggs += [F.avg(F.col(f).cast("double")).alias(f"m_{f}"), F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}")]
    one = train.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"),
                              F.col(f"s_{f}").alias("std")) for i, f in enumerate(feats)])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))


def scale_features(df: DataFrame, stats: DataFrame, features: Sequence[str] | None = None,
                   suffix: str = "") -> DataFrame:
    """M2: ``(x - mean) / scale`` for every feature, with the fitted stats (a 1-row
    broadcast of 15 pairs)."""
    feats = list(features or select_features(df))
    wide = stats.agg(*[F.max(F.when(F.col("feature") == f, F.struct("mean", "scale"))).alias(f"_st_{f}")
                       for f in feats])
    j = df.crossJoin(F.broadcast(wide))
    for f in feats:
        j = j.withColumn(f + suffix, (F.col(f).cast("double") - F.col(f"_st_{f}.mean")) / F.col(f"_st_{f}.scale"))
    return j.drop(*[f"_st_{f}" for f in feats])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``balanced`` weights n / (k * n_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = c.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return c.crossJoin(F.broadcast(tot)).select(
        label, "n_c", (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def reconstruction_error(x: Column, xhat: Column) -> Column:
    """Mean over features of (x - xhat)^2 (array columns of equal length)."""
    sq = F.zip_with(x, xhat, lambda a, b: (a - b) * (a - b))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


def anomaly_threshold(errors: DataFrame, err: str = "error") -> DataFrame:
    """Mean + 3 * population std of the error (pass the NORMAL rows)."""
    return errors.agg((F.avg(err) + F.lit(3.0) * F.stddev_pop(err)).alias("threshold"))


def sequence_windows(df: DataFrame, features: Sequence[str] | None = None, seq_len: int = SEQ_LEN,
                     key: str = "src_ip", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sliding windows of ``seq_len`` flows per source ordered by start time, step 1;
    label = the last flow's.  Shorter histories give no window; windows cross segments.

    Flows are numbered inside their source (``chunked_row_number`` over chunks by the source's own histogram) and cut
    into frames of ``chunk_rows`` numbers; a frame also gets the last ``seq_len - 1`` flows before it as a halo.  A
    window of five rows over a frame then has all it needs, so a hot source is spread over many tasks and every feature
    row is sent once (the halo apart).  Output: (key, end_segment_id, end_seq, label, rows) with ``rows`` = array of
    ``seq_len`` feature arrays in time order (unscaled).
    """
    feats = list(features or select_features(df))
    d = drop_null_features(df, feats).where(F.col(key).isNotNull())
    if "start_us" not in d.columns:
        d = d.withColumn("start_us", F.round(F.col("start_time") * F.lit(float(US))).cast("long"))
    d = d.select(key, "start_us", "segment_id", "seq", "label", F.array(*[F.col(f).cast("double") for f in feats]).alias("x"))
    r = chunked_row_number(count_chunks(d, [key], "start_us", "_slice", chunk_rows), [key], "_slice",
                           ["start_us", "segment_id", "seq"], "_pos")
    frame = F.floor((F.col("_pos") - 1) / F.lit(chunk_rows)).cast("long")
    halo = F.floor((F.col("_pos") + F.lit(seq_len - 2)) / F.lit(chunk_rows)).cast("long")
    # the halo reaches one frame further at most, as a frame is not shorter than a window
    framed = r.select("*", F.explode(F.array_distinct(F.array(frame, halo))).alias("_frame"), frame.alias("_own"))
    w = Window.partitionBy(key, "_frame").orderBy("_pos").rowsBetween(-(seq_len - 1), Window.currentRow)
    return (framed.select(key, "_own", "_frame", "_pos", "segment_id", "seq", "label", F.collect_list("x").over(w).alias("rows"))
            .where((F.col("_own") == F.col("_frame")) & (F.col("_pos") >= seq_len))
            .select(key, F.col("segment_id").alias("end_segment_id"), F.col("seq").alias("end_seq"), "label", "rows"))


# ------------------------------------------------------------------------------ models
def _assembled(df: DataFrame, feats: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(feats), outputCol=out, handleInvalid="keep").transform(df)


def train_random_forest(train_scaled: DataFrame, features: Sequence[str], label: str = "label",
                        num_trees: int = 200, max_depth: int = 20, seed: int = SEED,
                        max_memory_mb: int = 256) -> PipelineModel:
    """M3: 200 trees, depth 20, balanced class weights, seed 42.  Spark has no
    ``min_samples_split``; ``minInstancesPerNode=2`` is its per-child counterpart of 5."""
    w = class_weights(train_scaled, label).select(label, "weight")
    t = train_scaled.join(F.broadcast(w), label)
    idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="keep")
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="features", labelCol="label_idx", weightCol="weight",
                                numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=2,
                                featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=max_memory_mb,
                                cacheNodeIds=True, checkpointInterval=10)
    return Pipeline(stages=[idx, va, rf]).fit(t)


def train_sequence_classifier(windows_train: DataFrame, num_classes: int, seq_len: int = SEQ_LEN,
                              n_features: int = len(FEATURES), max_iter: int = 100, seed: int = SEED) -> PipelineModel:
    """M4: MLP [seq_len*15, 64, 32, k] on the flattened window (stand-in for the LSTM)."""
    flat = windows_train.withColumn("xflat", F.flatten("rows"))
    idx = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc")
    from pyspark.ml.functions import array_to_vector
    v = flat.withColumn("features", array_to_vector("xflat"))
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label_idx",
                                         layers=[seq_len * n_features, 64, 32, num_classes],
                                         maxIter=max_iter, blockSize=16, seed=seed)
    return Pipeline(stages=[idx, mlp]).fit(v)


def train_anomaly_model(normal_scaled: DataFrame, features: Sequence[str], k: int = 8) -> dict:
    """M5: PCA subspace of the NORMAL rows (scaled); returns the fitted model pieces."""
    feats = list(features)
    mu = normal_scaled.agg(F.array(*[F.avg(f) for f in feats]).alias("mu"))
    centered = normal_scaled.crossJoin(F.broadcast(mu)).select(
        *[(F.col(f) - F.col("mu")[i]).alias(f) for i, f in enumerate(feats)])
    pca = PCA(k=min(k, len(feats)), inputCol="features", outputCol="pc").fit(_assembled(centered, feats))
    return {"pca": pca, "mu": mu, "features": feats}


def anomaly_errors(model: dict, scaled: DataFrame) -> DataFrame:
    """A21 for the PCA model: reconstruction ``mu + P P^T (x - mu)``; with orthonormal
    components the squared error is ``|x - mu|^2 - |P^T (x - mu)|^2`` (Pythagoras), so
    only Spark's own PCA projection is needed.  Adds ``error`` (mean over features)."""
    feats = model["features"]
    d = scaled.crossJoin(F.broadcast(model["mu"]))
    centered = [(F.col(f) - F.col("mu")[i]) for i, f in enumerate(feats)]
    d = d.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(centered)])
    va = VectorAssembler(inputCols=[f"_c{i}" for i in range(len(feats))], outputCol="_cv", handleInvalid="keep")
    proj = model["pca"].copy({model["pca"].inputCol: "_cv", model["pca"].outputCol: "_pc"})
    y = proj.transform(va.transform(d)).withColumn("_y", vector_to_array("_pc"))
    norm_x = sum((F.col(f"_c{i}") * F.col(f"_c{i}") for i in range(len(feats))), F.lit(0.0))
    norm_y = F.aggregate("_y", F.lit(0.0), lambda acc, v: acc + v * v)
    err = F.greatest(norm_x - norm_y, F.lit(0.0)) / F.lit(float(len(feats)))
    return y.withColumn("error", err).drop("_cv", "_pc", "_y", "mu", *[f"_c{i}" for i in range(len(feats))])


def predict_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M6: batch scoring; ``prediction`` as the class name and ``probability`` as array."""
    out = model.transform(df)
    names = F.array(*[F.lit(x) for x in class_names(model)])
    return (out.withColumn("probability", vector_to_array("probability"))
            .withColumn("prediction", F.element_at(names, F.col("prediction").cast("int") + 1)))


def class_names(model: PipelineModel) -> list[str]:
    """The classes of a trained pipeline, in the order of its ``probability``."""
    return list([s for s in model.stages if hasattr(s, "labelsArray")][0].labelsArray[0])


def evaluate_multiclass(pred: DataFrame, model_name: str, names: list[str] | None = None) -> DataFrame:
    """M7 for a multi-class model: weighted F1, OvR AUC, FPR (2x2 only) and the confusion matrix over the true classes.
    ``names`` is the model's class list in the order of ``probability`` (without it: the sorted labels of the rows);
    the AUC is NULL when the rows lack one of these classes."""
    p = pred.withColumn("model", F.lit(model_name))
    f1 = MT.f1_weighted(p)
    auc_ovr = MT.roc_auc_ovr(p, names=names)
    fpr = MT.false_positive_rate(p)
    cm = MT.confusion_matrix(p)
    return (f1.join(auc_ovr, "model", "left").join(fpr, "model", "left").join(cm, "model", "left")
            .select("model", F.col("f1_weighted").alias("f1_score"), F.col("roc_auc_ovr").alias("roc_auc"),
                    "false_positive_rate", "confusion_matrix"))


def evaluate_binary(pred: DataFrame, model_name: str) -> DataFrame:
    """M7 for an anomaly model: ``y`` = 0 NORMAL / 1 attack, ``yhat`` 0/1, ``score``.  Matrix and false-positive rate
    are over the fixed 0/1 grid, so a holdout of one class has them too."""
    p = pred.withColumn("model", F.lit(model_name)) \
        .withColumn("label", F.col("y").cast("string")).withColumn("prediction", F.col("yhat").cast("string"))
    f1 = MT.f1_binary(p)
    auc = MT.roc_auc(p)
    fpr = MT.false_positive_rate(p, names=("0", "1"))
    cm = MT.confusion_matrix(p, names=("0", "1"))
    return (f1.join(auc, "model", "left").join(fpr, "model", "left").join(cm, "model", "left")
            .select("model", F.col("f1_binary").alias("f1_score"), "roc_auc", "false_positive_rate",
                    "confusion_matrix"))


def save_threshold(spark, path: str, threshold_df: DataFrame) -> None:
    """K5: the threshold as a one-row JSON table."""
    threshold_df.coalesce(1).write.mode("overwrite").json(path)


def load_threshold(spark, path: str) -> float | None:
    """Threshold or None when missing."""
    if not path_exists(spark, path):
        return None
    rows = spark.read.schema("threshold double").json(path).limit(1).collect()
    return float(rows[0]["threshold"]) if rows else None


def save_model(model: PipelineModel, path: str) -> None:
    """K5: Spark ML persistence (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """Load a saved pipeline if it exists."""
    from pyspark.sql import SparkSession
    return PipelineModel.load(path) if path_exists(SparkSession.active(), path) else None
