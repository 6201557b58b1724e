"""Classification metrics as aggregations over a prediction table.

Prediction tables have one row per scored item: ``label`` (true class), ``prediction``
(predicted class) and, for AUC, ``score`` (binary) or ``probability`` (array, one entry
per sorted class).  All metrics are grouped by ``model`` when the column exists.

* A14 ``confusion_counts`` / ``confusion_matrix`` with J7's zero-filled class grid;
  classes = sorted true labels; predictions outside the grid are dropped.
* A15 ``f1_weighted``: support-weighted F1 over the union of true and predicted classes.
* A16 ``f1_binary``, A17 ``false_positive_rate`` (2x2 only), A18 ``roc_auc`` (exact, ties
  count 1/2), A19 ``roc_auc_ovr`` (one-vs-rest, macro mean).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import running_sums


def _keys(df: DataFrame, by: Sequence[str] | None) -> list[str]:
    if by is not None:
        return list(by)
    return ["model"] if "model" in df.columns else []


def class_index(pred: DataFrame, label: str = "label", by: Sequence[str] | None = None,
                names: Sequence[str] | None = None) -> DataFrame:
    """Sorted distinct true labels -> 0..k-1 (``LabelEncoder`` order).  ``names`` gives the classes (and
    their order) instead, whether or not they occur."""
    keys = _keys(pred, by)
    if names is not None:
        given = pred.sparkSession.createDataFrame([(str(c), i) for i, c in enumerate(names)], "cls string, idx int")
        return pred.select(*keys).distinct().crossJoin(given) if keys else given
    classes = pred.select(*keys, F.col(label).alias("cls")).where(F.col("cls").isNotNull()).distinct()
    w = Window.partitionBy(*keys).orderBy("cls")
    return classes.withColumn("idx", (F.dense_rank().over(w) - 1).cast("int"))


def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """A14 + J7: (true, predicted, true_idx, pred_idx, count) for every cell of the k x k
    grid of true classes (or of the given ``names``), zeros included."""
    keys = _keys(pred, by)
    cls = class_index(pred, label, keys, names)
    counts = (pred.groupBy(*keys, F.col(label).alias("true_label"), F.col(prediction).alias("pred_label"))
              .agg(F.count(F.lit(1)).alias("count")))
    t = cls.select(*keys, F.col("cls").alias("true_label"), F.col("idx").alias("true_idx"))
    p = cls.select(*keys, F.col("cls").alias("pred_label"), F.col("idx").alias("pred_idx"))
    grid = t.join(p, keys, "inner") if keys else t.crossJoin(p)
    return (grid.join(counts, [*keys, "true_label", "pred_label"], "left")
            .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("long")))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """A14 in matrix form: ``confusion_matrix array<array<bigint>>`` (rows = true class)."""
    keys = _keys(pred, by)
    cells = confusion_counts(pred, label, prediction, keys, names)
    rows = (cells.groupBy(*keys, "true_idx")
            .agg(F.array_sort(F.collect_list(F.struct("pred_idx", "count"))).alias("r"))
            .select(*keys, "true_idx", F.transform("r", lambda x: x["count"]).alias("row")))
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("true_idx", "row"))).alias("m"))
    return out.select(*keys, F.transform("m", lambda x: x["row"]).alias("confusion_matrix"))


def matrix_text(m: str = "confusion_matrix"):
    """Matrix as the CSV sink writes it: ``[[1, 1], [0, 2]]``."""
    inner = F.transform(F.col(m), lambda r: F.concat(F.lit("["), F.array_join(r.cast("array<string>"), ", "),
                                                   F.lit("]")))
    return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))


def per_class_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] | None = None) -> DataFrame:
    """tp, support (true count) and predicted count per class (union of both sides)."""
    keys = _keys(pred, by)
    cells = pred.groupBy(*keys, F.col(label).alias("t"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    sides = cells.select(*keys, F.explode(F.array(
        F.struct(F.col("t").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("prd"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("prd"),
                 F.lit(0).cast("long").alias("tp")))).alias("s"))
    return (sides.groupBy(*keys, F.col("s.cls").alias("cls"))
            .agg(F.sum("s.sup").alias("support"), F.sum("s.prd").alias("predicted"), F.sum("s.tp").alias("tp")))


def _f1(tp, support, predicted):
    den = support + predicted
    return F.when(den > 0, F.lit(2.0) * tp / den).otherwise(F.lit(0.0))


def f1_weighted(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                by: Sequence[str] | None = None) -> DataFrame:
    """sum(support_c * F1_c) / sum(support_c); F1 of a class with no tp+fp+fn is 0."""
    keys = _keys(pred, by)
    c = per_class_counts(pred, label, prediction, keys)
    agg = c.groupBy(*keys).agg(F.sum(F.col("support") * _f1(F.col("tp"), F.col("support"), F.col("predicted")))
                                .alias("_num"), F.sum("support").alias("_den"))
    return agg.select(*keys, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(F.lit(0.0))
                      .alias("f1_weighted"))


def f1_binary(pred: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] | None = None) -> DataFrame:
    """F1 of class 1 for 0/1 columns."""
    keys = _keys(pred, by)
    a = pred.groupBy(*keys).agg(F.count_if((F.col(y) == 1) & (F.col(yhat) == 1)).alias("tp"),
                                F.count_if(F.col(y) == 1).alias("sup"), F.count_if(F.col(yhat) == 1).alias("prd"))
    return a.select(*keys, _f1(F.col("tp"), F.col("sup"), F.col("prd")).alias("f1_binary"))


def false_positive_rate(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                        by: Sequence[str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Fp / (fp + tn) of the 2x2 matrix (negative = first class), else NULL."""
    keys = _keys(pred, by)
    cells = confusion_counts(pred, label, prediction, keys, names)
    a = cells.groupBy(*keys).agg(
        F.max("true_idx").alias("_kmax"),
        F.sum(F.when((F.col("true_idx") == 0) & (F.col("pred_idx") == 0), F.col("count"))).alias("tn"),
        F.sum(F.when((F.col("true_idx") == 0) & (F.col("pred_idx") == 1), F.col("count"))).alias("fp"))
    ok = (F.col("_kmax") == 1) & ((F.col("fp") + F.col("tn")) > 0)
    return a.select(*keys, F.when(ok, F.col("fp") / (F.col("fp") + F.col("tn"))).alias("false_positive_rate"))


#: Distinct scores that one task orders.
RANGE_SCORES = 1 << 20


def roc_auc(pred: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] | None = None,
            range_scores: int = RANGE_SCORES) -> DataFrame:
    """Exact AUC = sum over scores of pos * (neg below + neg tied / 2) / (P * N).

    Rows are first reduced to distinct scores (partial aggregation).  These are range-partitioned by score, as many
    ranges as ``range_scores`` scores each make; the running count of negatives runs inside the ranges, with the
    totals of a key's earlier ranges as offsets.  NULL when a group has one class only.
    """
    keys = _keys(pred, by)
    d = cut_lineage(pred.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")))
    ranges = max(1, -(-d.count() // range_scores))
    d = d.withColumn("_range", F.lit(0)) if ranges == 1 else cut_lineage(
        d.repartitionByRange(ranges, *keys, "_s").withColumn("_range", F.spark_partition_id()))
    rs = running_sums(d, keys, "_range", ["_s"], ["neg"], inclusive=False)
    a = rs.groupBy(*keys).agg(
        F.sum(F.col("pos").cast("double") * (F.col("cum_neg") + F.col("neg") * F.lit(0.5))).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return a.select(*keys, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                  F.col("_u") / (F.col("_p").cast("double") * F.col("_n").cast("double"))).alias("roc_auc"))


def roc_auc_ovr(pred: DataFrame, label: str = "label", probability: str = "probability",
                by: Sequence[str] | None = None, names: Sequence[str] | None = None,
                range_scores: int = RANGE_SCORES) -> DataFrame:
    """One-vs-rest AUC per class (probability[i] is class i), macro mean.
    ``names`` is the model's class list, the order of ``probability``; without it the sorted labels of the rows stand
    in.  NULL if any class has no positive or no negative row, so also when the rows lack one of the model's classes."""
    keys = _keys(pred, by)
    cls = class_index(pred, label, keys, names)
    j = pred.join(cls, keys, "inner") if keys else pred.crossJoin(cls)
    rows = j.select(*keys, "idx", (F.col(label) == F.col("cls")).cast("int").alias("_y"),
                    F.element_at(F.col(probability), F.col("idx") + 1).alias("_score"))
    per = roc_auc(rows, "_y", "_score", [*keys, "idx"], range_scores)
    return per.groupBy(*keys).agg(
        F.when(F.count_if(F.col("roc_auc").isNull()) == 0, F.avg("roc_auc")).alias("roc_auc_ovr"))
