import random

import pytest

from flowlens.operators import metrics as MT


def _pred(spark):
    rows = [("m", "N", "N", 0, 0, 0.1), ("m", "N", "R", 0, 1, 0.6), ("m", "R", "R", 1, 1, 0.6), ("m", "R", "R", 1, 1, 0.9)]
    return spark.createDataFrame(rows, "model string, label string, prediction string, y int, yhat int, score double")


def test_hand_derived_metrics(spark):
    p = _pred(spark)
    assert MT.confusion_matrix(p).first().confusion_matrix == [[1, 1], [0, 2]]
    assert MT.f1_weighted(p).first().f1_weighted == pytest.approx(0.733333, abs=1e-6)
    assert MT.f1_binary(p).first().f1_binary == pytest.approx(0.8)
    assert MT.false_positive_rate(p).first().false_positive_rate == pytest.approx(0.5)
    assert MT.roc_auc(p).first().roc_auc == pytest.approx(0.875)


def test_single_class_gives_null(spark):
    rows = [("m", "N", "N", 0, 0, 0.1), ("m", "N", "N", 0, 0, 0.3)]
    p = spark.createDataFrame(rows, "model string, label string, prediction string, y int, yhat int, score double")
    assert MT.roc_auc(p).first().roc_auc is None
    assert MT.false_positive_rate(p).first().false_positive_rate is None


def _brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y != 1]
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", range(3))
def test_auc_equals_pair_count(spark, seed):
    rnd = random.Random(seed)
    rows = [("m", rnd.random() < 0.3, round(rnd.random(), 2)) for _ in range(600)]
    ys, ss = [int(a) for _, a, _ in rows], [c for _, _, c in rows]
    p = spark.createDataFrame([(m, int(a), c) for m, a, c in rows], "model string, y int, score double")
    assert MT.roc_auc(p, range_scores=9).first().roc_auc == pytest.approx(_brute_auc(ys, ss), abs=1e-12)


def test_ovr_auc_macro(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        lab = rnd.choice(["A", "B", "C"])
        w = [rnd.random() + (1.0 if c == lab else 0.0) for c in "ABC"]
        s = sum(w)
        rows.append((lab, "A", [x / s for x in w]))
    p = spark.createDataFrame(rows, "label string, prediction string, probability array<double>")
    exp = sum(_brute_auc([int(r[0] == c) for r in rows], [r[2][i] for r in rows]) for i, c in enumerate("ABC")) / 3
    assert MT.roc_auc_ovr(p).first().roc_auc_ovr == pytest.approx(exp, abs=1e-12)


def test_confusion_grid_zero_fill_and_unknown_prediction(spark):
    rows = [("a", "a"), ("b", "zzz"), ("c", "a")]
    p = spark.createDataFrame(rows, "label string, prediction string")
    cells = {(r.true_label, r.pred_label): r["count"] for r in MT.confusion_counts(p).collect()}
    assert len(cells) == 9 and cells[("a", "a")] == 1 and cells[("c", "a")] == 1 and sum(cells.values()) == 2


def test_auc_of_large_counts_does_not_overflow(spark):
    p = spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, score double")
    big = MT.roc_auc(p)
    assert big.first().roc_auc == 1.0
    assert "cast" in str(big._jdf.queryExecution().analyzed()).lower()


def test_one_vs_rest_with_an_absent_class_is_null(spark):
    rows = [("a", [0.9, 0.05, 0.05]), ("a", [0.8, 0.1, 0.1]), ("c", [0.1, 0.1, 0.8]), ("c", [0.0, 0.1, 0.9])]
    p = spark.createDataFrame(rows, "label string, probability array<double>")
    assert MT.roc_auc_ovr(p, names=["a", "b", "c"]).first().roc_auc_ovr is None
    full = p.unionByName(spark.createDataFrame([("b", [0.1, 0.8, 0.1])], p.schema))
    assert MT.roc_auc_ovr(full, names=["a", "b", "c"]).first().roc_auc_ovr == 1.0


def test_binary_evaluation_of_an_all_normal_holdout(spark):
    from flowlens.operators import ml as ML
    p = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2), (0, 1, 0.9)], "y int, yhat int, score double")
    r = ML.evaluate_binary(p, "m").first()
    assert r.confusion_matrix == [[2, 1], [0, 0]] and abs(r.false_positive_rate - 1 / 3) < 1e-12 and r.roc_auc is None
