import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.operators import ml as ML
from flowlens.plans import registry as R
from flowlens.schemas import FEATURES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labeled(spark):
    return R.labeled_of(spark, SF).cache()


def test_stratified_split_exact_shares(labeled):
    sp = ML.stratified_split(labeled)
    got = {(r.label, r.split): r["count"] for r in sp.groupBy("label", "split").count().collect()}
    n = {r.label: r["count"] for r in labeled.groupBy("label").count().collect()}
    for lab, cnt in n.items():
        assert got[(lab, "test")] == -(-cnt * 20 // 100)
        assert got[(lab, "test")] + got.get((lab, "train"), 0) == cnt


def test_split_is_deterministic(labeled):
    a = ML.stratified_split(labeled).where("split = 'test'").select("segment_id", "seq")
    b = ML.stratified_split(labeled).where("split = 'test'").select("segment_id", "seq")
    assert a.exceptAll(b).count() == 0


def test_scaler_uses_population_std_and_unit_scale_for_constants(labeled):
    st = {r.feature: r for r in ML.scaler_stats(labeled).collect()}
    pdf = labeled.select(*FEATURES).toPandas().astype(float)
    for f in FEATURES:
        assert st[f].mean == pytest.approx(pdf[f].mean())
        assert st[f].std == pytest.approx(pdf[f].std(ddof=0), abs=1e-9)
    assert st["bwd_packets"].std == 0.0 and st["bwd_packets"].scale == 1.0


def test_sequence_windows_equal_naive(labeled):
    """Each row that is at least the fifth of its source ends one window, made of the rows numbered n-4..n."""
    rows = sorted(labeled.collect(), key=lambda r: (r.src_ip, r.start_time, r.segment_id, r.seq))
    number, place = {}, {}
    for r in rows:
        n = number[r.src_ip] = number.get(r.src_ip, -1) + 1
        place[r.src_ip, n] = r
    win = {(r.src_ip, r.end_segment_id, r.end_seq): r for r in ML.sequence_windows(labeled).collect()}
    for rows in (5, 7, 40):  # frames of few rows: windows reach over their edges
        again = {(r.src_ip, r.end_segment_id, r.end_seq): r for r in ML.sequence_windows(labeled, chunk_rows=rows).collect()}
        assert again == win
    assert len(win) == sum(n >= 4 for _, n in place)
    for (src, n), last in place.items():
        if n >= 4:
            got = win[src, last.segment_id, last.seq]
            want = [float(place[src, k][f]) for k in range(n - 4, n + 1) for f in FEATURES]
            assert got.label == last.label and [x for row in got.rows for x in row] == pytest.approx(want)


def test_class_weights_balanced(labeled):
    w = {r.label: r.weight for r in ML.class_weights(labeled).collect()}
    n = labeled.count()
    cnt = {r.label: r["count"] for r in labeled.groupBy("label").count().collect()}
    for k, c in cnt.items():
        assert w[k] == pytest.approx(n / (len(cnt) * c))


def test_reconstruction_error_and_threshold(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "x array<double>, xh array<double>")
    e = [r.e for r in df.select(ML.reconstruction_error(F.col("x"), F.col("xh")).alias("e")).collect()]
    assert e == [2.0, 1.0]
    t = ML.anomaly_threshold(spark.createDataFrame([(1.0,), (3.0,)], "error double")).first().threshold
    assert t == pytest.approx(2.0 + 3 * 1.0)


def test_pca_error_matches_numpy(spark, labeled):
    import numpy as np
    feats = list(FEATURES)
    st = ML.scaler_stats(labeled, feats)
    sc = ML.scale_features(ML.normal_only(labeled), st, feats).limit(500).cache()
    m = ML.train_anomaly_model(sc, feats, k=4)
    got = ML.anomaly_errors(m, sc).select("error", *feats).toPandas()
    x = got[feats].values
    mu = np.array(m["mu"].first()["mu"])
    p = m["pca"].pc.toArray()
    xh = mu + (x - mu) @ p @ p.T
    assert got["error"].values == pytest.approx(((x - xh) ** 2).mean(axis=1), abs=1e-9)
    assert pd is not None
