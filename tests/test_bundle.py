"""Published model bundles: scores from the stored pieces equal those in memory and a plain reference scorer."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import ml as ML
from flowlens.plans import bundle as BU
from flowlens.plans import pipeline as PL
from flowlens.plans import registry as R
from flowlens.session import cut_lineage

KEY = ("segment_id", "seq")


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    lab = cut_lineage(R.labeled_of(spark, "/root/testdata/sf0.01"))
    res = PL.train_models(lab, rf_trees=6, rf_depth=6, seq_iter=5)
    root = str(tmp_path_factory.mktemp("bundles"))
    return lab, res, root, BU.save_bundle(spark, res, root)


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stored_scores_equal_those_in_memory(spark, trained):
    lab, res, root, version = trained
    b = BU.load_bundle(spark, root)
    assert b.version == version and set(b.models) == {"random_forest", "lstm", "autoencoder"} and b.threshold == res.threshold
    cols = [*KEY, "label", "prediction", "probability"]
    assert _rows(BU.score_forest(b, b.holdout), cols) == _rows(res.predictions["random_forest"], cols)
    cols = ["src_ip", "end_segment_id", "end_seq", "label", "prediction", "probability"]
    assert _rows(BU.score_sequences(b, lab), cols) == _rows(res.predictions["lstm"], cols)
    a, c = (_rows(x, [*KEY, "y", "yhat", "score"]) for x in (BU.score_anomalies(b, b.holdout), res.predictions["autoencoder"]))
    assert [x[:4] for x in a] == [x[:4] for x in c] and np.allclose([x[4] for x in a], [x[4] for x in c])
    ev = {r.model: r for r in BU.evaluate_bundle(b, lab).collect()}
    want = {r.model: r for r in PL.evaluate(res).collect()}
    assert set(ev) == set(want) == {"random_forest", "lstm", "autoencoder"}
    for m in ev:
        assert ev[m].f1_score == pytest.approx(want[m].f1_score) and ev[m].confusion_matrix == want[m].confusion_matrix


def test_an_unpublished_folder_is_not_read(spark, trained):
    _, res, root, version = trained
    os.makedirs(os.path.join(root, "99999999999999999999-interrupted", "scaler"))
    assert BU.versions(spark, root) == [version] and BU.load_bundle(spark, root).version == version
    assert BU.load_bundle(spark, root, "99999999999999999999-interrupted") is None
    assert BU.load_bundle(spark, os.path.join(root, "nowhere")) is None
    newer = BU.save_bundle(spark, PL.TrainResult(res.split, res.stats, res.features), root)
    b = BU.load_bundle(spark, root)
    assert b.version == newer and not b.models and b.threshold is None and BU.evaluate_bundle(b) is None


def _votes(node, x):
    while node.subtreeDepth() > 0:
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    stats = np.array(list(node.impurityStats().stats()))
    return stats / stats.sum()


def test_scores_equal_a_plain_scorer(spark, trained):
    """Forest by walking its trees, sequence model by its layers, subspace by projection, all in numpy."""
    lab, res, root, version = trained
    b = BU.load_bundle(spark, root, version)
    st = {r.feature: (r.mean, r.scale) for r in b.stats.collect()}
    rows = b.holdout.orderBy(*KEY).limit(60).collect()
    x = np.array([[(float(r[f]) - st[f][0]) / st[f][1] for f in b.features] for r in rows])
    few = spark.createDataFrame(rows, b.holdout.schema)

    forest = b.models["random_forest"].stages[-1]
    trees = [t._call_java("rootNode") for t in forest.trees]
    got = {(r.segment_id, r.seq): r for r in BU.score_forest(b, few).collect()}
    names = ML.class_names(b.models["random_forest"])
    for r, v in zip(rows, x, strict=True):
        p = sum(_votes(t, v) for t in trees) / len(trees)
        g = got[r.segment_id, r.seq]
        assert np.allclose(p, g.probability) and names[int(np.argmax(g.probability))] == g.prediction

    mlp = b.models["lstm"].stages[-1]
    layers, w = list(mlp.getLayers()), mlp.weights.toArray()
    win = BU.score_sequences(b, lab)
    raw = ML.sequence_windows(lab, b.features).select("src_ip", "end_segment_id", "end_seq", F.flatten("rows").alias("x"))
    for r in win.join(raw, ["src_ip", "end_segment_id", "end_seq"]).limit(40).collect():
        a, at = np.array(r.x), 0
        for i, (n_in, n_out) in enumerate(zip(layers, layers[1:])):
            m = w[at:at + n_in * n_out].reshape(n_out, n_in, order="F")
            z = m @ a + w[at + n_in * n_out:at + n_in * n_out + n_out]
            at += n_in * n_out + n_out
            a = 1 / (1 + np.exp(-np.clip(z, -700, 700))) if i + 2 < len(layers) else np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(a, r.probability, atol=1e-9)

    ae = b.models["autoencoder"]
    mu, pc = np.array(ae["mu"].first()["mu"]), ae["pca"].pc.toArray()
    err = (((x - mu) - (x - mu) @ pc @ pc.T) ** 2).mean(1)
    got = {(r.segment_id, r.seq): (r.score, r.yhat) for r in BU.score_anomalies(b, few).collect()}
    for r, e in zip(rows, err, strict=True):
        assert got[r.segment_id, r.seq][0] == pytest.approx(e, abs=1e-8)
        assert got[r.segment_id, r.seq][1] == int(got[r.segment_id, r.seq][0] > b.threshold)
