"""Registered queries for sources, sinks, streaming and models.

Each query writes what it needs (capture files, tables, checkpoints) into a fresh folder
under the session's shared checkpoint folder and returns what it reads back, so the
row set can be compared with the batch result (DuckDB oracle where one exists).
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import functions as F

from .. import oracle as O
from ..functions import exprs as X
from ..operators import labels as LB
from ..operators import metrics as MT
from ..operators import ml as ML
from ..schemas import FLOW_COLUMNS, PACKETS
from ..session import checkpoint_dir, cut_lineage, local_path
from ..sources import adapter as AD
from ..sources import files as FS
from ..sources import pcap as PC
from ..sources import sinks as SK
from ..streaming import live as LV
from . import bundle as BU
from . import dashboard as DB
from . import pipeline as PL
from .registry import (_EVAL, _SPLIT, _STATS, FLOW_CHAIN, LAB, LOGD, _CHANGES, class_preds, evaluation_of, flow_preds, labeled_of, packets_of, register, round_doubles, sql,
                       flows_of, fixture_intervals)

FLOW_NO_SEQ = [c for c in FLOW_COLUMNS if c != "seq"]
_FLOW_NO_SEQ_SQL = ", ".join(x for x in O.FLOW_OUT_COLS.split(", ") if x != "seq")


def scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder (never reused, never deleted)."""
    return os.path.join(local_path(checkpoint_dir(spark)), "flowlens-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def _segments(spark, d) -> str:
    path = scratch(spark, "segments")
    PC.register(spark)
    PC.write_segments(packets_of(spark, d), path)
    return path


_PCAP_SQL = sql(O.PACKETS, body="""
select segment_id, t_us, src_ip, src_port, dst_ip, dst_port, proto, len from packets where is_ip""")


# ------------------------------------------------------------------ sources
@register("scan_pcap", sql(O.PACKETS, body="""
select * exclude (is_ip) from (
  select row_number() over (order by pkt_idx) - 1 as pkt_idx, t_us, is_ip, src_ip, src_port, dst_ip, dst_port, proto, len
  from packets) where is_ip"""))
def q_scan_pcap(spark, d):
    """The packets as one capture file, decoded in byte ranges with exact packet numbers."""
    path = scratch(spark, "capture")
    PC.write_capture(packets_of(spark, d), path)
    back = PC.read_captures(spark, path, split_bytes=1 << 17)
    return back.where("is_ip").select("pkt_idx", "t_us", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "len")


@register("stream_segments", _PCAP_SQL)
def q_stream_segments(spark, d):
    """The same files through the streaming reader (availableNow) into a table."""
    seg = _segments(spark, d)
    out, ck = scratch(spark, "stream-out"), scratch(spark, "stream-ck")
    q = (LV.segment_stream(spark, seg, min_age_s=0).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return (spark.read.schema(PACKETS).parquet(out).where("is_ip")
            .select("segment_id", "t_us", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "len"))


@register("settled_files", sql(O.PACKETS, body="""
select distinct 'capture.pcap' || cast(segment_id as varchar) as name, segment_id from packets where segment_id % 10 <> 0"""))
def q_settled_files(spark, d):
    """settled segment files (name has a number, old enough); the file still being written (bare name) and files
    changed a moment ago (here every tenth) are left out."""
    seg = _segments(spark, d)
    open(os.path.join(seg, "capture.pcap"), "wb").close()
    now = time.time()
    for f in PC.list_segments(seg):
        age = 0 if PC.segment_number(f) % 10 == 0 else 60
        os.utime(f, (now - age, now - age))
    files = PC.list_segments(seg, min_age_s=5, now=now)
    return spark.createDataFrame([(os.path.basename(f), PC.segment_number(f)) for f in files],
                                 "name string, segment_id long")


@register("scan_flows_csv", sql(*FLOW_CHAIN, body=f"select {O.FLOW_OUT_COLS} from flows"))
def q_scan_flows_csv(spark, d):
    """S3 + K1 (csv): flow table written as headered CSV, read back with the fixed schema."""
    path = scratch(spark, "flows-csv")
    SK.sink_flows(flows_of(spark, d), path, fmt="csv")
    return round_doubles(FS.read_flows_csv(spark, path))


@register("scan_attack_log", sql(*LOGD, """
numbered as (select line_no as event_line, row_number() over (order by line_no) as file_line from attack_log)""", body="""
select file_line as line_no, ts_us, event, src, dst from log_ev join numbered on event_line = line_no"""))
def q_scan_attack_log(spark, d):
    """The event-derived log written as one ordered text file, read back by lines in blocks with exact numbers."""
    path = scratch(spark, "attack-log")
    log = AD.read_attack_log(spark, d)
    log.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
    back = FS.read_attack_log_text(spark, path)
    return LB.parse_attack_log(back).select("line_no", "ts_us", "event", "src", "dst")


# ------------------------------------------------------------------ sinks
@register("sink_flows", sql(*FLOW_CHAIN, body=f"select {O.FLOW_OUT_COLS} from flows"))
def q_sink_flows(spark, d):
    path = scratch(spark, "flows")
    SK.sink_flows(flows_of(spark, d), path)
    return round_doubles(FS.read_flows(spark, path).select(*FLOW_COLUMNS))


@register("append_flows", sql(*FLOW_CHAIN, body=f"select {O.FLOW_OUT_COLS} from flows"))
def q_append_flows(spark, d):
    """K2: two appends of different periods plus a replay of the second one."""
    path = scratch(spark, "flows-append")
    fl = flows_of(spark, d)
    cut = 1_704_068_400 // 30
    SK.append_flows(fl.where(F.col("segment_id") < cut), path, 0)
    SK.append_flows(fl.where(F.col("segment_id") >= cut), path, 1)
    SK.append_flows(fl.where(F.col("segment_id") >= cut), path, 1)   # replay: no duplicates
    return round_doubles(FS.read_flows(spark, path).select(*FLOW_COLUMNS))


@register("sink_labeled", sql(*LAB, body=f"select {O.FLOW_OUT_COLS}, label from labeled"))
def q_sink_labeled(spark, d):
    path = scratch(spark, "labeled")
    SK.sink_labeled(labeled_of(spark, d), path)
    return round_doubles(FS.read_flows(spark, path).select(*FLOW_COLUMNS, "label"))


@register("relabel_on_change", sql(*LAB, body="select segment_id, seq, label from labeled"))
def q_relabel_on_change(spark, d):
    """T4: flows labelled with an older log (no BRUTEFORCE pair yet), then the log grows;
    only segments overlapping changed intervals are rewritten."""
    fl_path, lab_path = scratch(spark, "relabel-flows"), scratch(spark, "relabel-out")
    SK.append_flows(flows_of(spark, d), fl_path)
    old_log = AD.attack_log_fixture(spark).where(F.col("line_no") <= 11)
    old_iv = LB.attack_intervals(old_log)
    SK.sink_labeled(LB.label_flows(spark.read.parquet(fl_path), old_iv), lab_path, segments_only=False)
    new_iv = fixture_intervals(spark)
    LV.relabel_on_change(spark, fl_path, lab_path, old_iv, new_iv)
    return spark.read.parquet(lab_path).select("segment_id", "seq", "label")



@register("sink_holdout", sql(*LAB, _SPLIT, body=f"""
select {O.FLOW_OUT_COLS}, label from sp where split = 'test'"""))
def q_sink_holdout(spark, d):
    path = scratch(spark, "holdout")
    sp = ML.stratified_split(labeled_of(spark, d))
    SK.sink_holdout(sp.where(F.col("split") == "test").drop("split"), path)
    return round_doubles(spark.read.parquet(path).select(*FLOW_COLUMNS, "label"))


@register("min_rows_gate", sql(*LAB, body="""
select 'sequences>=20' as gate, coalesce(sum(greatest(n - 4, 0)), 0) >= 20 as passed
from (select count(*) as n from labeled group by src_ip)
union all select 'flows>=20', count(*) >= 20 from labeled
union all select 'normal>=1', count(*) >= 1 from labeled where label = 'NORMAL'"""))
def q_min_rows_gate(spark, d):
    """the row-count gates (bounded ``limit(n).count()``)."""
    lab = labeled_of(spark, d)
    win = ML.sequence_windows(lab)
    gates = [("sequences>=20", ML.has_min_rows(win, 20)), ("flows>=20", ML.has_min_rows(lab, 20)),
             ("normal>=1", ML.has_min_rows(ML.normal_only(lab), 1))]
    return spark.createDataFrame(gates, "gate string, passed boolean")


# ------------------------------------------------------------------ streaming
@register("live_flows", sql(*FLOW_CHAIN, body=f"select {_FLOW_NO_SEQ_SQL} from flows"))
def q_live_flows(spark, d):
    """Segment files -> micro-batches -> flows appended (availableNow)."""
    seg, out, ck = _segments(spark, d), scratch(spark, "live-out"), scratch(spark, "live-ck")
    LV.live_flows(spark, seg, out, ck, trigger={"availableNow": True}, min_age_s=0).awaitTermination()
    return round_doubles(spark.read.parquet(out).select(*FLOW_NO_SEQ))


@register("exactly_once_ledger", sql(*FLOW_CHAIN, body=f"select {_FLOW_NO_SEQ_SQL} from flows"))
def q_exactly_once_ledger(spark, d):
    """The same stream started twice on one checkpoint: the second run finds no new
    segments, and a replayed batch would overwrite its own partitions."""
    seg, out, ck = _segments(spark, d), scratch(spark, "ledger-out"), scratch(spark, "ledger-ck")
    for _ in range(2):
        LV.live_flows(spark, seg, out, ck, trigger={"availableNow": True}, min_age_s=0).awaitTermination()
    return round_doubles(spark.read.parquet(out).select(*FLOW_NO_SEQ))


@register("tumbling_segments", sql(*FLOW_CHAIN, body=f"select {O.FLOW_OUT_COLS} from flows"))
def q_tumbling_segments(spark, d):
    """Packet stream -> stateful 30 s segments -> flows; two closing packets in files of their own move the
    watermark past the input, so its last segments are closed too (their own flows are left out)."""
    src, out, ck = scratch(spark, "pk-stream"), scratch(spark, "tumble-out"), scratch(spark, "tumble-ck")
    pk = packets_of(spark, d)
    for part in (pk.repartition("segment_id"), LV.closing_packet(pk, 86400.0), LV.closing_packet(pk, 172800.0)):
        part.write.mode("append").parquet(src)
    ps = spark.readStream.schema(PACKETS).parquet(src)
    LV.tumbling_to_table(ps, out, ck, trigger={"availableNow": True}).awaitTermination()
    back = spark.read.parquet(out).where(~F.col("src_ip").eqNullSafe(LV.CLOSING_SRC))
    return round_doubles(back.select(*FLOW_COLUMNS))


@register("retrain_every_n", sql(O.PACKETS, body="""
select segment_id, row_number() over (order by segment_id nulls first) % 5 = 0 as retrain
from (select distinct segment_id from packets)"""))
def q_retrain_every_n(spark, d):
    """T5: retrain decision after each new segment (every 5 segments), for all segments of the capture."""
    return LV.retrain_flags(packets_of(spark, d))


@register("status_event_stream", sql(*LAB, _CHANGES, body="""
select strftime(t, '%Y-%m-%dT%H:%M:%S.%f') as t, level, msg from change_ev"""))
def q_status_event_stream(spark, d):
    """Label changes per source from a stream of labelled flows (keyed state), one file for each micro-batch in
    whatever order the files come; two closing rows move the watermark past the input."""
    src, out, ck = scratch(spark, "lab-stream"), scratch(spark, "status-out"), scratch(spark, "status-ck")
    lab = labeled_of(spark, d).withColumn("start_us", F.round(F.col("start_time") * F.lit(1e6)).cast("long"))
    for part in (lab.repartitionByRange(3, "start_time"), LV.closing_row(lab, 86400.0), LV.closing_row(lab, 172800.0)):
        part.write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (LV.status_event_stream(s, lateness="2 hours").writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select(X.utc_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"), "level", "msg")


@register("stream_dedupe", sql(*LAB, _CHANGES, body="""
select distinct strftime(t, '%Y-%m-%dT%H:%M:%S.%f') as t, level, msg from change_ev"""))
def q_stream_dedupe(spark, d):
    """Every change event arrives twice; the stream keeps one of each."""
    src, out, ck = scratch(spark, "ev-stream"), scratch(spark, "dedupe-out"), scratch(spark, "dedupe-ck")
    ev = DB.change_events(labeled_of(spark, d))
    ev.unionByName(ev).write.parquet(src)
    s = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = (LV.stream_dedupe(s).writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select(X.utc_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"), "level", "msg")


@register("stream_label", sql(*LAB, body="select segment_id, seq, label from labeled"))
def q_stream_label(spark, d):
    """A stream of flows labelled batch by batch against the intervals; the flows of each segment are spread over
    four files, one file for each micro-batch."""
    src, out, ck = scratch(spark, "flow-stream"), scratch(spark, "label-out"), scratch(spark, "label-ck")
    flows_of(spark, d).repartition(4, "src_port", "dst_ip").write.parquet(src)
    s = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    LV.stream_label(s, fixture_intervals(spark), out, ck, trigger={"availableNow": True}).awaitTermination()
    return spark.read.parquet(out).select("segment_id", "seq", "label")


@register("live_loop", sql(*LAB, body="""
select segment_id, src_ip, src_port, dst_ip, dst_port, proto, total_packets, label, cast(2 as bigint) as evaluations
from labeled"""))
def q_live_loop(spark, d):
    """T1 + T4 + T5 composed: all segments come in two runs of the loop, the attack log grows before the second, and every
    40 segments models are trained, published and evaluated; flows and labels are those of the batch."""
    from ..streaming import loop as LP
    seg, root, ck = _segments(spark, d), scratch(spark, "loop"), scratch(spark, "loop-ck")
    log, arrived = os.path.join(root, "attack_log"), os.path.join(root, "segments")
    os.makedirs(arrived)
    files = PC.list_segments(seg)
    for run in range(2):
        lines = AD.attack_log_fixture(spark)
        lines = lines.where(F.col("line_no") <= 11) if run == 0 else lines
        lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(log)
        for f in files[run * len(files) // 2:(run + 1) * len(files) // 2]:
            os.link(f, os.path.join(arrived, os.path.basename(f)))
            os.utime(f, (0, time.time() - 60))
        LP.live_loop(spark, arrived, log, root, ck, every=40, trigger={"availableNow": True}, rf_trees=5, rf_depth=5,
                     seq_iter=5).awaitTermination()
    n = spark.read.parquet(f"{root}/evaluation").agg(F.count_distinct("batch").alias("evaluations"))
    return spark.read.parquet(f"{root}/labeled").crossJoin(F.broadcast(n)).select(
        "segment_id", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "total_packets", "label", "evaluations")


# ------------------------------------------------------------------ models
def _bundle(spark, d, **train):
    """Labelled table, a training run over it, and the bundle read back after publishing it."""
    lab = labeled_of(spark, d)
    res = PL.train_models(lab, **train)
    root = scratch(spark, "models")
    return lab, res, BU.load_bundle(spark, root, BU.save_bundle(spark, res, root))


#: Smaller models for the queries that are about storing and loading them.
_SMALL = {"rf_trees": 20, "rf_depth": 10, "seq_iter": 20}


@register("random_forest")
def q_random_forest(spark, d):
    """M3: 200 trees, depth 20, balanced weights; holdout predictions."""
    lab = labeled_of(spark, d)
    sp = cut_lineage(ML.stratified_split(lab))
    feats = ML.select_features(lab)
    train, test = sp.where("split = 'train'"), sp.where("split = 'test'")
    st = ML.scaler_stats(train, feats)
    rf = ML.train_random_forest(ML.scale_features(train, st, feats), feats)
    return ML.predict_table(rf, ML.scale_features(test, st, feats)).select("segment_id", "seq", "label", "prediction")


@register("sequence_classifier")
def q_sequence_classifier(spark, d):
    """M4: MLP on flattened 5-flow windows (stand-in for the recurrent model)."""
    from pyspark.ml.functions import array_to_vector
    win = cut_lineage(ML.random_split(ML.sequence_windows(labeled_of(spark, d)), ["src_ip", "end_segment_id", "end_seq"]))
    k = win.select("label").distinct().count()
    m = ML.train_sequence_classifier(win.where("split = 'train'"), k)
    test = win.where("split = 'test'").withColumn("features", array_to_vector(F.flatten("rows")))
    return ML.predict_table(m, test).select("src_ip", "end_segment_id", "end_seq", "label", "prediction")


def _anomaly(spark, d):
    lab = labeled_of(spark, d)
    sp = cut_lineage(ML.stratified_split(lab))
    feats = ML.select_features(lab)
    train, test = sp.where("split = 'train'"), sp.where("split = 'test'")
    st = ML.scaler_stats(train, feats)
    normal = ML.scale_features(ML.normal_only(train), st, feats)
    model = ML.train_anomaly_model(normal, feats)
    thr = ML.anomaly_threshold(ML.anomaly_errors(model, normal))
    return model, thr, ML.scale_features(test, st, feats)


@register("anomaly_model")
def q_anomaly_model(spark, d):
    """M5: PCA reconstruction error of NORMAL rows, threshold mean + 3 std, flags."""
    model, thr, test = _anomaly(spark, d)
    e = ML.anomaly_errors(model, test).crossJoin(F.broadcast(thr))
    return e.select("segment_id", "seq", "label", "error", (F.col("error") > F.col("threshold")).cast("int").alias("flag"))


@register("predict_table")
def q_predict_table(spark, d):
    """M6: the stored holdout scored by the stored forest (class and probabilities as text)."""
    _, _, b = _bundle(spark, d, **_SMALL)
    p = F.transform("probability", lambda x: F.format_string("%.6f", x))
    return BU.score_forest(b, b.holdout).select("segment_id", "seq", "label", "prediction",
                                                F.array_join(p, ",").alias("probability"))


@register("evaluate_models")
def q_evaluate_models(spark, d):
    """M7: all three models trained, published and loaded; an evaluation row each from the bundle alone (matrix as text)."""
    from ..operators.metrics import matrix_text
    lab, _, b = _bundle(spark, d)
    return BU.evaluate_bundle(b, lab).select("model", "f1_score", "roc_auc", "false_positive_rate",
                                             matrix_text().alias("confusion_matrix"))


@register("sink_models", sql(*LAB, _SPLIT, _STATS, body=f"""
select cast(idx as integer) as idx, feature, {O.r6('mean')}, {O.r6('std')}, {O.r6('scale')}, true as threshold_kept,
       'autoencoder,lstm,random_forest' as models from stats"""))
def q_sink_models(spark, d):
    """K5: everything trained is published; the scaler's statistics as stored, the models' names and the threshold."""
    _, res, b = _bundle(spark, d, **_SMALL)
    return round_doubles(b.stats.select(F.col("idx").cast("int").alias("idx"), "feature", "mean", "std", "scale")).select(
        "*", F.lit(b.threshold == res.threshold).alias("threshold_kept"), F.lit(",".join(sorted(b.models))).alias("models"))


@register("load_models", sql(*LAB, _SPLIT, body="""
select segment_id, seq, label, true as same_class, true as same_flag from sp where split = 'test'"""))
def q_load_models(spark, d):
    """The loaded models score the stored holdout as the models in memory did, row by row."""
    _, res, b = _bundle(spark, d, **_SMALL)
    key = ["segment_id", "seq"]
    classes = BU.score_forest(b, b.holdout).join(res.predictions["random_forest"].select(
        *key, F.col("prediction").alias("p"), F.col("probability").alias("q")), key)
    flags = BU.score_anomalies(b, b.holdout).join(res.predictions["autoencoder"].select(
        *key, F.col("yhat").alias("f"), F.col("score").alias("s")), key)
    near = F.forall(F.zip_with("probability", "q", lambda x, y: F.abs(x - y) < 1e-12), lambda x: x)
    return classes.select(*key, "label", ((F.col("prediction") == F.col("p")) & near).alias("same_class")).join(
        flags.select(*key, ((F.col("yhat") == F.col("f")) & (F.abs(F.col("score") - F.col("s")) < 1e-9)).alias("same_flag")),
        key)


def _eval_written(spark, d):
    """Evaluation rows of the stand-in predictions with their matrices, written as CSV."""
    preds = class_preds(spark, d).select("model", "label", "prediction").unionByName(
        flow_preds(spark, d).select("model", "label", "prediction"))
    path = scratch(spark, "eval")
    SK.sink_eval(evaluation_of(spark, d).join(MT.confusion_matrix(preds), "model"), path, fmt="csv")
    return FS.read_eval_results(spark, path)


@register("sink_eval", sql(O.CLASS_PRED, *LAB, O.FLOW_PRED, _EVAL, body=f"""
select e.model, {O.r6('coalesce(f1_score, 0)', 'f1_score')}, {O.r6('coalesce(roc_auc, 0)', 'roc_auc')},
       {O.r6('coalesce(false_positive_rate, 0)', 'false_positive_rate')}, confusion_matrix
from evaluation e join (select * from {O.matrix_text_sql(O.grid_sql('cpred', 'model'), 'model')}
                        union all select * from {O.matrix_text_sql(O.grid_sql('fpred2', 'model'), 'model')}) m
  on e.model = m.model"""))
def q_sink_eval(spark, d):
    """K6 + S5: the evaluation CSV with its confusion matrices, read back."""
    return round_doubles(_eval_written(spark, d))


@register("scan_eval_results", sql(O.CLASS_PRED, *LAB, O.FLOW_PRED, _EVAL, body=f"""
select model, {O.r6('coalesce(f1_score, 0)', 'f1_score')}, {O.r6('coalesce(roc_auc, 0)', 'roc_auc')},
       {O.r6('coalesce(false_positive_rate, 0)', 'false_positive_rate')} from evaluation"""))
def q_scan_eval_results(spark, d):
    """Evaluation CSV -> map<model, metrics> (missing metric = 0)."""
    back = _eval_written(spark, d)
    m = DB.models(back.select("model", "f1_score", "roc_auc", "false_positive_rate"))
    return round_doubles(m.select(F.explode("models").alias("model", "v")).select("model", "v.*"))



@register("assemble_vector", sql(*LAB, body="""
select segment_id, seq, cast(idx as integer) as idx, """ + O.r6("v", "value") + """
from (select segment_id, seq, unnest(range(15)) as idx,
             unnest([""" + ", ".join(f"cast({f} as double)" for f in O.FEATURE_LIST) + """]) as v from labeled)"""))
def q_assemble_vector(spark, d):
    """The 15 features as one ML vector (VectorAssembler), shown in long form."""
    from pyspark.ml.functions import vector_to_array
    lab = labeled_of(spark, d)
    feats = ML.select_features(lab)
    v = ML._assembled(lab, feats).select("segment_id", "seq", vector_to_array("features").alias("x"))
    return round_doubles(v.select("segment_id", "seq", F.posexplode("x").alias("idx", "value"))
                         .select("segment_id", "seq", F.col("idx").cast("int"), "value"))
