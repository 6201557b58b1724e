import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.operators import flows as FL
from flowlens.schemas import PACKETS
from flowlens.sources import adapter as AD
from flowlens.sources import pcap as PC
from flowlens.streaming import live as LV

SF = "/root/testdata/sf0.001"


def test_live_stream_equals_batch_and_restart_does_not_duplicate(spark, tmp):
    pk = AD.read_packets(spark, SF)
    PC.register(spark)
    PC.write_segments(pk, os.path.join(tmp, "seg"))
    out, ck = os.path.join(tmp, "flows"), os.path.join(tmp, "ck")
    for _ in range(2):
        LV.live_flows(spark, os.path.join(tmp, "seg"), out, ck, trigger={"availableNow": True},
                      min_age_s=0).awaitTermination()
    got = spark.read.parquet(out)
    ref = FL.flow_extract(pk)
    cols = [c for c in ref.columns if c != "seq"]
    assert got.count() == ref.count() == 894
    assert ref.select(cols).exceptAll(got.select(cols)).count() == 0


def test_tumbling_stream_matches_batch_for_closed_segments(spark, tmp):
    pk = AD.read_packets(spark, SF)
    src = os.path.join(tmp, "pk")
    pk.repartition(4, "segment_id").write.parquet(src)
    s = spark.readStream.schema(PACKETS).parquet(src)
    out = os.path.join(tmp, "out")
    LV.tumbling_to_table(s, out, os.path.join(tmp, "ck"), trigger={"availableNow": True}).awaitTermination()
    got = spark.read.parquet(out)
    segs = [r[0] for r in got.select("segment_id").distinct().collect()]
    assert len(segs) >= 80
    ref = FL.flow_extract(pk).where(F.col("segment_id").isin(segs))
    r = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    cols = ref.columns
    assert r(ref.select(cols)).exceptAll(r(got.select(cols))).count() == 0


def test_tumbling_stream_takes_gaps_of_late_packets_and_closes_the_input(spark, tmp):
    from helpers import packets_df
    a, b = ("10.0.0.1", 1, "10.0.1.1", 80, 6), ("10.0.0.1", 2, "10.0.1.2", 80, 6)
    pk = packets_df(spark, [(1, *a, 60), (2, *b, 70), (4, *a, 61), (9, *a, 65), (16, *a, 90), (17, *b, 50), (33, *a, 40)])
    pk = pk.withColumn("segment_id", F.floor(F.col("t_us") / 30_000_000).cast("long"))
    src, out = os.path.join(tmp, "pk"), os.path.join(tmp, "out")
    for some in ((0, 4), (5, 6), (2,), (1, 3)):  # one micro-batch each, times out of order inside the watermark
        pk.where(F.col("pkt_idx").isin(*some)).coalesce(1).write.mode("append").parquet(src)
    for after in (1e5, 2e5):
        LV.closing_packet(pk, after).write.mode("append").parquet(src)
    s = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(src)
    LV.tumbling_to_table(s, out, os.path.join(tmp, "ck"), trigger={"availableNow": True}).awaitTermination()
    ref = FL.flow_extract(pk)
    got = spark.read.parquet(out).where(F.col("src_ip") != LV.CLOSING_SRC)
    r = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in row)
                          for row in df.select(*ref.columns).collect())
    assert len(r(ref)) == 3 and r(got) == r(ref)


def test_stream_dedupe(spark, tmp):
    rows = [("2024-01-01 00:00:01", "ok", "a"), ("2024-01-01 00:00:01", "ok", "a"), ("2024-01-01 00:00:02", "ok", "b")]
    src = os.path.join(tmp, "ev")
    spark.createDataFrame(rows, "t string, level string, msg string").withColumn("t", F.to_timestamp("t")).write.parquet(src)
    s = spark.readStream.schema("t timestamp, level string, msg string").parquet(src)
    out = os.path.join(tmp, "out")
    (LV.stream_dedupe(s).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", os.path.join(tmp, "ck")).trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(out).count() == 2


def test_retrain_counter(spark, tmp):
    p = os.path.join(tmp, "state")
    got = [LV.retrain_due(spark, p, 1, every=3) for _ in range(7)]
    assert got == [False, False, True, False, False, True, False]


def test_retrain_flags_cover_all_segments_as_the_counter_does(spark, tmp):
    from flowlens.plans import registry_io as IO
    segs = [-3, 0, 1, 2, 7, 8, 9, 10, 4095, 4096, 4097, 9000, 9001, 20000, 20001, 20002]
    df = spark.createDataFrame([(s,) for s in segs * 2], "segment_id long")
    got = [(r.segment_id, r.retrain) for r in LV.retrain_flags(df, every=3).orderBy("segment_id").collect()]
    state = os.path.join(tmp, "state")
    assert got == [(s, LV.retrain_due(spark, state, 1, every=3)) for s in segs]
    rows = sorted((r.segment_id, r.retrain) for r in IO.q_retrain_every_n(spark, SF).collect())
    want = sorted(r[0] for r in AD.read_packets(spark, SF).select("segment_id").distinct().collect())
    assert len(want) > 12 and rows == [(s, i % 5 == 0) for i, s in enumerate(want, 1)]


def _labelled(spark):
    from flowlens.operators import labels as LB
    flows = FL.flow_extract(AD.read_packets(spark, SF))
    iv = LB.attack_intervals(AD.attack_log_fixture(spark))
    return flows, iv, LB.label_flows(flows, iv)


def _rows(df):
    return sorted((r.segment_id, r.seq, r.label) for r in df.select("segment_id", "seq", "label").collect())


def test_stream_label_keeps_all_batches_of_a_segment(spark, tmp):
    flows, iv, want = _labelled(spark)
    src, out = os.path.join(tmp, "flows"), os.path.join(tmp, "out")
    flows.repartition(4, "src_port", "dst_ip").write.parquet(src)
    s = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):  # the second run has nothing to do
        LV.stream_label(s, iv, out, os.path.join(tmp, "ck"), trigger={"availableNow": True}).awaitTermination()
    assert _rows(spark.read.parquet(out)) == _rows(want)


def test_relabel_first_run_and_log_change_on_file_numbers(spark, tmp):
    from flowlens.operators import labels as LB
    flows, iv, _ = _labelled(spark)
    flows = flows.withColumn("segment_id", F.dense_rank().over(Window.orderBy("segment_id")).cast("long"))
    path, out = os.path.join(tmp, "flows"), os.path.join(tmp, "out")
    flows.write.partitionBy("segment_id").parquet(path)
    old = LB.attack_intervals(AD.attack_log_fixture(spark).where(F.col("line_no") <= 11))
    LV.relabel_on_change(spark, path, out, None, old)
    assert _rows(spark.read.parquet(out)) == _rows(LB.label_flows(flows, old))
    LV.relabel_on_change(spark, path, out, old, iv)
    assert _rows(spark.read.parquet(out)) == _rows(LB.label_flows(flows, iv))


def test_capture_stream_takes_a_late_lower_number(tmp):
    import time
    r = PC.PcapStreamReader({"path": tmp, "min_age_s": "5"})
    data = PC.pcap_bytes([(1_000_000, True, "10.0.0.1", 1, "10.0.0.2", 2, 6, 60)])

    def put(n, age):
        with open(os.path.join(tmp, f"capture.pcap{n}"), "wb") as f:
            f.write(data)
        os.utime(f.name, (time.time() - age,) * 2)
    put(0, 60)
    put(5, 60)
    put(4, 0)  # still written
    first = r.latestOffset()
    assert [p.segment_id for p in r.partitions(r.initialOffset(), first)] == [0, 5]
    put(4, 60)
    put(1, 60)
    second = r.latestOffset()
    assert [p.segment_id for p in r.partitions(first, second)] == [1, 4]
    assert r.partitions(second, r.latestOffset()) == []


def test_status_stream_orders_across_batches_and_keeps_null_as_a_status(spark, tmp):
    rows = [("a", 10.0, 1, 1, "NORMAL"), ("a", 30.0, 1, 3, "NORMAL"), ("a", 20.0, 1, 2, "RECON"), ("a", 40.0, 1, 4, None),
            ("b", 5.0, 1, 5, "RECON"), ("b", 50.0, 1, 6, "SCAN"), ("a", 45.0, 1, 7, "NORMAL"), (None, 1.0, 1, 8, "SCAN")]
    ddl = "src_ip string, start_time double, segment_id long, seq long, label string"
    src, out = os.path.join(tmp, "src"), os.path.join(tmp, "out")
    df = spark.createDataFrame(rows, ddl)
    for r in rows:  # one micro-batch for each row, times out of order
        spark.createDataFrame([r], ddl).coalesce(1).write.mode("append").parquet(src)
    for after in (1e5, 2e5):
        LV.closing_row(df, after).write.mode("append").parquet(src)
    s = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    (LV.status_event_stream(s, "60 seconds").writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", os.path.join(tmp, "ck")).trigger(availableNow=True).start().awaitTermination())
    got = sorted((r.msg, r.level) for r in spark.read.parquet(out).collect())
    assert got == sorted([("a · NORMAL → RECON", "attack"), ("a · RECON → NORMAL", "ok"), ("a · NORMAL → NULL", "ok"),
                          ("b · RECON → SCAN", "warn")])
