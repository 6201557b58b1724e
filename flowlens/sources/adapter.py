"""Driver tables -> the inputs of the flow pipeline.

``packets`` is derived from ``events`` row by row (no shuffle): the 30 days of events are
compressed 1000x so that 30 s capture segments and the 10 s entropy window hold several
packets.  ``t_us`` is absolute epoch microseconds (2024-01-01T00:00:00Z + offset), so the
attack log's absolute timestamps and the flows share one clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SEGMENT_S, US
from .tables import read_table

# --- fixed values of the adapter -----------------------------------------------------
EPOCH_2024_US = 1_704_067_200 * US   # 2024-01-01T00:00:00Z
TIME_COMPRESSION = 1000
ATTACK_NAMES = ("RECON", "BRUTEFORCE", "C2_BEACON", "EXFIL_RANSOMWARE")
# The hand-written attack log fixture (line number, text); covers every parsing rule.
ATTACK_LOG_FIXTURE = (
    (1, "2024-01-01T00:03:00Z,RECON_START,10.0.0.1,10.0.1.0"),
    (2, "2024-01-01T00:04:00Z,RECON_END,10.0.0.1,10.0.1.0"),
    (3, ""),
    (4, "bad-time,RECON_START,10.0.0.1,10.0.1.0"),
    (5, "2024-01-01T00:10:00Z,BRUTEFORCE_END,10.0.0.2,10.0.1.1"),
    (6, "2024-01-01T00:11:00Z,C2_BEACON_START,10.0.0.3,10.0.1.2"),
    (7, "2024-01-01T00:12:00Z,EXFIL_RANSOMWARE_START,10.0.0.3,10.0.1.2"),
    (8, "2024-01-01T00:12:30Z,EXFIL_RANSOMWARE_START,10.0.0.3,10.0.1.2"),
    (9, "2024-01-01T00:13:00Z,EXFIL_RANSOMWARE_END,10.0.0.3,10.0.1.2"),
    (10, "2024-01-01T00:14:00Z,C2_BEACON_END,10.0.0.3,10.0.1.2"),
    (11, "2024-01-01T00:15:00Z,EXFIL_RANSOMWARE_END,10.0.0.3,10.0.1.2"),
    (12, "2024-01-01T00:20:00Z,BRUTEFORCE_START,10.0.0.2,10.0.1.1"),
    (13, "2024-01-01T00:22:00Z,BRUTEFORCE_END,10.0.0.2,10.0.1.1"),
    (14, "2024-01-01T00:40:00Z,RECON_START,10.0.0.1,10.0.1.0"),
    (15, "2024-01-01T00:41:00Z,RECON_END,10.0.0.1"),
)
# -------------------------------------------------------------------------------------


def _k(props: Column) -> Column:
    """``props.k`` as INT, parsed once per row (``from_json`` with a one-field schema)."""
    return F.from_json(props, "k int")["k"]


def _offset_us(ts: Column) -> Column:
    """Compressed offset from 2024-01-01 in microseconds (integer arithmetic).

    ``events.ts`` is a wall-clock UTC timestamp without zone (TIMESTAMP_NTZ): the
    difference to 2024-01-01 is taken between NTZ values, so the session time zone does
    not enter."""
    raw = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), ts.cast("timestamp_ntz"))
    return F.floor(raw / F.lit(TIME_COMPRESSION)).cast("long")


def packets_from_events(events: DataFrame) -> DataFrame:
    """``events(event_id, ts, user_id, event_type, value, props)`` -> ``packets``."""
    # parse props and the time once; the projections below reference them several times
    e = events.select("event_id", "user_id", "event_type", "value", _k(F.col("props")).alias("_k"),
                      (_offset_us(F.col("ts")) + F.lit(EPOCH_2024_US)).alias("t_us"))
    k = F.col("_k")
    et = F.col("event_type")
    src_port = F.when(et == "error", F.lit(0)).otherwise(F.lit(40000) + (F.col("user_id") % 2).cast("int"))
    dst_port = (F.when(et == "error", 0).when(et == "purchase", 53).when(et == "signup", 1883)
                .when(et == "view", 443).when(k >= 90, 4444).otherwise(80))
    proto = F.when(et == "error", 1).when(et == "purchase", 17).otherwise(6)
    seg = F.floor(F.col("t_us") / F.lit(SEGMENT_S * US)).cast("long")
    return e.select(
        seg.alias("segment_id"),
        F.col("event_id").alias("pkt_idx"),
        "t_us",
        (F.col("value") >= 1.0).alias("is_ip"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string")).alias("src_ip"),
        src_port.cast("int").alias("src_port"),
        F.concat(F.lit("10.0.1."), (k % 3).cast("string")).alias("dst_ip"),
        dst_port.cast("int").alias("dst_port"),
        proto.cast("int").alias("proto"),
        (F.lit(60) + F.floor(F.col("value")).cast("int")).cast("int").alias("len"),
    )


def read_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(read_table(spark, sf_dir, "events"))


def attack_log_fixture(spark: SparkSession) -> DataFrame:
    """The hand-written 15-line log as ``attack_log(line_no, line)``."""
    return spark.createDataFrame(list(ATTACK_LOG_FIXTURE), "line_no long, line string")


def attack_log_from_events(events: DataFrame) -> DataFrame:
    """An attack log that grows with ``events``: one line per event, in event order.

    Attack name from ``k % 4``, START for even users and END for odd ones, the event's
    compressed time as ISO-8601 text.  Rule-made malformed lines: ``error`` events with
    value < 3 carry a bad timestamp, ``click`` events with value < 3 lose their last field,
    ``view`` events with value < 2 are blank.
    """
    e = events.select("event_id", "user_id", "event_type", "value", _k(F.col("props")).alias("_k"),
                      F.floor(_offset_us(F.col("ts")) / F.lit(US)).cast("long").alias("_secs"))
    ntz = F.timestamp_add("SECOND", F.col("_secs"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    e = e.select("*", F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_ts_text"))
    k, ts_text = F.col("_k"), F.col("_ts_text")
    names = F.array(*[F.lit(n) for n in ATTACK_NAMES])
    event = F.concat(F.element_at(names, (k % 4 + 1).cast("int")),
                     F.when(F.col("user_id") % 2 == 0, F.lit("_START")).otherwise(F.lit("_END")))
    src = F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string"))
    dst = F.concat(F.lit("10.0.1."), (k % 3).cast("string"))
    et, v = F.col("event_type"), F.col("value")
    line = (F.when((et == "view") & (v < 2), F.lit(""))
            .when((et == "error") & (v < 3), F.concat_ws(",", F.lit("bad-time"), event, src, dst))
            .when((et == "click") & (v < 3), F.concat_ws(",", ts_text, event, src))
            .otherwise(F.concat_ws(",", ts_text, event, src, dst)))
    return e.select(F.col("event_id").alias("line_no"), line.alias("line"))


def read_attack_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack_log_from_events(read_table(spark, sf_dir, "events"))


# --- stand-in prediction tables for the metric queries --------------------------------
CLASS_COUNT = 10


def class_predictions(embeddings: DataFrame) -> DataFrame:
    """Multi-class stand-in from ``embeddings(vec_id, label)``: integer class scores
    ``s_c = (vec_id*7 + c*13) % 23 + 10*[c = label]``, probability ``s_c / sum(s)``,
    prediction = first class with the largest score.  Class names ``C0``..``C9``."""
    vid, lab = F.col("vec_id"), F.col("_lab")
    base = embeddings.select("vec_id", F.col("label").alias("_lab"))
    s = F.transform(F.sequence(F.lit(0), F.lit(CLASS_COUNT - 1)),
                    lambda c: ((vid * 7 + c * 13) % 23 + F.when(c == lab, 10).otherwise(0)).cast("double"))
    scored = base.select("vec_id", "_lab", s.alias("_s"))
    total = F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + x)
    arg = F.array_position("_s", F.array_max("_s")) - 1
    return scored.select(
        F.lit("class_rule").alias("model"), F.col("vec_id").alias("row_id"),
        F.concat(F.lit("C"), F.col("_lab").cast("string")).alias("label"),
        F.concat(F.lit("C"), arg.cast("string")).alias("prediction"),
        F.transform("_s", lambda x: x / total).alias("probability"))


def flow_predictions(labeled: DataFrame) -> DataFrame:
    """Binary stand-in predictions on labelled flows: ``port_rule`` flags an uncommon
    destination port (score = the flag), ``entropy_rule`` flags destination entropy > 1
    (score = the entropy).  ``y`` = 0 for NORMAL, 1 otherwise (NULL label = attack)."""
    y = F.when(F.col("label").eqNullSafe("NORMAL"), 0).otherwise(1)
    base = labeled.select("segment_id", "seq", y.alias("y"), "uncommon_port", "dst_ip_entropy")
    port = base.select(F.lit("port_rule").alias("model"), "segment_id", "seq", "y",
                       F.col("uncommon_port").alias("yhat"), F.col("uncommon_port").cast("double").alias("score"))
    # score: entropy to 9 decimals, so equal entropies tie in every engine
    ent_score = F.floor(F.col("dst_ip_entropy") * F.lit(1e9) + F.lit(0.5)).cast("double") / F.lit(1e9)
    ent = base.select(F.lit("entropy_rule").alias("model"), "segment_id", "seq", "y",
                      (F.col("dst_ip_entropy") > 1.0).cast("int").alias("yhat"), ent_score.alias("score"))
    out = port.unionByName(ent)
    name = F.when(F.col("y") == 1, F.lit("ATTACK")).otherwise(F.lit("NORMAL"))
    pname = F.when(F.col("yhat") == 1, F.lit("ATTACK")).otherwise(F.lit("NORMAL"))
    return out.withColumn("label", name).withColumn("prediction", pname)
