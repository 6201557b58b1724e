"""File readers: flow tables (CSV / Parquet), attack-log text, evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import FLOWS, LABELED_FLOWS
from ..session import cut_lineage


def read_flows_csv(spark: SparkSession, path: str, labeled: bool = False) -> DataFrame:
    """S3: headered flow CSV, columns taken by the names in the header, types fixed (no inference pass).

    The header may hold any subset of the flow columns in any order, a ``label`` after the 22 feature columns, and
    columns of other names (left out).  Columns that the file lacks are NULL.
    """
    want = LABELED_FLOWS if labeled else FLOWS
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    have = {c.strip().lower(): c for c in raw.columns}
    return raw.select(*[(F.expr(f"try_cast(`{have[f.name.lower()]}` as {f.dataType.simpleString()})")
                         if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow table in Parquet (partition pruning on ``segment_id``)."""
    return spark.read.parquet(path)


def read_attack_log_text(spark: SparkSession, path: str) -> DataFrame:
    """Headerless text log -> ``attack_log(line_no, line)`` with exact line numbers.

    Files are read by lines and in blocks, so one large log is spread over tasks.  A line's number is the lines of the
    file's earlier blocks (one row a block) plus its place in its own block, which the row ids of a scan give: they
    grow along a block.  The lines are stored once, because counts and lines must come from the same scan (a log that
    is still written may grow in between).  Several files (rotated logs) are numbered by file name, then line:
    ``line_no`` is the file's place * 2^32 + the line, from 1.
    """
    lines = cut_lineage(spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")))
    blocks = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                           (F.dense_rank().over(Window.orderBy("_file")) - 1).cast("long").alias("_f"))
    return lines.join(blocks, ["_file", "_block"]).select(
        (F.col("_f") * F.lit(1 << 32) + F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """``evaluation_results.csv`` -> rows with missing metrics as 0.0 (the API rule)."""
    df = (spark.read.option("header", True)
          .schema("model string, f1_score double, roc_auc double, false_positive_rate double, confusion_matrix string")
          .csv(path))
    return df.select("model", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                                for c in ("f1_score", "roc_auc", "false_positive_rate")], "confusion_matrix")
