"""Helpers shared by the operators: text batches, shared scratch tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import checkpoint_dir, cut_lineage

#: Documents are handled in slices of at most this many bytes of text, so that a Python worker's memory
#: does not follow the Arrow batch size (a single longer document is a slice of its own).
SLICE_BYTES = 2 << 20
#: Row groups of lean scratch tables.
ROW_GROUP_BYTES = 16 << 20


class Numbered(dict):
    """Key -> number; an unknown key gets the next number and is noted in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, list]]:
    """(ids, texts as str or None) in slices of at most ``limit`` bytes; column 0 is the id, column 1 the text."""
    for b in batches:
        ids, text = b.column(0), b.column(1)
        size = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
        ends, start = np.cumsum(size), 0
        while start < len(size):
            base = ends[start] - size[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield ids.slice(start, stop - start), text.slice(start, stop - start).to_pylist()
            start = stop


def map_text(docs: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``mapInArrow`` over (id as long, text as string) only, so other columns and their names do not matter."""
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(fn, schema)


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                                       for c, f in zip(cols, schema, strict=True)], schema=schema)


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[list[str]]:
    """Drop the scratch tables that are made inside when it ends well; the yielded list names them, and a table that a
    result is read from later is to be taken off it."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, lean: bool = False, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it again: lineage ends there, column
    pruning and filters reach the files, and a lost executor loses nothing.  ``lean``, for passes that write many
    tables of texts: small row groups, as a writing task holds one in memory, and a collection of the driver's garbage,
    because Spark deletes a shuffle's files when the driver drops its handle.  ``path``: where, if not in a new folder."""
    path = path or scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", str(ROW_GROUP_BYTES)) if lean else writer).parquet(path)
    if lean:
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", kind: str = "long") -> DataFrame:
    """Connected components of an undirected edge list -> (node, component = smallest reachable node); nodes are of the
    ordered type ``kind``.

    Alternating large-star / small-star rounds: each is one grouped minimum plus one join on the node, so no
    node's neighbours are gathered in one row and a hub is split by AQE.  Ends when all components are stars; the
    rounds grow with the logarithm of the graph's diameter.
    """
    e = stored(edges.select(F.col(a).cast(kind).alias("u"), F.col(b).cast(kind).alias("v"))
               .where("u is not null and v is not null and u <> v")
               .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = stored(small, "cc")
        # done when every node hangs on one centre and no centre hangs on another: each node is seen once as a leaf
        seen = e.select(F.col("u").alias("n"), F.lit(1).alias("leaf")).unionByName(
            e.select(F.col("v").alias("n"), F.lit(0).alias("leaf")).distinct())
        if seen.groupBy("n").agg(F.sum("leaf").alias("l"), F.count("*").alias("c")).where(
                "l > 1 or (l > 0 and c > l)").limit(1).count() == 0:
            break
    star = e.groupBy("u").agg(F.min("v").alias("m"))
    return (star.select(F.col("u").alias("node"), F.col("m").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
                         .join(star.select(F.col("u").alias("node")), "node", "left_anti")))


__all__ = ["Numbered", "text_slices", "map_text", "batch", "scratch_path", "stored", "components", "cut_lineage", "SLICE_BYTES"]
