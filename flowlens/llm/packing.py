"""Best-fit packing of documents into sequences under token, document-count and attention-cost capacities.

A document's ids (plus an end id) are cut into pieces of at most ``tokens`` ids, a longer document into full pieces
with the remainder first.  A piece's demand on a sequence is the vector (length, 1, length^2): tokens, documents,
attention cost of a block-diagonal mask.  It depends on the length only, so the vector best-fit runs on the counts
per length - at most ``tokens`` rows at any corpus size: lengths in falling order; for each, among the open sequences
(kept as ranges with one residual vector) that fit under every constraint the best by ``rule``: ``norm`` takes the
least weighted norm of what would remain, ``dot`` the largest weighted dot product of demand and residual; new
sequences are opened when none fits.  Each piece then finds its place from its rank among the pieces of its length;
ranks are counted per (length, hash part) and offset by a small table, so a length that a third of all pieces share
is still spread over many tasks.

Defined cases: null or empty text is a document of the end id alone; ties and repeated rows each get a place of their
own; an empty table packs to no rows; a null doc_id is kept as null; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import batch, map_text, stored, text_slices
from flowlens.llm.encoding import LEAN_MEMO_UNITS, MEMO_UNITS, encoder

#: Rows of one ranking task; the number of hash parts follows from it.
RANK_ROWS = 20_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, documents (pieces), and attention cost (sum of squared lengths)."""
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    def demand(self, length: int) -> np.ndarray:
        return np.array([length / self.tokens, 1 / self.documents, length * length / self.attention])


def pieces(docs: DataFrame, tokenizer: str, end_id: int, tokens: int, with_ids: bool = True, id_col: str = "doc_id",
           text_col: str = "text", lean: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (``with_ids``) ids as little-endian unsigned 32-bit binary; ``lean``:
    a worker remembers fewer words, and none when a task has ended."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, LEAN_MEMO_UNITS if lean else MEMO_UNITS), np.array([end_id], dtype="<u4")
        for doc_ids, texts in text_slices(batches):
            ids, ends = enc.encode(texts)
            ids, prev, rows = ids.astype("<u4"), 0, []
            for doc, e in zip(doc_ids.to_pylist(), ends.tolist(), strict=True):
                own = np.concatenate([ids[prev:e], end])
                prev, start = e, 0
                cut = len(own) % tokens or tokens
                for k in range(-(-len(own) // tokens)):
                    raw = own[start:cut].tobytes()
                    rows.append((doc, k, start, cut - start, zlib.crc32(raw), raw)[:len(fields)])
                    start, cut = cut, cut + tokens
            yield batch(schema, *map(list, zip(*rows, strict=True)))
        if lean:
            enc.clear()

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_text(docs, run, ddl, id_col, text_col)


def plan(counts: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best-fit over the counts per length -> placements (length, rank from, rank to, per sequence, first
    sequence, offset): ranks [from, to) of a length go ``per sequence`` to each of the following sequences."""
    w = np.array(cap.weights)
    one = np.array([1.0, 1.0, 1.0])
    slack = 1e-9
    residual = np.zeros((0, 3))
    first, count, filled, made = [], [], [], 0  # of each range of equal open sequences
    out = []
    for length in sorted(counts, reverse=True):
        n, d, rank = counts[length], cap.demand(length), 0
        if (d > one + slack).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacity")
        while rank < n:
            fits = np.flatnonzero((residual >= d - slack).all(1)) if len(residual) else []
            if not len(fits):
                per = int(np.floor(((one + slack) / d).min()))
                full, rest = divmod(n - rank, per)
                for bins, k in ((full, per), (1, rest)):
                    if bins and k:
                        out.append((length, rank, rank + bins * k, k, made, 0))
                        residual = np.vstack([residual, one - k * d])
                        first.append(made)
                        count.append(bins)
                        filled.append(k * length)
                        made, rank = made + bins, rank + bins * k
                continue
            r = residual[fits]
            score = -(w * (r - d) ** 2).sum(1) if cap.rule == "norm" else (w * d * r).sum(1)
            i = int(fits[int(score.argmax())])
            m = min(count[i], n - rank)
            out.append((length, rank, rank + m, 1, first[i], filled[i]))
            rank += m
            if m < count[i]:  # the rest of the range stays as it was
                residual = np.vstack([residual, residual[i]])
                first.append(first[i] + m)
                count.append(count[i] - m)
                filled.append(filled[i])
            residual[i] = residual[i] - d
            count[i] = m
            filled[i] += length
    return out


def pack(found: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (columns doc_id, piece, length and any others)."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = spark.createDataFrame(plan(counts, cap), "p_length long, p_from long, p_to long, p_per long, "
                                                      "p_first long, p_offset long")
    parts = max(8, -(-sum(counts.values()) // RANK_ROWS))
    keyed = found.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    totals = keyed.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = totals.select(F.col("length").alias("b_length"), F.col("_part").alias("b_part"), F.coalesce(
        F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(
        Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("b_length")) & (F.col("_part") == F.col("b_part")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    # the plan has at most a few placements for each of the ``tokens`` lengths, whatever the corpus
    at = F.col("_rank") - F.col("p_from")
    return (ranked.join(F.broadcast(placed), (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_from"))
                        & (F.col("_rank") < F.col("p_to")))
            .select(*found.columns, (F.col("p_first") + F.floor(at / F.col("p_per"))).cast("long").alias("sequence_id"),
                    (F.col("p_offset") + (at % F.col("p_per")) * F.col("length")).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, cap: Capacity = Capacity(), with_ids: bool = True,
                   id_col: str = "doc_id", text_col: str = "text", lean: bool = False) -> DataFrame:
    """Pieces of every document with their places; the pieces are stored once so that texts are encoded once."""
    found = stored(pieces(docs, tokenizer, end_id, cap.tokens, with_ids, id_col, text_col, lean), "pieces")
    return pack(found, cap)
