"""Token-id files with a minimal perfect hash index from document keys to their ids.

Documents are range-partitioned and sorted by key; each task writes shard files with pyarrow's file systems into a
shared folder, so any scheme that those know works, and a retried task writes new files under names of its own (only
files named in the stored manifest count).  A shard is

    header   8 bytes ``FLIDS001``, then little-endian uint64: id width, documents, distinct keys, ids, buckets, seed
    keys     int64 for each document, in file order (ascending)
    starts   uint64 for each document and one more: offset of its first id in the payload
    pilots   uint32 for each bucket of the hash
    slots    for each distinct key: uint32 fingerprint, then (second array) uint32 number of its first document
    payload  raw ids, uint16 where the vocabulary allows it, else uint32

The hash is minimal and perfect: a key's bucket names a pilot, key and pilot hash to a slot of its own among as many
slots as keys.  A lookup reads the index, computes two hashes, compares the stored fingerprint (32 bits: an absent
key passes with probability 2^-32, and then fails on the stored key) and reads the ids at their offset.

Defined cases: null or empty text is a document without ids (but for the end id, if any); a null key is stored under
the smallest 64-bit integer and read back as null; documents of equal key lie one after another in one shard and a
lookup returns them all; an empty table writes no shard; only the id and text columns are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import batch, scratch_path, stored, text_slices
from flowlens.llm.encoding import encoder

MAGIC = b"FLIDS001"
NULL_KEY = -(1 << 63)
#: A shard is closed at the next key once it holds this many documents or ids.
SHARD_DOCS = 1 << 16
SHARD_IDS = 1 << 25
#: Keys per bucket of the hash, on average; pilots tried at once.
BUCKET_KEYS = 4
_TRY = 512

MANIFEST = "path string, first_key long, last_key long, n_docs long, n_ids long"
_MANIFEST = pa.schema([("path", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()),
                       ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer (two multiply-xorshift rounds) of integer keys with a seed."""
    h = np.asarray(x).astype(np.uint64) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(pilots, slot of each key, seed) of a minimal perfect hash of distinct keys: buckets in falling size each take
    the first pilot that sends all their keys to free slots."""
    n = len(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    for seed in range(64):
        h = mix(keys, seed)
        where = (mix(keys, seed + 1000) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(np.bincount(where, minlength=buckets))
        size = np.diff(np.concatenate([[0], ends]))
        pilots, slots, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
        limit, failed = 64 * n + 100_000, False
        for b in np.argsort(-size, kind="stable"):
            if size[b] == 0:
                break
            own = order[ends[b] - size[b]:ends[b]]
            for p in range(0, limit, _TRY):
                trial = np.arange(p, p + _TRY, dtype=np.uint64)
                at = (mix(h[own][None, :] ^ mix(trial, 7)[:, None], 3) % np.uint64(n)).astype(np.int64)
                good = ~taken[at].any(1)
                if size[b] > 1 and good.any():
                    s = np.sort(at, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    k = int(good.argmax())
                    pilots[b], slots[own], taken[at[k]] = p + k, at[k], True
                    break
            else:
                failed = True
                break
        if not failed:
            return pilots, slots, seed
    raise RuntimeError("no minimal perfect hash found; are the keys distinct?")


def shard_bytes(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard of documents whose keys ascend."""
    distinct, first = np.unique(keys, return_index=True)
    pilots, slots, seed = build_hash(distinct)
    prints, number = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slots] = (mix(distinct, seed + 2000) >> np.uint64(32)).astype("<u4")
    number[slots] = first
    head = np.array([ids.dtype.itemsize, len(keys), len(distinct), len(ids), len(pilots), seed], "<u8")
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return b"".join([MAGIC, head.tobytes(), keys.astype("<i8").tobytes(), starts.tobytes(),
                     pilots.astype("<u4").tobytes(), prints.tobytes(), number.tobytes(), ids.tobytes()])


class Shard:
    """Reader of one shard: ``find`` maps keys to document numbers in constant time each, ``ids`` gives a document."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        head = self.file.read(8 + 48)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is not a token-id shard")
        self.width, self.n_docs, self.n_keys, self.n_ids, n_pilots, self.seed = np.frombuffer(head[8:], "<u8").tolist()

        def take(kind: str, n: int) -> np.ndarray:
            return np.frombuffer(self.file.read(np.dtype(kind).itemsize * n), kind)

        self.keys, self.starts = take("<i8", self.n_docs), take("<u8", self.n_docs + 1).astype(np.int64)
        self.pilots, self.prints, self.number = take("<u4", n_pilots), take("<u4", self.n_keys), take("<u4", self.n_keys)
        self.payload = self.file.tell()

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first document of each key, -1 for a key that the shard does not hold."""
        keys = np.asarray(keys, dtype=np.int64)
        if not self.n_keys:
            return np.full(len(keys), -1, np.int64)
        bucket = (mix(keys, self.seed + 1000) % np.uint64(len(self.pilots))).astype(np.int64)
        at = (mix(mix(keys, self.seed) ^ mix(self.pilots[bucket].astype(np.uint64), 7), 3)
              % np.uint64(self.n_keys)).astype(np.int64)
        same = self.prints[at] == (mix(keys, self.seed + 2000) >> np.uint64(32)).astype(np.uint32)
        number = self.number[at].astype(np.int64)
        return np.where(same & (self.keys[number] == keys), number, -1)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the payload."""
        self.file.seek(self.payload + start * self.width)
        return np.frombuffer(self.file.read((stop - start) * self.width), f"<u{self.width}")

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every document of a key (an empty list for an unknown key)."""
        i = int(self.find(np.array([key]))[0])
        out = []
        while 0 <= i < self.n_docs and self.keys[i] == key:
            out.append(self.read(int(self.starts[i]), int(self.starts[i + 1])))
            i += 1
        return out


def write(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Encode and write every document in ascending key order; returns the stored manifest, one row per shard."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("id"),
                        F.col(text_col).cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        enc = encoder(tokenizer)
        system, name = fs.FileSystem.from_uri(folder)
        system.create_dir(name, recursive=True)
        tail = np.array([] if end_id is None else [end_id], dtype=enc.dtype)
        keys, lens, ids, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal keys, lens, ids, total
            leaf, k = f"{uuid.uuid4().hex}.ids", np.array(keys, dtype=np.int64)
            with system.open_output_stream(f"{name}/{leaf}") as f:
                f.write(shard_bytes(k, np.array(lens, dtype=np.int64), np.concatenate(ids)))
            row = batch(_MANIFEST, [f"{folder}/{leaf}"], [keys[0]], [keys[-1]], [len(keys)], [total])
            keys, lens, ids, total = [], [], [], 0
            return row

        for doc_ids, texts in text_slices(batches):
            found, ends = enc.encode(texts)
            prev = 0
            for key, end in zip(doc_ids.to_pylist(), ends.tolist(), strict=True):
                if (len(keys) >= SHARD_DOCS or total >= SHARD_IDS) and key != keys[-1]:
                    yield close()
                ids += [found[prev:end], tail]
                keys.append(key)
                lens.append(end - prev + len(tail))
                total += lens[-1]
                prev = end
        if keys:
            yield close()

    return stored(keyed.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame, digests: bool = False) -> DataFrame:
    """Every document back from the files, found through the hash index: doc_id, start (ids of all documents before
    it), n_tokens, and ``ids`` (array<long>) or, with ``digests``, ``ids_crc32`` instead."""
    n = max(1, manifest.count())
    # one row for each shard, which holds up to SHARD_IDS ids
    bases = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(
        Window.orderBy("first_key", "last_key", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = ("ids_crc32", pa.int64()) if digests else ("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with Shard(row["path"]) as shard:
                    distinct, copies = np.unique(shard.keys, return_counts=True)
                    first = shard.find(distinct)
                    if (first < 0).any():
                        raise ValueError(f"index of {row['path']} lacks a stored key")
                    number = np.repeat(first - np.cumsum(copies) + copies, copies) + np.arange(shard.n_docs)
                    for part in np.array_split(number, max(1, len(number) // 2000)):
                        begin, end = shard.starts[part], shard.starts[part + 1]
                        ids = shard.read(int(begin[0]), int(end[-1])).astype("<u4")
                        pieces = [ids[s - begin[0]:e - begin[0]] for s, e in zip(begin, end, strict=True)]
                        value = [zlib.crc32(p.tobytes()) for p in pieces] if digests else [p.tolist() for p in pieces]
                        key = shard.keys[part]
                        yield batch(schema, pa.array(key, mask=key == NULL_KEY), begin + row["base"], end - begin, value)

    ddl = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>")
    return bases.select("path", "base").repartition(n).mapInArrow(run, ddl)


def fetch(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Ids of the given keys only: each key goes to the shards whose range holds it (one range join against the
    manifest, which has a row for tens of millions of ids) and is looked up there; unknown keys give no row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    at = (keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null").distinct()
          .join(manifest, F.expr("key between first_key and last_key")).select("path", "key")
          .repartition("path").sortWithinPartitions("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, wanted = np.array(b.column(0).to_pylist()), b.column(1).to_numpy()
            for path in sorted(set(paths)):
                with Shard(path) as shard:
                    rows = [(k, x.tolist()) for k in wanted[paths == path].tolist() for x in shard.get(k)]
                if rows:
                    yield batch(schema, *map(list, zip(*rows, strict=True)))

    return at.mapInArrow(run, "doc_id long, ids array<long>")


__all__ = ["write", "read", "fetch", "Shard", "build_hash", "shard_bytes"]
