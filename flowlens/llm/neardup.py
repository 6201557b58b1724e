"""MinHash near-duplicates with sequential Bayesian verification, exact confirmation and connected components.

1. Each document's set of word shingles becomes a MinHash signature; documents with equal sets are one class with a
   number of its own, whatever ids they bear, so groups of copies enter the search once.
2. Signatures are cut into bands; the number of bands follows from the threshold and ``MISS``, the chance that a pair
   right at the threshold shares no band.
3. Candidates are verified batch by batch: after each batch of signature positions the posterior probability that the
   similarity reaches the threshold, given the matches so far and a uniform prior, is a binomial tail; a pair is
   pruned once it falls below ``PRUNE``.  Survivors are confirmed on the full sets.
4. Not all pairs of a bucket are formed.  Star rounds first link each class to the bucket minimum with which it
   shares most bands; classes that are already connected need no further pair.  What is left - pairs of one bucket
   in different components - is compared in blocks (bucket members outside the bucket's largest component against
   all members), so a bucket is spread over tasks by its size, and no candidate is dropped.
5. Components are computed over the confirmed links.

Defined cases: null or empty text, or text without words, has an empty set, links with nothing and is kept; with fewer
words than a shingle the whole sequence is one shingle; A-Z are lower-cased, nothing else; words are runs of anything
but space and \\t-\\r; documents that repeat a doc_id are one document each but share that id's component; an empty
table gives an empty result; only the id and text columns are read; rows with a null id are returned unlinked
(``one_of_each``, which goes by rows, compares them too).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import (Numbered, batch, components, map_text, scratch_path, short_lived, stored as _stored,
                                 text_slices)

ROWS = 5             # signature positions of a band
MISS = 1e-6          # chance to miss a pair right at the threshold in all bands
PRUNE = 1e-7         # posterior probability below which a pair is given up
BATCH = 20           # signature positions compared at a time
STAR_ROUNDS = 1
BLOCK_A, BLOCK_B = 250, 1000   # members of one block comparison
CELL_ROWS = 3000     # members compared at once, over cells
PAIRS = 50_000       # pairs tested at once
SET_ITEMS = 2 << 20  # shingles that a task keeps, and numbers at once
CLASS_PARTS = 1 << 22  # hash parts in which classes are numbered
COPY_KEYS = 4 << 20  # hashes of copies that are sent to all tasks; beyond, texts are shuffled to find them
_A_SEED = 20240229


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    return _stored(df, name, lean=True, path=path)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is sorted and merged, whatever size Spark takes the two sides for.  It goes by
    their compressed files and counts a row that ``explode`` makes many of once, so it would have the driver collect and
    broadcast a table of twenty or thirty times the size it allows."""
    return df.hint("merge")


def n_bands(threshold: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - threshold ** ROWS)))


def least_matches(n: int, threshold: float, prune: float = PRUNE) -> int:
    """Fewest of ``n`` matches at which the posterior P(similarity >= threshold) is still at least ``prune``."""
    def posterior(x: int) -> float:  # Beta(x + 1, n - x + 1) above the threshold, as a binomial tail
        return sum(math.comb(n + 1, k) * (1 - threshold) ** k * threshold ** (n + 1 - k)
                   for k in range(n - x + 1, n + 2))
    return next((x for x in range(n + 1) if posterior(x) >= prune), n)


class Shingler:
    """Distinct 64-bit shingle hashes of texts; each distinct word of a slice is hashed once."""

    def __init__(self, words: int) -> None:
        import xxhash
        self.width, self.hash = words, xxhash.xxh3_64_intdigest
        self.ids, self.hashes = Numbered(), np.zeros(1024, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.zeros(0, dtype=np.uint64)
        if len(self.ids) > 300_000:
            self.ids = Numbered()
        at = np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found))
        if self.ids.new:
            new, self.ids.new = self.ids.new, []
            k, m = len(self.ids) - len(new), len(self.ids)
            if m > len(self.hashes):
                self.hashes = np.concatenate([self.hashes[:k], np.zeros(2 * m - k, dtype=np.uint64)])
            self.hashes[k:m] = np.fromiter(map(self.hash, new), np.uint64, len(new))
        h = self.hashes[at]
        n = min(self.width, len(h))
        x = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            x = (x ^ h[i:len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
        return np.unique(x)


def coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_A_SEED)
    a = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        m = a[:, None] * x[None, i:i + 2048]
        m += b[:, None]
        m ^= m >> np.uint32(15)
        m *= np.uint32(0x2C1B3C6D)
        np.minimum(out, m.min(1), out=out)
    return out


def sketch(docs: DataFrame, words: int, threshold: float, id_col: str, text_col: str,
           digest: bool = False) -> DataFrame:
    """doc_id, n_shingles, set_id (128-bit hash of the set), sig, bands, z (the text, compressed) and, if asked for,
    the text's MD5 as digest; empty sets have null from set_id on."""
    bands = n_bands(threshold)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()),
                        ("sig", pa.binary()), ("bands", pa.list_(pa.int64())), ("z", pa.binary())]
                       + [("digest", pa.binary())] * digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        a, b = coefficients(bands * ROWS)
        sets, press = Shingler(words), zstandard.ZstdCompressor(level=3)
        for ids, texts in text_slices(batches):
            rows = []
            for t in texts:
                s = sets(t)
                if not len(s):
                    rows.append((0, None, None, None, None, *[None] * digest))
                    continue
                g = signature(s, a, b)
                key = np.arange(bands, dtype=np.uint64)
                for col in g.reshape(bands, ROWS).T:
                    key = (key ^ col) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(29)
                raw = t.encode("utf-8", "surrogatepass")
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), g.tobytes(), key.view(np.int64).tolist(),
                             press.compress(raw), *[hashlib.md5(raw).digest()] * digest))
            yield batch(schema, ids, *map(list, zip(*rows, strict=True)))

    return map_text(docs, run, "doc_id long, n_shingles long, set_id binary, sig binary, bands array<long>, z binary"
                    + ", digest binary" * digest, id_col, text_col)


def matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(len(sigs), -1)


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) survive the sequential test, as a mask."""
    at, hits = np.arange(len(i)), np.zeros(len(i), dtype=np.int32)
    for s in range(0, a.shape[1], BATCH):
        e = min(s + BATCH, a.shape[1])
        hits[at] += (a[i[at], s:e] == b[j[at], s:e]).sum(1, dtype=np.int32)
        at = at[hits[at] >= least_matches(e, threshold)]
    mask = np.zeros(len(i), dtype=bool)
    mask[at] = True
    return mask


class Sets:
    """Shingle sets of compressed texts by class number; emptied when they hold ``SET_ITEMS`` shingles."""

    def __init__(self, words: int) -> None:
        import zstandard
        self.shingler, self.unpress = Shingler(words), zstandard.ZstdDecompressor()
        self.known, self.held = {}, 0

    def __call__(self, doc: int, z: bytes) -> np.ndarray:
        if doc not in self.known:
            found = self.shingler(self.unpress.decompress(z).decode("utf-8", "surrogatepass"))
            if self.held + len(found) > SET_ITEMS:
                self.known, self.held = {}, 0
            self.known[doc] = found
            self.held += len(found)
        return self.known[doc]


def confirm(pairs: DataFrame, involved: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union, by signature first."""
    left = involved.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"), F.col("z").alias("z_a"))
    right = involved.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"), F.col("z").alias("z_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = Sets(words)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                r = whole.slice(k, 500)
                a, b = r.column("a").to_pylist(), r.column("b").to_pylist()
                at = np.arange(len(a))
                keep = np.flatnonzero(surviving(*(matrix(r.column(c).to_pylist()) for c in ("sig_a", "sig_b")), at, at,
                                                percent / 100))
                out = []
                for p in keep.tolist():
                    x, y = full(a[p], r.column("z_a")[p].as_py()), full(b[p], r.column("z_b")[p].as_py())
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out.append((a[p], b[p]))
                if out:
                    yield batch(schema, *map(list, zip(*out, strict=True)))

    return (pairs.join(unsent(left), "a").join(unsent(right), "b").select("a", "b", "sig_a", "sig_b", "z_a", "z_b")
            .mapInArrow(run, "a long, b long"))


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket members with their present component ``comp``."""
    comp = components(links)
    return members.join(unsent(comp), members.doc_id == comp.node, "left").select(
        "bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("comp"))


def _star_pairs(members: DataFrame, tested: DataFrame | None) -> DataFrame:
    """For each class the bucket minimum of another component with which it shares most buckets, not tested before."""
    low = members.groupBy("bucket", "comp").agg(F.min("doc_id").alias("doc"))
    first = low.groupBy("bucket").agg(F.min(F.struct("doc", "comp")).alias("m"), F.count("*").alias("n")).where("n > 1")
    second = (low.join(unsent(first), "bucket").where("comp <> m.comp").groupBy("bucket")
              .agg(F.first("m").alias("m"), F.min("doc").alias("other")))
    pairs = members.join(unsent(second), "bucket").select(
        F.col("doc_id").alias("a"), F.when(F.col("comp") == F.col("m.comp"), F.col("other")).otherwise(
            F.col("m.doc")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    if tested is not None:
        pairs = pairs.join(unsent(tested.select("a", "b")), ["a", "b"], "left_anti")
    best = pairs.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("nb"))).alias("x"))
    return best.select("a", (-F.col("x.nb")).alias("b"))


class _Joined(dict):
    """Union-find over component labels; an unknown label stands for itself."""

    def __missing__(self, x: int) -> int:
        return x

    def find(self, x: int) -> int:
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x


def _rest_links(members: DataFrame, involved: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links between members of one bucket in different components, compared in blocks.

    Every pair goes through the sequential test in the bucket of its first common band only; the survivors' full sets
    are intersected where they are, one marked table of shingles for each left member, so no pair leaves its block
    unless it links two components that the block has not joined yet.
    """
    per = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    size = per.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("big"), F.sum("n").alias("n"),
                                     F.count("*").alias("comps")).where("comps > 1")
    size = size.select("bucket", F.col("big.comp").alias("big"),
                       F.ceil((F.col("n") - F.col("big.n")) / BLOCK_A).cast("int").alias("ga"),
                       F.ceil(F.col("n") / BLOCK_B).cast("int").alias("gb"))
    at = members.join(unsent(size), "bucket")
    mine_a = F.pmod(F.xxhash64("doc_id"), F.col("ga")).cast("int")
    mine_b = F.pmod(F.xxhash64("doc_id"), F.col("gb")).cast("int")
    a = at.where("comp <> big").select("bucket", "band", "doc_id", "comp", F.lit(True).alias("outside"),
                                       F.lit(0).alias("side"), mine_a.alias("ia"),
                                       F.explode(F.sequence(F.lit(0), F.col("gb") - 1)).alias("ib"))
    b = at.select("bucket", "band", "doc_id", "comp", (F.col("comp") != F.col("big")).alias("outside"),
                  F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("ga") - 1)).alias("ia"),
                  mine_b.alias("ib"))
    cells = a.unionByName(b).join(unsent(involved), "doc_id")
    threshold = percent / 100

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ["bucket", "ia", "ib", "side", "band", "doc_id", "comp", "outside", "sig", "z"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come one after another, left members first; several are compared at once."""
        full = Sets(words)

        def intersect(i: np.ndarray, j: np.ndarray, doc: np.ndarray, z: pa.ChunkedArray, comp: np.ndarray,
                      joined: _Joined) -> Iterator[tuple[int, int]]:
            """Links among the pairs (i, j), ordered by i, that join two components not joined yet.  The sets of a run
            of pairs are numbered together; a run ends where they would hold more than SET_ITEMS shingles."""
            size, s = {}, 0
            while s < len(i):
                need, items, e = {}, 0, s
                while e < len(i):
                    new = {int(k) for k in (i[e], j[e])} - need.keys()
                    for k in new:
                        if k not in size:
                            size[k] = len(full(int(doc[k]), z[k].as_py()))
                    items += sum(size[k] for k in new)
                    if items > SET_ITEMS and e > s:
                        break
                    need |= dict.fromkeys(new)
                    e += 1
                found = [full(int(doc[k]), z[k].as_py()) for k in need]
                number = np.unique(np.concatenate(found), return_inverse=True)[1].astype(np.int32)
                ends = np.cumsum([len(x) for x in found])
                place = {k: number[t - len(x):t] for k, x, t in zip(need, found, ends.tolist(), strict=True)}
                mark, marked = np.zeros(int(number.max()) + 1, dtype=bool), None
                for k, m in zip(i[s:e].tolist(), j[s:e].tolist(), strict=True):
                    p, q = joined.find(int(comp[k])), joined.find(int(comp[m]))
                    if p == q:
                        continue
                    if k != marked:
                        if marked is not None:
                            mark[place[marked]] = False
                        mark[place[k]] = True
                        marked = k
                    both = int(np.count_nonzero(mark[place[m]]))
                    if 100 * both >= percent * (size[k] + size[m] - both):
                        joined[max(p, q)] = min(p, q)
                        yield k, m
                s = e

        def links(cells: pa.Table) -> pa.RecordBatch:
            bucket, ia, ib, side, band, doc, comp = (cells.column(c).to_numpy() for c in names[:7])
            outside = np.asarray(cells.column("outside"), dtype=bool)
            sig, z = matrix(cells.column("sig").to_pylist()), cells.column("z")
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (ia[1:] != ia[:-1]) | (ib[1:] != ib[:-1])])
            cell = np.cumsum(new) - 1
            n_left = np.bincount(cell, weights=side == 0).astype(np.int64)
            n_right = np.bincount(cell).astype(np.int64) - n_left
            first_right = np.flatnonzero(new) + n_left
            left = np.flatnonzero(side == 0)
            ends, pairs, s = np.cumsum(n_right[cell[left]]), [], 0
            while s < len(left):
                e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, side="right")))
                own = left[s:e]
                count = n_right[cell[own]]
                i = np.repeat(own, count)
                j = np.arange(len(i)) + np.repeat(first_right[cell[own]] - np.cumsum(count) + count, count)
                # a pair of two outside members appears twice; take it once
                ok = (comp[i] != comp[j]) & (~outside[j] | (doc[i] < doc[j]))
                i, j = i[ok], j[ok]
                good = surviving(sig, sig, i, j, threshold)
                i, j = i[good], j[good]
                for x in range(0, len(i), 4096):
                    u, v = i[x:x + 4096], j[x:x + 4096]
                    same = (sig[u] == sig[v]).reshape(len(u), sig.shape[1] // ROWS, ROWS).all(2)
                    first = same.argmax(1) == band[u]
                    pairs.append((u[first], v[first]))
                s = e
            i = np.concatenate([*(p[0] for p in pairs), np.zeros(0, np.int64)])
            j = np.concatenate([*(p[1] for p in pairs), np.zeros(0, np.int64)])
            order = np.argsort(i, kind="stable")
            out_a, out_b = [], []
            for k, m in intersect(i[order], j[order], doc, z, comp, _Joined()):
                out_a.append(doc[k])
                out_b.append(doc[m])
            return batch(schema, np.array(out_a, np.int64), np.array(out_b, np.int64))

        held: list[pa.RecordBatch] = []
        rows = 0
        for whole in batches:
            for k in range(0, whole.num_rows, CELL_ROWS):
                held.append(whole.slice(k, CELL_ROWS))
                rows += held[-1].num_rows
                if rows < CELL_ROWS:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                keys = [t.column(c).to_numpy() for c in names[:3]]
                last = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on
                if cut:
                    yield links(t.slice(0, cut).combine_chunks())
                held = t.slice(cut).to_batches()
                rows -= cut
        if rows:
            yield links(pa.Table.from_batches(held).combine_chunks())

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (cells.select(*names).repartition(parts, "bucket", "ia", "ib")
            .sortWithinPartitions("bucket", "ia", "ib", "side").mapInArrow(compare, "a long, b long"))


def _classes(some: DataFrame) -> DataFrame:
    """set_id, rep (smallest id, or null), bands, file and row of one of its sketches, and number of each class: its place
    among the sets of one hash part, below the part's own number, so numbers are unique without a global order and parts
    grow with the classes only."""
    sets = some.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"),
                                      F.first(F.struct("file", "row")).alias("at")).withColumn(
        "part", F.pmod(F.xxhash64("set_id"), F.lit(CLASS_PARTS)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("set_id"))
    return stored(sets.select("set_id", "rep", "bands", "at.file", "at.row", (F.shiftleft("part", 40) + place).alias("number")), "classes")


def _sketched(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str,
              digest: bool = False) -> tuple[DataFrame, str]:
    """The stored sketch with each row's file and place in it, and its folder."""
    folder = scratch_path(docs.sparkSession, "sketch")
    table = stored(sketch(docs, words, percent / 100, id_col, text_col, digest), "sketch", folder)
    return table.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")), folder


def _looked_up(wanted: DataFrame, folder: str) -> DataFrame:
    """doc_id (a class's number), sig and z of the rows of the stored sketch that ``wanted`` (number, file, row) names.
    The names go to the files, so that signatures and texts are not shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet
        system, base = fs.FileSystem.from_uri(folder)
        names = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("file", "row", "number")), strict=True)
                                    for b in batches)
        for file, own in groupby(names, key=lambda r: r[0]):
            rows, numbers = (np.array(x, np.int64) for x in list(zip(*own, strict=True))[1:])
            with system.open_input_file(f"{base}/{file}") as f:
                table, first = parquet.ParquetFile(f), 0
                for g in range(table.num_row_groups):
                    end = first + table.metadata.row_group(g).num_rows
                    i, j = np.searchsorted(rows, [first, end])
                    if i < j:
                        held = table.read_row_group(g, ["sig", "z"], use_threads=False)
                        for k in range(i, j, 1000):
                            e = min(k + 1000, j)
                            some = held.take(pa.array(rows[k:e] - first)).combine_chunks()
                            yield batch(schema, numbers[k:e], *(some.column(c).chunk(0) for c in ("sig", "z")))
                    first = end

    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (wanted.select("number", "file", "row").repartition(parts, "file").sortWithinPartitions("file", "row")
            .mapInArrow(run, "doc_id long, sig binary, z binary"))


def _class_links(folder: str, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes, by their numbers; the sketch is in ``folder``.  Signatures and texts are
    looked up only for classes that share a bucket."""
    buckets = (classes.select(F.col("number").alias("doc_id"), "bands", F.posexplode("bands").alias("band", "bucket"))
               .where(F.array_position("bands", F.col("bucket")) == F.col("band") + 1).drop("bands"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stored(buckets.join(unsent(shared), "bucket").select("bucket", "band", "doc_id"), "buckets")
    wanted = classes.join(unsent(members.select(F.col("doc_id").alias("number")).distinct()), "number")
    involved = stored(_looked_up(wanted, folder), "involved")
    labelled, tested, links = members.withColumn("comp", F.col("doc_id")), None, None
    for _ in range(STAR_ROUNDS):
        pairs = stored(_star_pairs(labelled, tested), "stars")
        found = stored(confirm(pairs, involved, words, percent), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labelled = stored(_labelled(members, links), "labelled")
    return links.unionByName(_rest_links(labelled, involved, words, percent)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id): links join
    documents whose shingle sets have 100 * intersection >= percent * union."""
    sketched, folder = _sketched(docs, words, percent, id_col, text_col)
    some = sketched.where("set_id is not null and doc_id is not null")
    reps = _classes(some)
    links = _class_links(folder, reps, words, percent)
    a, b = (reps.select(F.col("number").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab")
    links = links.join(unsent(a), "a").join(unsent(b), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # a doc_id that several documents bear joins their classes
    same = (some.select("doc_id", "set_id").join(unsent(reps), "set_id")
            .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    comp = components(links.unionByName(same))
    return (sketched.select("doc_id", "n_shingles").join(unsent(comp), F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id (null ids last), then of the smallest
    text digest; of rows that repeat id and text any one.  Groups follow from the texts alone, so rows of one id with
    texts that are no near copies all stay.  Rows without a word stay."""
    with short_lived(docs.sparkSession) as paths:
        sketched, folder = _sketched(docs, words, percent, id_col, text_col, digest=True)
        some = sketched.where("set_id is not null")
        reps = _classes(some)
        comp = components(_class_links(folder, reps, words, percent))
        texts = (some.groupBy("set_id", "doc_id", "digest").agg(F.count("*").alias("n"))
                 .join(reps.select("set_id", "number"), "set_id"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
        texts = stored(texts.join(comp, F.col("number") == F.col("node"), "left").select(
            F.coalesce("component", "number").alias("comp"), order.alias("at"), "n"), "texts")
        first = texts.groupBy("comp").agg(F.min("at").alias("first"))
        marked = texts.join(first, "comp").select(F.col("at.doc_id").alias("_nd_id"), F.col("at.digest").alias("_nd_digest"),
                                                  (F.col("at") == F.col("first")).alias("stays"), "n")
        not_plain = stored(marked.where("not stays or n > 1"), "copies")
        paths.pop()  # the result reads this table; all others have done their work
    digest = F.unhex(F.md5(F.col(text_col).cast("string")))
    number = F.col(id_col).cast("long")
    marks = not_plain.select("_nd_id", "_nd_digest", "stays")

    def parted(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("_nd_text", digest).join(
            marks, number.eqNullSafe(F.col("_nd_id")) & (F.col("_nd_text") == F.col("_nd_digest")), "left")
        first = met.where("stays").dropDuplicates([id_col, "_nd_text"])
        return met.where("stays is null").unionByName(first).select(*docs.columns)

    if not_plain.count() > COPY_KEYS:
        return parted(docs)
    # rows that bear the hash of a copy's id and digest are few; the others stay where they are
    keys = F.broadcast(not_plain.select(F.xxhash64("_nd_id", "_nd_digest").alias("_nd_key")).distinct())
    same = F.xxhash64(number, digest) == F.col("_nd_key")
    return docs.join(keys, same, "left_anti").unionByName(parted(docs.join(keys, same, "left_semi")))


__all__ = ["near_duplicates", "one_of_each", "least_matches", "n_bands", "signature", "Shingler"]
