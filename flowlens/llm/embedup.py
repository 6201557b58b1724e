"""Embedding near-duplicates with a forest of random-projection trees.

Each tree splits space by random directions at the median of a bounded sample, both sides keeping the vectors within
``OVERLAP`` of the sample's mass around the median (spill); the depth follows from the number of vectors.  Every
vector goes to all its leaves of all trees; within a leaf vectors of equal label are compared exactly (cosine in
double precision) in blocks, so a leaf or label that holds a large share of all rows is spread over tasks; the pairs
found are verified by that comparison, and each is taken in the first leaf that both vectors share (every entry knows
all its leaves), so no pair is met twice.  A block gives away counts and spanning edges, not pairs.  Equal vectors of a
label are one class with a number and a weight, so a very common vector costs one comparison, and links to copies are
counted by weight.

Recall depends on the trees, not on the comparison: a pair is missed only if no tree keeps it in one leaf.

Defined cases: a null vector or label, a zero vector, and null or non-finite components link with nothing (n_links 0,
own component, kept); vectors of different length never link; lengths other than the most common one are compared
without trees; several rows of one vec_id are rows of their own (with the links of their own vector and label) but share
a component; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import batch, components, stored

TREES = 8
OVERLAP = 0.12        # share of a node's vectors that go to both sides
LEAF = 2000           # vectors a leaf should hold, all labels together
SAMPLE_ROWS = 20_000  # bound of the sample that the splits are fitted on, by hash of the id
BLOCK = 1500          # vectors on one side of a block comparison
MAX_DEPTH = 24
TREE_SHIFT = 32       # a leaf's number is its tree's above its node's
PADDING = 1 << 62     # beyond all leaf numbers
KEY_PARTS = 1 << 22   # hash parts in which classes are numbered
_SOUND = ("vec_id is not null and label is not null and v is not null and size(v) > 0"
          " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
          " and exists(v, x -> x <> 0)")


class Forest:
    """Splits of all trees: direction, lower and upper bound of the overlap, by tree and node (heap numbering)."""

    def __init__(self, sample: np.ndarray, n: int, trees: int = TREES, overlap: float = OVERLAP, leaf: int = LEAF,
                 seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.nodes = trees, {}
        depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / leaf)))))
        for t in range(trees):
            at = {1: np.arange(len(sample))}
            for _ in range(depth):
                below = {}
                for node, rows in at.items():
                    if len(rows) < 40:  # too few to place a median: the node stays a leaf
                        continue
                    r = rng.standard_normal(sample.shape[1])
                    r /= np.linalg.norm(r)
                    p = sample[rows] @ r
                    low, high = np.quantile(p, [0.5 - overlap / 2, 0.5 + overlap / 2])
                    if low >= high and (p == low).all():
                        continue
                    self.nodes[t, node] = (r, low, high)
                    below[2 * node] = rows[p <= high]
                    below[2 * node + 1] = rows[p >= low]
                at = below

    def leaves(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(tree, leaf, rows) of unit vectors; a row may be in several leaves of a tree."""
        for t in range(self.trees):
            todo = [(1, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                split = self.nodes.get((t, node))
                if split is None or not len(rows):
                    if len(rows):
                        yield t, node, rows
                    continue
                p = x[rows] @ split[0]
                todo += [(2 * node, rows[p <= split[2]]), (2 * node + 1, rows[p >= split[1]])]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class _Joined(dict):
    """Union-find; an unknown key stands for itself."""

    def __missing__(self, x: int) -> int:
        return x

    def find(self, x: int) -> int:
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x


def _classes(sound: DataFrame) -> DataFrame:
    """label, v, weight (rows), rep (smallest vec_id) and key of each distinct (label, vector): its place among those of
    one hash part below the part's number, so a key names one class whatever ids its rows bear."""
    of = sound.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn(
        "part", F.pmod(F.xxhash64("label", "v"), F.lit(KEY_PARTS)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("label", "v"))
    return stored(of.select("label", "v", "rep", "weight", (F.shiftleft("part", 40) + place).alias("key")), "vectors")


def _shared_first(mine: np.ndarray, a: np.ndarray, c: np.ndarray, here: int) -> np.ndarray:
    """Which pairs (a, c) have ``here`` as the least leaf number that both hold; rows of ``mine`` are sorted, padded by
    numbers that differ from row to row."""
    first = np.zeros(len(a), dtype=bool)
    for s in range(0, len(a), 4096):
        x, y = mine[a[s:s + 4096]], mine[c[s:s + 4096]]
        both = (x[:, :, None] == y[:, None, :]).any(2)
        first[s:s + 4096] = x[np.arange(len(x)), both.argmax(1)] == here
    return first


def near_vectors(vectors: DataFrame, threshold: float = 0.93, trees: int = TREES, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    sound = rows.where(_SOUND)
    copies = _classes(sound)
    lengths = copies.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    dim, n = lengths["d"], lengths["n"]
    picked = (copies.where(F.size("v") == dim).orderBy(F.xxhash64("rep", "label"), "key").limit(min(SAMPLE_ROWS, n))
              .select("v").toArrow().column("v").combine_chunks())
    sample = _unit(picked.flatten().to_numpy(zero_copy_only=False).reshape(len(picked), dim))
    forest = spark.sparkContext.broadcast(Forest(sample, n, trees))  # at most a split for each 20 sample rows and tree

    leaf_schema = pa.schema([("leaf", pa.int64()), ("label", pa.string()), ("key", pa.int64()), ("weight", pa.int64()),
                             ("x", pa.binary()), ("all_leaves", pa.binary())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each leaf of each vector, with all leaves of the vector (tree and node as one number)."""
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                b = whole.slice(k, 2000)
                label, key, weight = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
                x = [np.asarray(v, dtype=np.float64) for v in b.column(3).to_pylist()]
                main = np.array([len(v) == dim for v in x], dtype=bool)
                # vectors of another length: one leaf for each length, beyond the trees' numbers
                row, leaf = [np.flatnonzero(~main)], [np.array([-len(x[i]) for i in np.flatnonzero(~main)], np.int64)]
                own = np.flatnonzero(main)
                if len(own):
                    for t, node, r in forest.value.leaves(_unit(np.vstack([x[i] for i in own]))):
                        row.append(own[r])
                        leaf.append(np.full(len(r), (t << TREE_SHIFT) + node, np.int64))
                row, leaf = np.concatenate(row), np.concatenate(leaf)
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                ends = np.searchsorted(row, np.arange(len(x) + 1))
                every = [leaf[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
                yield batch(leaf_schema, leaf, label.take(pa.array(row)), key[row], weight[row],
                            [x[i].tobytes() for i in row], [every[i] for i in row])

    routed = stored(copies.select("label", "key", "weight", "v").mapInArrow(
        route, "leaf long, label string, key long, weight long, x binary, all_leaves binary"), "leaves")
    group = ["leaf", "label"]
    size = routed.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g")).withColumnsRenamed(
        {c: f"s_{c}" for c in group})
    at = routed.join(size, [F.col(c) == F.col(f"s_{c}") for c in group]).withColumn(
        "i", F.pmod(F.xxhash64("key"), F.col("g")).cast("int"))
    # block pairs (p <= q): a member of block i takes part in (i, q) and (p, i)
    cells = (at.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
             .select(*group, F.least("i", "o").alias("p"), F.greatest("i", "o").alias("q"), "i", "key", "weight", "x",
                     "all_leaves"))

    def compare(cell: pa.Table) -> pa.Table:
        """Links of one cell that no earlier leaf has: for each member how many rows it links to, and edges that span
        the linked members (not all pairs)."""
        key, weight, block = (cell.column(c).to_numpy() for c in ("key", "weight", "i"))
        x = _unit(np.frombuffer(b"".join(cell.column("x").to_pylist()), np.float64).reshape(len(key), -1))
        lists = [np.frombuffer(b, np.int64) for b in cell.column("all_leaves").to_pylist()]
        mine = np.arange(len(lists) * max(map(len, lists))).reshape(len(lists), -1) + PADDING
        for i, leaves in enumerate(lists):
            mine[i, :len(leaves)] = leaves
        here, p, q = (cell.column(c)[0].as_py() for c in ("leaf", "p", "q"))
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        links, joined, edges = np.zeros(len(key), np.int64), _Joined(), []
        for s in range(0, len(left), 500):
            k = left[s:s + 500]
            a, c = np.nonzero(x[k] @ x[right].T >= threshold - 1e-9)
            a, c = k[a], right[c]
            if p == q:
                a, c = a[key[a] < key[c]], c[key[a] < key[c]]
            for z in range(0, len(a), 65536):  # the stated cosine decides: products of matrices differ in the last digits
                u, v = a[z:z + 65536], c[z:z + 65536]
                near = (x[u] * x[v]).sum(1) >= threshold
                u, v = u[near], v[near]
                first = _shared_first(mine, u, v, here)
                u, v = u[first], v[first]
                np.add.at(links, u, weight[v])
                np.add.at(links, v, weight[u])
                for i, j in zip(u.tolist(), v.tolist(), strict=True):
                    i, j = joined.find(i), joined.find(j)
                    if i != j:
                        joined[max(i, j)] = min(i, j)
                        edges.append((i, j))
        some = np.flatnonzero(links)
        a, b = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        none = np.full(len(a), None)
        return pa.table({"a": pa.array(np.concatenate([key[some], key[a]]), pa.int64()),
                         "b": pa.array([None] * len(some) + key[b].tolist(), pa.int64()),
                         "links": pa.array(links[some].tolist() + none.tolist(), pa.int64())})

    found = stored(cells.groupBy(*group, "p", "q").applyInArrow(compare, "a long, b long, links long"), "links")
    linked = found.where("links is not null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("others"))
    reps = copies.select("key", "rep")
    edges = (found.where("b is not null").select("a", "b").distinct()
             .join(reps.select(F.col("key").alias("a"), F.col("rep").alias("rep_a")), "a")
             .join(reps.select(F.col("key").alias("b"), F.col("rep").alias("rep_b")), "b")
             .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    # each sound row -> its class, without looking at vectors again beyond the join key
    member = sound.join(copies, ["label", "v"]).select("vec_id", "key", "rep", "weight")
    same = member.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    comp = components(edges.unionByName(same))
    good = (member.join(linked, "key", "left").select("vec_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1)
                                                      .alias("n_links")))
    bad = rows.where(f"not coalesce({_SOUND}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    return (good.unionByName(bad).join(comp, F.col("vec_id") == F.col("node"), "left")
            .select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
