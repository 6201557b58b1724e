import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import embedup, neardup, suffixdedup
from flowlens.llm.common import components
from flowlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"


def joined(nodes, links):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300)]
    edges += [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = joined({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n != 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def near_by_hand(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and a is not None and b is not None
             and 100 * len(x & y) >= percent * len(x | y)]
    comp = joined({i for i, _ in sets if i is not None}, links)
    return sorted((str(i), len(s), str(comp.get(i)), comp.get(i) == i or i is None) for i, s in sets)


def near_rows(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def near_copies(seed, groups=6, size=25):
    """Groups of near copies whose pairs lie on both sides of the threshold, in chains."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"w{g}x{i}" for i in range(60)]
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(60)] = f"v{rng.random()}"
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                words = copy  # the group drifts
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_A", 7)  # small blocks, so buckets are cut
    monkeypatch.setattr(neardup, "BLOCK_B", 9)
    rows = near_copies(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert near_rows(neardup.near_duplicates(df, 3, 85)) == near_by_hand(rows, 3, 85)


def test_near_duplicate_query_and_edge_cases(spark, docs001, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs001.collect()]
    assert near_rows(QUERIES["op5_minhash_bayes"](spark, SF001)) == near_by_hand(rows, 3, 85)
    odd = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert near_rows(neardup.near_duplicates(odd_docs, 5, 80)) == near_by_hand(odd, 5, 80)
    assert neardup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_broadcast_no_buckets(spark):
    """Pairs of near copies: 72,000 rows of buckets from a small table of classes, whose files look small to Spark."""
    texts = [[f"g{i // 2}x{k}" for k in range(60)] for i in range(3000)]
    for i in range(1, 3000, 2):
        texts[i][i % 60] = "other"
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    key = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(key, "2m")  # a broadcast beyond it fails
    try:
        got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect())
    finally:
        spark.conf.unset(key)
    assert got == [(i, i - i % 2) for i in range(3000)]


def test_bayes_bound_is_the_posterior():
    for n, t in ((20, 0.85), (60, 0.8), (120, 0.85)):
        x = neardup.least_matches(n, t, 1e-3)
        grid = (np.arange(200_000) + 0.5) / 200_000

        def tail(k, n=n, t=t, grid=grid):
            like = k * np.log(grid) + (n - k) * np.log1p(-grid)
            like = np.exp(like - like.max())
            return like[grid >= t].sum() / like.sum()
        assert tail(x) >= 1e-3 > tail(x - 1)


def cut_by_hand(rows, m=50):
    low, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - m + 1):
            if i is not None:
                low[b[p:p + m]] = min(i, low.get(b[p:p + m], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - m + 1):
            if i is not None and low[b[p:p + m]] < i:
                gone[p:p + m] = True
        gone = gone[:len(b)]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_all_substrings(spark, seed, monkeypatch):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(60, 400))) for _ in range(10)]
    rows = []
    for _ in range(200):
        t = ""
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            a = rng.randint(0, len(x))
            t += x[a:a + rng.randint(0, 200)] + "".join(rng.choice("xyz\0\n") for _ in range(rng.randint(0, 20)))
        rows.append((rng.randint(0, 180), "a" * rng.randint(0, 300) if rng.random() < 0.05 else t))
    monkeypatch.setattr(suffixdedup, "BUNDLE_BYTES", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                 for r in suffixdedup.removed(df, digests=True).collect())
    assert got == cut_by_hand(rows)


def test_suffix_dedup_edge_cases(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.where("doc_id is null or doc_id not in (7, 8)").select("doc_id", "text").collect()]
    df = odd_docs.where("doc_id is null or doc_id not in (7, 8)")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                 for r in suffixdedup.removed(df, digests=True).collect())
    assert got == cut_by_hand(rows)
    out = suffixdedup.deduplicate(df)
    assert out.columns == df.columns and out.count() == df.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] is None and texts[6] == "" and texts[5].startswith("same words")
    assert suffixdedup.removed(no_docs, digests=True).count() == 0 and suffixdedup.deduplicate(no_docs).count() == 0


def test_merge_never_differs_from_sorting():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 5, 8):
        runs = []
        for _ in range(k):
            keys = np.unique(rng.integers(0, 3, (rng.integers(1, 60), 6), dtype=np.uint8), axis=0)
            _, start, lcp = suffixdedup.sort_run(keys)
            assert len(start) == len(keys)
            runs.append((keys, lcp, suffixdedup.front_code(keys, lcp)))
            assert (suffixdedup.decoded(lcp, runs[-1][2], 6) == keys).all()
        order, common = suffixdedup.merge_runs([r[1:] for r in runs], 6)
        at, out = [0] * k, []
        for r in order:
            out.append(runs[r][0][at[r]].tobytes())
            at[r] += 1
        assert out == sorted(out) and len(out) == sum(len(r[0]) for r in runs)
        for a, b, c in zip(out, out[1:], common[1:]):
            assert c == next((i for i in range(6) if a[i] != b[i]), 6)


def vectors_by_hand(rows, threshold):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and v and lab is not None
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(k, m) for (k, a), (m, b) in itertools.combinations(enumerate(good), 2) if a[2] == b[2]
             and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold]
    n = np.zeros(len(good), int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = joined({g[0] for g in good}, [(good[a][0], good[b][0]) for a, b in links])
    out = [(str(g[0]), int(n[k]), str(comp[g[0]])) for k, g in enumerate(good)]
    bad = [(str(r[0]), 0, str(r[0])) for r in rows if not any(r[0] == g[0] for g in good)]
    return sorted(out + bad)


def test_projection_forest_recall_and_cases(spark, monkeypatch):
    rng, rows = np.random.default_rng(3), []
    for c in range(60):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (centre + rng.standard_normal(16) * 0.15).tolist(), int(c % 3)))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(20)]  # a very common vector
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0, None] * 8, 1), (2003, [float("nan")] * 16, 1),
             (2004, [1.0] * 16, None), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1),
             (2008, [float("inf")] * 16, 1)]
    monkeypatch.setattr(embedup, "LEAF", 60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedup.near_vectors(df, 0.9).collect())
    want = vectors_by_hand(rows, 0.9)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.97
    assert embedup.near_vectors(df.limit(0)).count() == 0
    assert embedup.near_vectors(df.where("vec_id in (2000, 2001)")).count() == 2


def test_embedding_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in QUERIES["op8_rp_forest"](spark, SF001).collect())
    assert got == vectors_by_hand(rows, 0.93)


def test_removed_bytes_take_few_bytes_of_memory_each(tmp):
    import tracemalloc
    size, rng = 4 << 20, np.random.default_rng(1)
    s = np.sort(rng.integers(0, size - 50, 1000))
    suffixdedup._store("file://" + tmp, "1.found", suffixdedup._pack(s, s + 50))
    suffixdedup._store("file://" + tmp, "1.more", suffixdedup._pack(s[:10] + 7, s[:10] + 57))
    want = np.zeros(size, dtype=bool)
    for i in [*s, *s[:10] + 7]:
        want[i:i + 50] = True
    tracemalloc.start()
    gone = suffixdedup._gone("file://" + tmp, 1, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (gone == want).all() and peak < 8 * size  # it was 28 bytes for each byte of text


def test_signatures_are_looked_up_without_a_shuffle_of_texts(spark, monkeypatch):
    """Also over several files and row groups, and with rows of one set in several places."""
    monkeypatch.setattr("flowlens.llm.common.ROW_GROUP_BYTES", 4096)
    rows = [(i, f"a{i % 400} b{i % 400} c{i % 400} d e f g" + " w" * (i % 40)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sketched, folder = neardup._sketched(docs, 3, 85, "doc_id", "text")
    all_rows = {r["doc_id"]: (bytes(r["sig"]), bytes(r["z"])) for r in sketched.collect()}
    wanted = sketched.where("doc_id % 7 < 2").withColumn("number", F.col("doc_id") + 5000)
    found = neardup._looked_up(wanted, folder)
    got = {r["doc_id"] - 5000: (bytes(r["sig"]), bytes(r["z"])) for r in found.collect()}
    assert got == {k: v for k, v in all_rows.items() if k % 7 < 2} and len(got) > 200
    exchanged = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in x]
    assert len(exchanged) == 1 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_one_of_each_moves_only_rows_like_copies(spark, monkeypatch):
    rows = [(i % 90, f"text of its own number {i % 60} " * 5) for i in range(150)] + [(None, "no id here"), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = neardup.one_of_each(docs)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
        monkeypatch.setattr(neardup, "COPY_KEYS", 0)
        many = neardup.one_of_each(docs)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
        key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
        a, b = (sorted(map(tuple, x.collect()), key=key) for x in (few, many))
        assert a == b and sum(t is None for _, t in a) == 2 and len(a) == 63
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))


def test_suffix_bundles_take_few_bytes(spark, tmp_path, docs001):
    """The anchors of a bundle and the mask of its removed bytes; smaller bundles give the same texts."""
    import tracemalloc
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    cols = suffixdedup.bundle_anchors(np.array([1, 2]), np.array([False, False]), np.array([1 << 19, 1 << 20]), raw)
    assert sum(c.itemsize for c in cols) <= 24
    assert suffixdedup.bundle_hashes(np.array([1, 2]), np.array([False, False]), np.array([1 << 19, 1 << 20]), raw).tolist() \
        == np.unique(cols[4]).tolist()
    folder, size = f"file://{tmp_path}", 4 << 20
    s = np.sort(rng.choice(size - 200, 2000, replace=False)).astype(np.int32)
    e, p = s + rng.integers(50, 200, len(s)).astype(np.int32), rng.choice(size - 50, 500)
    suffixdedup._store(folder, "1.found", suffixdedup._pack(s, e))
    suffixdedup._store(folder, "1.more", suffixdedup._pack(p, p + 50))
    tracemalloc.start()
    gone = suffixdedup._gone(folder, 1, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(size, bool)
    for a, b in [*zip(s, e), *zip(p, p + 50)]:
        want[a:b] = True
    assert (gone == want).all() and peak < 3 * size
    assert not suffixdedup._gone(folder, 2, 10).any()
    big, small = (sorted((r.doc_id, r.text) for r in suffixdedup.deduplicate(docs001, bundle_bytes=b).collect())
                  for b in (suffixdedup.BUNDLE_BYTES, 1 << 16))
    assert big == small
