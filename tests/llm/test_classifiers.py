import random
import re
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import langid, linear, quality
from flowlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeat = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    n = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat))
    return n + (n[0] < 50 or 100 * n[4] > 50 * n[0],)


def test_base_counts_equal_plain_loops(spark, docs001, odd_docs):
    for docs in (docs001, odd_docs):
        texts = sorted((str(r.doc_id), *base_by_hand(r.text)) for r in docs.select("doc_id", "text").collect())
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                     for r in quality.score(docs, None).collect())
        assert got == texts


def test_repeated_words_with_many_distinct_words():
    a = np.arange(5000)
    a = np.concatenate([a, a[100:110]])
    assert quality.repeated_words(a, 1 << 22) == quality.repeated_words(a, 6000) == 20


def test_quality_query_separates_labelled_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, SF01).collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    used = [(rows[r.doc_id].quality >= 0.5, r.quality == 1) for r in labels if not rows[r.doc_id].base_failed]
    assert np.mean([a == b for a, b in used]) > 0.97
    assert all(not r.kept for r in rows.values() if r.base_failed)


def test_quality_without_two_classes_or_rows(spark, docs001, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.fit(docs001, labels) is None
    assert quality.score(no_docs, None).count() == 0
    got = quality.score(docs001, None).where("(kept <> (not base_failed)) or (quality is not null)").count()
    assert got == 0


def test_quality_is_calibrated_on_synthetic_logits():
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000) * 3
    y = (rng.random(4000) < linear.sigmoid(2 * z + 1)).astype(float)
    a, c = linear.platt(z, y, np.ones(4000))
    assert abs(a - 2) < 0.3 and abs(c - 1) < 0.3


def test_codewords_are_distinct():
    for k in (2, 3, 4, 6, 7, 20, 60):
        m = langid.codewords(k)
        d = (m.shape[1] - m @ m.T) / 2
        assert m.shape[0] == k and (d[~np.eye(k, dtype=bool)] >= 1).all()


def test_language_query_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, SF01).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, docs001, odd_docs, no_docs):
    model = langid.fit(docs001, F.lit(True))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd_docs, model).collect()]
    assert {i for i, p, s in got if p == "und"} == {1, 2, 3, 11} and all(s == 0 for i, p, s in got if p == "und")
    assert len(got) == odd_docs.count()
    kept = langid.accepted(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 4
    assert langid.fit(no_docs, F.lit(True)) is None
    assert langid.predict(no_docs, None).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, None).collect()} == {"und"}
    one = langid.fit(docs001.where("lang = 'en'"), F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs001, one).collect()} == {("en", 1.0)}


def test_training_rows_are_held_once_on_the_driver(spark):
    rng, rows = random.Random(3), [(7, "one id, two texts", "xx"), (7, "another text of it", "xx"), (None, "no id", "yy")]
    for i in range(600):
        word = "abcdefghij" if i % 2 else "fghijklmno"
        rows.append((i + 10, "".join(rng.choice(word + " ") for _ in range(900)), "xy"[i % 2] * 2))
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string").repartition(4)
    langid.fit(docs.limit(50), F.lit(True), max_rows=5)  # imports
    tracemalloc.start()
    model = langid.fit(docs, F.lit(True), max_rows=700)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = sorted({(i is None, i or 0, k, langid.features(t).tobytes()) for i, t, k in rows})
    x = np.vstack([np.frombuffer(r[3], np.float32) for r in want])
    target = (langid.codewords(2)[[("xx", "yy").index(r[2]) for r in want]] + 1) / 2
    held = np.arange(len(want)) % 5 == 0
    w, b = linear.fit_dense(x[~held], target[~held])
    assert np.array_equal(model.weights, w) and np.array_equal(model.bias, b)
    assert most < 1.3 * x.nbytes


def test_ambiguity_flag():
    code = langid.codewords(4)
    m = langid.LanguageModel(list("abcd"), code, None, None, np.ones(code.shape[1]))
    best, score, unsure = langid.decode(m, np.vstack([5 * code[2], 0 * code[1], 5 * code[1] * ([1] * 6 + [-1])]))
    assert best[0] == 2 and score[0] > 0.99 and not unsure[0] and unsure[1] and best[2] == 1
