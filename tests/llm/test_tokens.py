import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import fstcount, packing, tokenfiles, wordbpe
from flowlens.llm.encoding import UnitEncoder

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


def odd_texts(n=1500):
    rng = random.Random(3)
    alphabet = "aAbBßéÉΣσς İı'stredvm<|>endof 12٣²Ⅷ\t\n\x1c\x85 　日本́ȩ▁"
    fixed = ["", "a", " a", "a ", "a  b", "a\n\nb", "\n", " ", "x<|endoftext|>y z", "A's it'll we've 's 'S", "ΣΑΣ ΟΔΟΣ",
             "<|startoftext|>Hi<|ENDoftext|> <|endoftext|>x", "x" * 300, "\x1cq w", " " * 77 + "a", "a" + " " * 40, "▁▁ a",
             "<s> <0x41> </s>", "a\x00b"]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_unit_encoding_equals_the_library(vocab, docs001):
    path = vocab("byte_bpe_50k.json")
    texts = odd_texts() + [r.text for r in docs001.select("text").collect()]
    want = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for limit in (10, 100_000):  # with the memo emptied again and again, and not
        enc, got = UnitEncoder(path, memo_units=limit), []
        for i in range(0, len(texts), 50):
            ids, ends = enc.encode(texts[i:i + 50])
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == want
    assert enc.encode([None, ""])[1].tolist() == [0, 0] and enc.encode([])[0].tolist() == []


def test_unit_encoding_asks_the_library_once(vocab):
    """A full memo keeps the words that come again; a word with signs after it is not encoded anew."""
    class Counted:
        def __init__(self, tok):
            self.tok, self.asked = tok, []

        def encode_batch_fast(self, texts, **kw):
            self.asked += texts
            return self.tok.encode_batch_fast(texts, **kw)

    path = vocab("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    enc = UnitEncoder(path, memo_units=100)
    enc.tok = Counted(enc.tok)
    for i in range(20):
        text = "x common words come again common words come again " + " ".join(f"rare{i}q{k}" for k in range(30))
        assert enc.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(t.split().count("common") for t in enc.tok.asked) == 1 and len(enc.memo) <= 131
    enc = UnitEncoder(path)
    enc.tok = Counted(enc.tok)
    for text in ("x common words", "x common, words. common: words.\nCommon,", "x end \n", "x words.", "x é. é'. <|endoftext|>. a's, 1."):
        assert enc.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(t.count("common") for t in enc.tok.asked) == 1 and sum(t.count("words") for t in enc.tok.asked) == 1


def test_lean_pieces_forget_their_words(spark, vocab, docs001):
    from flowlens.llm import encoding
    path = vocab("byte_bpe_50k.json")

    some = docs001.coalesce(1)
    lean = packing.pieces(some, path, 0, 64, with_ids=False, lean=True).collect()
    assert sorted(lean) == sorted(packing.pieces(some, path, 0, 64, with_ids=False).collect())
    alone = encoding.encoder(path, encoding.LEAN_MEMO_UNITS)
    assert alone is encoding.encoder(path, encoding.LEAN_MEMO_UNITS) and alone is not encoding.encoder(path)


def test_word_bpe_equals_the_library(vocab, docs001):
    path = vocab("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    texts = odd_texts() + [r.text for r in docs001.select("text").collect()]
    m = wordbpe.WordBpe(path, memo_units=500)
    for t, (_, n, ids, text) in zip(texts, m.rows(texts), strict=True):
        want = tok.encode(t, add_special_tokens=False).ids
        assert (n, ids, text) == (len(want), " ".join(map(str, want)), tok.decode(want, skip_special_tokens=False)), t
    short, wordbpe.SHORT = wordbpe.SHORT, 3  # the heap gives the same as the scan
    try:
        assert wordbpe.WordBpe(path).encode("relationship understanding") == tok.encode(
            "relationship understanding", add_special_tokens=False).ids
    finally:
        wordbpe.SHORT = short


def test_word_bpe_equals_the_library_for_every_character(vocab):
    """Alone, and next to letters, digits, signs, marks and spaces (every fifth character beyond the first 0x3100)."""
    path = vocab("word_bpe_49k.json")
    tok, m = tokenizers.Tokenizer.from_file(path), wordbpe.WordBpe(path)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    some = [c for c in every if ord(c) < 0x3100 or ord(c) % 5 == 0 and ord(c) < 0x20000 or wordbpe._OTHER.search(c) is None]
    forms = (lambda c: c, lambda c: f"a{c}b", lambda c: f"!{c}1", lambda c: f"{c}\u0323\u0301", lambda c: f"é{c} {c}S\u033c{c}")
    texts = [f(c) for f in forms for c in some[:: 1 if f is forms[0] else 2]]
    for s in range(0, len(texts), 20_000):
        part = texts[s:s + 20_000]
        want = tok.encode_batch(part, add_special_tokens=False)
        for t, w, (_, n, ids, _) in zip(part, want, m.rows(part), strict=True):
            assert ids == " ".join(map(str, w.ids)), ascii(t)


def test_word_bpe_frames(spark, vocab, odd_docs, no_docs):
    path = vocab("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rows = wordbpe.encode(odd_docs, path).collect()
    texts = {(r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()}
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in texts}
    assert len(rows) == odd_docs.count() and all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)
    digests = {r.doc_id: r for r in wordbpe.encode(odd_docs, path, digests=True).collect()}
    for i, ids in want.items():
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in wordbpe.decode(wordbpe.encode(odd_docs, path), path).collect()}
    assert back == {i: tok.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
    assert wordbpe.encode(no_docs, path).count() == 0


def test_transducer_counts_and_compositions(vocab, docs001):
    path = vocab("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    t, rng = fstcount.Transducer(path), random.Random(8)
    for x in odd_texts() + [r.text for r in docs001.select("text").collect()][:60]:
        want = len(sp.encode(x))
        if x:
            assert t.total(t.chunk(" " + fstcount.normal(x))) == want, x
            cuts = sorted(rng.randint(0, len(x)) for _ in range(rng.randint(1, 9)))
            parts = [x[a:b] for a, b in zip([0, *cuts], [*cuts, len(x)])]
            maps = [t.chunk(fstcount.normal((" " if i == 0 else "") + p)) for i, p in enumerate(parts)]
            left = maps[0]
            for m in maps[1:]:
                left = t.compose(left, m)
            right = maps[-1]
            for m in maps[-2::-1]:
                right = t.compose(m, right)  # composition is associative
            assert t.total(left) == t.total(right) == want, (x, parts)
    t.clear()
    assert t.total(t.chunk(" again and again")) == len(sp.encode("again and again"))


def test_token_counts_frame(spark, vocab, odd_docs, no_docs):
    path = vocab("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(sp.encode(r.text or "")),
                   len(sp.encode(r.text or "")) > 5) for r in odd_docs.select("doc_id", "text").collect())
    for size in (1 << 16, 1000):
        got = fstcount.count(odd_docs, path, limit=5, chunk_chars=size).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert fstcount.count(no_docs, path, limit=5).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n)
    if n:
        assert sorted(tokenfiles.build_hash(keys)[1].tolist()) == list(range(n))


def test_token_files_round_trip(spark, vocab, docs001, odd_docs, no_docs, monkeypatch):
    path = vocab("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    monkeypatch.setattr(tokenfiles, "SHARD_DOCS", 7)  # several shards of a task (local workers fork with it or not)
    for docs in (docs001, odd_docs):
        rows = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [2])
                for r in docs.select("doc_id", "text").collect()]
        manifest = tokenfiles.write(docs, path, end_id=2)
        got = tokenfiles.read(manifest).collect()
        assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), x) for i, x in rows)
        got.sort(key=lambda r: r.start)
        assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
        keys = [r.doc_id for r in got if r.doc_id is not None]
        assert keys == sorted(keys)
        crc = tokenfiles.read(manifest, digests=True).collect()
        assert {(r.start, r.ids_crc32) for r in crc} == {
            (r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
        wanted = spark.createDataFrame([(4,), (7,), (-5,), (10 ** 15,), (None,)], "doc_id long")
        found = sorted((r.doc_id, r.ids) for r in tokenfiles.fetch(manifest, wanted).collect())
        assert found == sorted((i, x) for i, x in rows if i in (4, 7))
    assert tokenfiles.read(tokenfiles.write(no_docs, path, end_id=2)).count() == 0


def test_index_rejects_absent_keys():
    keys = np.arange(0, 5000, 5)
    raw = tokenfiles.shard_bytes(keys, np.ones(1000, np.int64), np.arange(1000, dtype="<u2"))
    import tempfile
    with tempfile.NamedTemporaryFile() as f:
        f.write(raw)
        f.flush()
        with tokenfiles.Shard(f.name) as s:
            assert s.find(np.arange(5000)).tolist() == [i // 5 if i % 5 == 0 else -1 for i in range(5000)]
            assert s.get(35)[0].tolist() == [7] and s.get(36) == []


def check_packing(rows, cap):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist()
        lens = [n for _, n in places]
        assert sum(lens) <= cap.tokens and len(lens) <= cap.documents and sum(n * n for n in lens) <= cap.attention
    return len(by)


def test_packing_keeps_every_id_and_constraint(spark, vocab, docs001, odd_docs, no_docs):
    path = vocab("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    for docs in (docs001, odd_docs):
        want = sorted((str(r.doc_id), tok.encode(r.text or "", add_special_tokens=False).ids + [0])
                      for r in docs.select("doc_id", "text").collect())
        for cap in (packing.Capacity(tokens=256, attention=256 ** 2), packing.Capacity(rule="dot"),
                    packing.Capacity(tokens=512, documents=3, attention=512 * 512 // 2 + 200_000)):
            rows = packing.pack_documents(docs, path, 0, cap).collect()
            n = check_packing(rows, cap)
            got = {}
            for r in rows:
                got.setdefault((str(r.doc_id), r.piece), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
                assert zlib.crc32(r.ids) == r.ids_crc32 and r.length * 4 == len(r.ids)
            if docs is docs001:
                back = {}
                for (i, k), [(start, ids)] in sorted(got.items()):
                    assert start == len(back.get(i, [])) and (k == 0 or len(ids) == cap.tokens)
                    back[i] = back.get(i, []) + ids
                assert sorted(back.items()) == want
                if cap.tokens == 2048:
                    assert n <= 1.05 * sum(len(x) for _, x in want) / 2048 + 1
    assert packing.pack_documents(no_docs, path, 0).count() == 0


def test_best_fit_plan_against_one_by_one():
    """The plan over counts gives as many sequences as plain best fit over the pieces in falling order."""
    rng = np.random.default_rng(4)
    for _ in range(5):
        lengths = rng.integers(1, 101, 400)
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
        cap = packing.Capacity(tokens=100, documents=6, attention=100 * 100, weights=(1, 0, 0))
        placed = packing.plan(counts, cap)
        bins = {}
        for n, a, b, per, first, off in placed:
            for rank in range(a, b):
                s = first + (rank - a) // per
                bins.setdefault(s, []).append((off + (rank - a) % per * n, n))
        assert sum(map(len, bins.values())) == 400
        for x in bins.values():
            x.sort()
            assert len(x) <= 6 and sum(n for _, n in x) <= 100
            assert [o for o, _ in x] == np.cumsum([0] + [n for _, n in x])[:-1].tolist()
        plain = []
        for n in sorted(lengths.tolist(), reverse=True):
            fit = [x for x in plain if x[0] >= n and x[1] >= 1]
            x = min(fit, key=lambda x: x[0]) if fit else [100, 6]
            if not fit:
                plain.append(x)
            x[0] -= n
            x[1] -= 1
        assert len(bins) <= len(plain) * 1.03 + 1


def test_too_long_piece_is_refused():
    with pytest.raises(ValueError):
        packing.plan({100: 1}, packing.Capacity(tokens=200, attention=99 * 99))


def test_hot_length_is_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    found = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(7).cast("long").alias("length"))
    cap = packing.Capacity(tokens=70, attention=70 * 70)
    rows = packing.pack(found, cap).collect()
    assert len(rows) == 3000 and check_packing(rows, cap) == 300
