"""Token alignment, fill-in-middle and URL filters against plain loops."""

import collections
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from flowlens.llm import align, fim, urlfilter

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


def plain_alignment(rows, path_a, path_b):
    """doc -> (n_a, n_b, groups, links) by a walk over both token lists, and the corpus counts of the links."""
    tok = tokenizers.Tokenizer.from_file(path_a)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
    alphabet = align.byte_alphabet()
    piece_a = {i: bytes(alphabet[c] for c in p) if all(c in alphabet for c in p) else p.encode()
               for p, i in tok.get_vocab().items()}

    def piece_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    counts, per = collections.Counter(), []
    for i, t in rows:
        groups, links, a, b = [], [], [], []
        if t:
            a, b, want = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t), (" " + t).encode()
            if b"".join(piece_a[x] for x in a) != want or b"".join(map(piece_b, b)) != want:
                a, b = [], []
        ends, at = {}, 0
        for j, x in enumerate(b):
            at += len(piece_b(x))
            ends[at] = j
        at = from_a = from_b = 0
        for j, x in enumerate(a):
            at += len(piece_a[x])
            if at in ends:
                k = ends[at]
                groups.append(",".join(map(str, a[from_a:j + 1])) + "|" + ",".join(map(str, b[from_b:k + 1])))
                links.append((x, b[k]))
                from_a, from_b = j + 1, k + 1
        counts.update(links)
        per.append((i, len(a), len(b), groups, links))
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(((i, na, nb, len(g), len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x),
                    ";".join(g)) for i, na, nb, g, x in per), key=repr), counts


COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def odd_texts():
    rng = random.Random(8)
    alphabet = "aAbéΣ İı'stredvm<|>endof 12٣Ⅷ\t\n\x1c\x85 　日本́▁"
    fixed = ["a", " a", "a ", "a  b", "a\nb c", "\n", " ", "x<|endoftext|>y <|endoftext|> z", "<s> a </s> <unk>", "▁", "a ▁ b",
             "<0x41> B", "tokenizers align tokens differently"]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(300)]


def test_alignment_equals_a_walk(spark, vocab, docs001, odd_docs):
    paths = vocab("byte_bpe_50k.json"), vocab("piece_bpe_32k.model")
    odd = spark.createDataFrame([(1000 + i // 2, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    docs = docs001.select("doc_id", "text").unionByName(odd).unionByName(odd_docs.select("doc_id", "text")).repartition(5)
    want, counts = plain_alignment([(r.doc_id, r.text) for r in docs.collect()], *paths)
    got = sorted(((*(r[c] for c in COLS),) for r in align.align(docs, *paths).collect()), key=repr)
    assert got == want
    digests = {(r.doc_id, r.n_a, r.groups_sha256) for r in align.align(docs, *paths, digests=True).collect()}
    assert digests == {(w[0], w[1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want}
    figures = {(r.a_id, r.b_id): r.n for r in align.pair_counts(align.bundles(docs, *paths, False)).collect()}
    assert figures == dict(counts)


def test_alignment_frames(spark, vocab, odd_docs, no_docs):
    paths = vocab("byte_bpe_50k.json"), vocab("piece_bpe_32k.model")
    assert align.align(no_docs, *paths).count() == 0
    rows = align.align(odd_docs, *paths)
    assert tuple(rows.columns) == COLS and rows.count() == odd_docs.count()
    zero = {r.doc_id for r in rows.where("n_a = 0").collect()}
    assert zero == {1, 2, 9}  # null, empty, and a text with U+2581, which the pieces read as a space


def plain_fim(i, t, mark=("<P>", "<S>", "<M>")):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(t)
    if not t or any(m in t for m in mark) or h3 % 100 >= 90:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return i, n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


@pytest.mark.parametrize("window", [7, fim.WINDOW])
def test_fill_in_middle_equals_slices(spark, docs001, odd_docs, window, monkeypatch):
    texts = ["a", "ab", "é", "日本語 text", "<", "<S", "x<P", "<P>x", "a <M> b", "\U0001f600\U0001f601", "a\x00b", "<>" * 40]
    odd = spark.createDataFrame([(500 + i, t) for i in range(6) for t in texts], "doc_id long, text string")
    docs = docs001.select("doc_id", "text").unionByName(odd).unionByName(odd_docs.select("doc_id", "text"))
    if window < 100:
        docs = docs.where("length(text) < 3000 or text is null")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    batches = docs.select("doc_id", "text")
    if window < 100:  # the windows are walked in this process, where the constant can be changed
        monkeypatch.setattr(fim, "WINDOW", window)
        import pyarrow as pa
        for i, t in rows:
            w = plain_fim(i, t)
            if w[2] == "plain":
                continue
            batch = pa.RecordBatch.from_pydict({"text": [t], "form": [w[2]], "first": [w[3]], "second": [w[3] + w[4]]})
            assert fim._rearranged(batch).to_pylist() == [w[5]]
        return
    out = fim.transform(batches)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted((plain_fim(*r) for r in rows), key=repr)
    back = out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    forms = collections.Counter(r[2] for r in got)
    assert min(forms.values()) > 10 and len(forms) == 3


def test_fill_in_middle_frames(no_docs, odd_docs):
    assert fim.transform(no_docs).count() == 0
    got = fim.digest(fim.transform(odd_docs))
    assert got.count() == odd_docs.count() and got.where("doc_id = 1").first().output_sha256 == hashlib.sha256(b"").hexdigest()


def random_pages(n=500, seed=5):
    rng = random.Random(seed)
    hosts = ["a.example.org", "b.example.com", "x.net", "Example.ORG", "m.shop.com", "q.net", "com", "notexample.org", ""]
    paths = ["/es/1", "/en/1", "/fr/2", "/de/3", "/x", "", "/en/2", "/"]

    def url():
        return (rng.choice(["http", "https", "HTTP"]) + "://" + rng.choice(hosts) + rng.choice(paths)
                + rng.choice(["", "?utm_source=a", "?a=1&utm_x=2", "?utm_x=2&a=1", "#t", "/../?q://z"]))

    rows = []
    for i in range(n):
        link = rng.choice([url(), "/fr/2", "//x.net/x", "sub?x=1", "?q=2", "#z", "mailto:a@b", "", "data:,x"])
        tag = rng.choice([f'<link rel="canonical" href="{link}">', f"<LINK href='{link}' rel=canonical />",
                          f'<meta http-equiv="refresh" content="0; url={link}">', f'<link rel="icon" href="{link}">', "plain",
                          f'<meta\n http-equiv=Refresh content="5;URL={link}"><link rel="x canonical" href={link}>'])
        rows.append((rng.choice([i, None, 3]), rng.choice([url(), url(), url(), None, "nourl", ""]),
                     rng.choice([f"<html>{tag}</html>", None, tag * 2])))
    return rows


def page_rows(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.by_alias) for r in df.collect()), key=repr)


def test_url_filter_equals_its_sql(spark, monkeypatch):
    pages = spark.createDataFrame(random_pages(), "page_id long, url string, html string")
    got = page_rows(urlfilter.verdicts(pages))
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(urlfilter.oracle_sql()).fetchall()
    names = [d[0] for d in con.description] if con.description else ["page_id", "host", "path", "rule", "verdict", "by_alias"]
    assert names[:1] == ["page_id"] and got == sorted(want, key=repr)
    assert sum(r[-1] for r in got) > 20 and {"allow", "block"} == {r[4] for r in got}
    monkeypatch.setattr(urlfilter, "PLAN_RULES", 0)  # the joined form for long lists
    assert page_rows(urlfilter.verdicts(pages)) == got


def test_blocks_spread_and_allow_goes_first(spark):
    rules = [urlfilter.Rule("block", "bad.com", "/"), urlfilter.Rule("allow", "good.com", "/"),
             urlfilter.Rule("block", "good.com", "/x/")]
    link = '<link rel="canonical" href="{}">'.format
    pages = spark.createDataFrame(
        [(1, "http://a.net/1", link("http://bad.com/p")), (2, "http://b.net/2", link("http://a.net/1#top")),
         (3, "http://c.net/3", link("http://d.net/4")), (4, "https://d.net/4?utm_source=z", link("http://www.bad.com/")),
         (5, "http://e.net/5", link("http://good.com/y")), (6, "http://good.com/x/1", link("http://e.net/5")),
         (7, "http://f.net/6", link("http://bad.com/q") + link("http://good.com/z")), (8, "http://lone.net/", None),
         (9, "http://g.net/7", None)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    redirects = spark.createDataFrame([("http://g.net/7", "http://b.net/2"), (None, "http://x.y/"), ("nourl", None)],
                                      "from_url string, to_url string")
    got = {r.page_id: (r.rule, r.verdict, r.by_alias) for r in urlfilter.verdicts(pages, rules, redirects).collect()}
    assert got == {1: (None, "block", True), 2: (None, "block", True), 3: (None, "block", True), 4: (None, "block", True),
                   5: (None, "allow", True), 6: ("good.com/x/", "block", False), 7: (None, "allow", True),
                   8: (None, "allow", False), 9: (None, "block", True)}
    assert urlfilter.verdicts(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.verdicts(pages, []).collect()} == {"allow"}


def test_url_filter_is_native(spark):
    pages = spark.createDataFrame(random_pages(20), "page_id long, url string, html string")
    plan = urlfilter.verdicts(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
