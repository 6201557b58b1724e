"""Secret scan in DataFrame functions: pattern matches, and sliding-window Shannon entropy of candidate strings.

Base kinds (leftmost, not overlapping per kind): ``assign`` a keyword, an assignment sign and a value of 8 or more
characters; ``access`` AKIA and capitals or digits, 16 or more; ``hex`` 32 or more lower-case hex digits.

The entropy kind looks at candidate strings, runs of 20 or more characters of ``[A-Za-z0-9+/_=-]``, by the smallest
class that holds all their characters (hex, alnum, base64).  A window of 20 characters moves over the candidate; the
counts of its characters are kept up to date by one entering and one leaving character, and with them the sum of
c*log2(c) in millionths, so the test is exact integer arithmetic: entropy = log2(20) - sum/20.  If a window reaches
its class's threshold, the span from the first such window's start to the last one's end is reported.  Allow-listed
candidates are suppressed: without a digit or without a letter (words, paths, rulers, numbers), UUIDs, and those that
contain an allow-listed word; base spans are never suppressed.

Spans are (kind, start, end) in code points, end exclusive, ordered by start, then kind as listed, then end.

Defined cases: null text counts as empty (no spans); texts of any length are scanned whole; a repeated row gives a
repeated result; an empty table an empty result; extra columns do not matter, as results are built from the id and
text columns alone (``redact`` keeps all columns).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns of the base kinds: (pattern, group whose length counts, least length).
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8)
ACCESS = (r"AKIA[A-Z0-9]+", 0, 16)
HEX = (r"[0-9a-f]+", 0, 32)
#: The same matches found faster: a run that is too short may be skipped, as no match can start inside it.
_ACCESS_LONG, _HEX_LONG = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character in the fullest window, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
ALLOWED_WORDS = ("example", "sample", "placeholder", "changeme", "dummy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: c * log2(c) in millionths for c = 0..WINDOW.
WEIGHTS = [0] + [round(c * math.log2(c) * 1_000_000) for c in range(1, WINDOW + 1)]


def limits(thresholds: dict[str, float] = THRESHOLDS) -> dict[str, int]:
    """Largest sum of WEIGHTS at which a window still reaches its class's threshold."""
    return {k: math.floor((math.log2(WINDOW) - t) * WINDOW * 1_000_000) for k, t in thresholds.items()}


FOLD = 256     # spans that one fold joins
BLOCK = 4096   # characters of a block that cuts are looked up in
_FOUND = "struct<s:int,k:int,e:int,t:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: inside a lambda a plain expression would be worked out each time."""
    return F.get(F.transform(F.array(value), body), 0)


def _fold(items: Column, state: dict[str, Column], kind: str,
          step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]]) -> Column:
    """Fold an array into struct(state..., out): ``step`` gives the new state, whether to add something to ``out``, and
    what.  The fold goes over slices of FOLD items, so what one step copies does not grow with the array."""
    def inner(acc: Column, x: Column) -> Column:
        new, add, value = step(acc, x)
        return F.struct(*[new[c].alias(c) for c in state],
                        F.when(add, F.concat(acc["out"], F.array(value))).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, part: Column) -> Column:
        begin = F.struct(*[acc[c].alias(c) for c in state], _empty(kind).alias("out"))
        return _let(F.aggregate(part, begin, inner), lambda got: F.struct(
            *[got[c].alias(c) for c in state], F.concat(acc["out"], F.array(got["out"])).alias("out")))

    parts = _let(items, lambda f: F.transform(F.sequence(F.lit(0), F.greatest(((F.size(f) - 1) / FOLD).cast("int"), F.lit(0))),
                                              lambda i: F.slice(f, i * FOLD + 1, FOLD)))
    begin = F.struct(*[v.alias(c) for c, v in state.items()], F.array(_empty(kind)).alias("out"))
    return F.aggregate(parts, begin, outer, lambda acc: F.struct(*[acc[c].alias(c) for c in state],
                                                                 F.flatten(acc["out"]).alias("out")))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """array<(s, k, e, t)> of the matches whose ``group`` has ``least`` characters: positions are running lengths of
    what lies between the matches and of the matches."""
    p = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern), F.regexp_extract_all(text, p, F.lit(0)),
                          F.regexp_extract_all(text, p, F.lit(group)))

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column, Column]:
        start = acc["at"] + F.length(x["0"])
        end = start + F.coalesce(F.length(x["1"]), F.lit(0))
        return ({"at": end}, F.coalesce(F.length(x["2"]) >= least, F.lit(False)),
                F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["1"].alias("t")))

    return F.when(text.rlike(pattern), _fold(zipped, {"at": F.lit(0)}, _FOUND, step)["out"]).otherwise(_empty(_FOUND))


def _hot(candidate: Column, limit: Column) -> Column:
    """(first hot window's start, last one's end) inside a candidate, or -1: one pass with incremental counts."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("sum"),
                     F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))

    def step(codes: Column, limit: Column, acc: Column, code: Column) -> Column:
        i = acc["i"]
        out = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(0))
        n_in, n_out = F.get(acc["n"], code - 1), F.when(out > 0, F.get(acc["n"], out - 1)).otherwise(F.lit(0))
        # an entering character equal to the leaving one changes nothing
        moved = (acc["sum"] + F.get(weights, n_in + 1) - F.get(weights, n_in)
                 + F.when(out > 0, F.get(weights, n_out - 1) - F.get(weights, n_out)).otherwise(F.lit(0)))
        total = F.when(out == code, acc["sum"]).otherwise(moved).cast("long")
        counts = F.transform(acc["n"], lambda v, k: v + (k == code - 1).cast("int") - (k == out - 1).cast("int"))
        hot = (i >= WINDOW - 1) & (total <= limit)
        return F.struct((i + 1).alias("i"), total.alias("sum"), counts.alias("n"),
                        F.when(hot & (acc["a"] < 0), i - (WINDOW - 1)).otherwise(acc["a"]).alias("a"),
                        F.when(hot, i + 1).otherwise(acc["b"]).alias("b"))

    return _let(codes, lambda cs: _let(limit, lambda lim: F.aggregate(
        cs, start, lambda acc, code: step(cs, lim, acc, code), lambda acc: F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))


def _allowed(t: Column) -> Column:
    named = F.lit(False)
    for w in ALLOWED_WORDS:
        named = named | F.lower(t).contains(w)
    return ~t.rlike("[0-9]") | ~t.rlike("[A-Za-z]") | t.rlike(UUID) | named


def _entropy(text: Column, thresholds: dict[str, float]) -> Column:
    lim = limits(thresholds)
    candidates = F.filter(_matches(text, CANDIDATE, 0, WINDOW, KINDS.index("entropy")), lambda c: ~_allowed(c["t"]))

    def judged(c: Column) -> Column:
        t = c["t"]
        limit = (F.when(t.rlike("^[0-9A-Fa-f]+$"), F.lit(lim["hex"])).when(t.rlike("^[0-9A-Za-z]+$"), F.lit(lim["alnum"]))
                 .otherwise(F.lit(lim["base64"])))
        hot = _hot(t, limit)
        return F.struct(c["s"].alias("at"), c["k"].alias("k"), hot.alias("h"))

    hot = F.filter(F.transform(candidates, judged), lambda c: c["h"]["a"] >= 0)
    return F.transform(hot, lambda c: F.struct((c["at"] + c["h"]["a"]).alias("s"), c["k"].alias("k"),
                                               (c["at"] + c["h"]["b"]).alias("e")))


def spans(text: Column, thresholds: dict[str, float] = THRESHOLDS) -> tuple[Column, Column]:
    """(base spans, entropy spans) of a non-null text as array<struct<s, k, e>>, each in order."""
    found = [_matches(text, *ASSIGN, 0), _matches(text, _ACCESS_LONG, 0, ACCESS[2], 1),
             _matches(text, _HEX_LONG, 0, HEX[2], 2)]
    base = F.transform(F.concat(*found), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return F.array_sort(base), _entropy(text, thresholds)


def joined(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """doc_id, base and entropy (arrays of kind number, start, end) of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base, extra = spans(text, thresholds)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id", base.alias("base"), extra.alias("entropy"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, a hash of the base spans and all spans as text, from ``scan``."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")

    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                          F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                          joined(F.array_sort(F.concat("base", "entropy"))).alias("spans"))


def _runs(found: Column) -> Column:
    """Maximal runs (s, e) of ordered spans that overlap or touch."""
    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column, Column]:
        new = x["s"] > acc["e"]
        return ({"s": F.when(new, x["s"]).otherwise(acc["s"]), "e": F.greatest(acc["e"], x["e"])},
                new & (acc["e"] >= 0), F.struct(acc["s"].alias("s"), acc["e"].alias("e")))

    done = _fold(found, {"s": F.lit(-1), "e": F.lit(-1)}, "struct<s:int,e:int>", step)
    return _let(done, lambda d: F.concat(d["out"], F.array(F.struct(d["s"].alias("s"), d["e"].alias("e")))))


def _without(text: Column, runs: Column, mark: str) -> Column:
    """The text with each run replaced by the mark.  Positions are looked up in blocks of BLOCK characters, so a cut
    does not count from the text's beginning."""
    def cut(blocks: Column, begin: Column, end: Column) -> Column:
        inside = F.sequence((begin / BLOCK).cast("int"), ((end - 1) / BLOCK).cast("int"))
        own = F.transform(inside, lambda j: F.substring(F.get(blocks, j), F.greatest(begin - j * BLOCK, F.lit(0)) + 1,
                                                        F.least(end, (j + 1) * BLOCK) - F.greatest(begin, j * BLOCK)))
        return F.when(end > begin, F.array_join(own, "")).otherwise("")

    def kept(blocks: Column, runs: Column) -> Column:
        n = F.size(runs)
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: cut(
            blocks, F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["e"]),
            F.when(i == n, F.length(text)).otherwise(F.get(runs, i)["s"]))), mark)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return _let(blocks, lambda b: _let(runs, lambda r: kept(b, r)))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]",
           thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """All columns of ``docs``, each maximal run of overlapping or touching spans in the text replaced by ``mark``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base, extra = spans(text, thresholds)
    name = "_spans"
    while name in docs.columns:
        name += "_"
    clean = F.when(F.size(name) > 0, _without(text, _runs(F.col(name)), mark)).otherwise(F.col(text_col))
    return (docs.withColumn(name, F.array_sort(F.concat(base, extra))).withColumn(text_col, clean).select(*docs.columns))


def oracle_sql() -> str:
    """DuckDB SQL of ``digest(scan(documents))``."""
    lim = limits()
    weights = "[" + ",".join(map(str, WEIGHTS)) + "]"
    parts = []
    for kind, (pattern, group, least) in enumerate((ASSIGN, (_ACCESS_LONG, *ACCESS[1:]), (_HEX_LONG, *HEX[1:]),
                                                    (CANDIDATE, 0, WINDOW))):
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT rid, k, s, t FROM (
    SELECT rid, {kind} AS k, t, g, (sum(length(part)) OVER w + sum(length(t)) OVER w - length(t))::BIGINT AS s
    FROM (SELECT rid, unnest(generate_series(1, len(whole))) AS i, unnest(parts[:len(whole)]) AS part,
                 unnest(whole) AS t, unnest(g) AS g
          FROM (SELECT rid, string_split_regex(text, '{p}') AS parts, regexp_extract_all(text, '{p}', 0) AS whole,
                       regexp_extract_all(text, '{p}', {group}) AS g FROM d WHERE regexp_matches(text, '{p}')))
    WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE length(g) >= {least}""")
    words = " OR ".join(f"contains(lower(t), '{w}')" for w in ALLOWED_WORDS)
    names = "['" + "','".join(KINDS) + "']"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
cand AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9A-Fa-f]+') THEN {lim['hex']}
                        WHEN regexp_full_match(t, '[0-9A-Za-z]+') THEN {lim['alnum']} ELSE {lim['base64']} END AS lim
         FROM found WHERE k = 3 AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]')
         AND NOT regexp_matches(t, '{UUID}') AND NOT ({words})),
win AS (SELECT rid, s, lim, w, substring(t, w, {WINDOW}) AS x
        FROM (SELECT *, unnest(generate_series(1, length(t) - {WINDOW - 1})) AS w FROM cand)),
hot AS (SELECT rid, s, min(w) AS a, max(w) AS b FROM win
        WHERE list_sum(list_transform(map_values(list_histogram(string_split(x, ''))), lambda c: ({weights})[c::BIGINT + 1])) <= lim
        GROUP BY rid, s),
spans AS (SELECT rid, k, s, s + length(t) AS e FROM found WHERE k < 3
          UNION ALL SELECT rid, 3, s + a - 1, s + b - 1 + {WINDOW} FROM hot),
per AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
               count(*) FILTER (k = 2) AS n_hex,
               string_agg(({names})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base,
               string_agg(({names})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
        FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)"""
