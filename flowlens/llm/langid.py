"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary logistic classifier per bit on hashed character n-grams of the
lower-cased text; decoding adds up, over the bits, the logistic loss of the language's bit weighted by how well that
bit's classifier did on held-back training rows, and takes the codeword with the least loss.  ``score`` is the
normalised likelihood of that codeword; ``ambiguous`` flags texts whose best two codewords are close or whose hard
bits are further from the codeword than the code can correct.

Up to ``EXHAUSTIVE`` languages the code has every split of the languages into two non-empty sides; beyond that a
random dense code (fixed seed) with the largest minimum distance of ``CODE_TRIES`` drawn.

Defined cases: text that is null or has no letter (Unicode categories L*; digits, fractions and numerals are none) ->
``und`` with score 0; training rows of one id are rows of their own, each with its own text and language; no labelled row at all -> everything
``und``; one language -> that language with score 1; a language seen once still gets a codeword; equal losses go to
the language first in alphabetical order; repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import batch, map_text, text_slices
from flowlens.llm.linear import fit_dense

#: Bound of the training sample: rows per language, those with the smallest hash of their id.
MAX_TRAIN_ROWS = 400
DIM = 1 << 13
EXHAUSTIVE = 6
CODE_TRIES = 200
AMBIGUOUS_MARGIN = 0.2
SCHEMA = "doc_id long, lang_pred string, score double, ambiguous boolean"
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                  ("ambiguous", pa.bool_())])


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray      # languages x bits, entries -1 / +1
    weights: np.ndarray   # DIM x bits
    bias: np.ndarray
    bit_weight: np.ndarray


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """Code matrix (k x bits) of -1/+1: all two-sided splits for small k, else the best random dense code."""
    if k < 2:
        return np.ones((k, 0))
    if k <= EXHAUSTIVE:
        bits = np.arange(1, 2 ** (k - 1))
        m = ((bits[None, :] >> np.arange(k - 1)[:, None]) & 1) * 2.0 - 1.0
        return np.vstack([-np.ones((1, m.shape[1])), m])
    n, rng, best, far = 6 * int(np.ceil(np.log2(k))) + 7, np.random.default_rng(seed), None, -1
    for _ in range(CODE_TRIES):
        m = rng.integers(0, 2, (k, n)) * 2.0 - 1.0
        if (np.abs(m.sum(0)) == k).any():
            continue
        d = (n - m @ m.T) / 2 + np.eye(k) * n
        if d.min() > far:
            best, far = m, d.min()
    if far < 1:
        raise ValueError("no code with distinct codewords found")
    return best


def features(text: str) -> np.ndarray:
    """Scaled shares of hashed byte 2- and 3-grams of the lower-cased text (white space runs and digits as they are)."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0x01000193) + b[2:] * np.uint32(0xC2B2AE35)
    x = np.bincount(two >> np.uint32(20), minlength=DIM)
    x += np.bincount((three >> np.uint32(20)) + np.uint32(DIM // 2), minlength=DIM)
    return (np.sqrt(x * (16.0 / len(b)))).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features leave compressed: most are zero, and the driver holds the rows in its JVM and again in Python."""
    import zstandard
    schema = pa.schema([("row", pa.struct([("id", pa.int64()), ("lang", pa.string())])), ("z", pa.binary())])
    press = zstandard.ZstdCompressor(level=3)
    for rows, texts in text_slices(batches):
        yield batch(schema, rows, [press.compress(features(t or "").tobytes()) for t in texts])


def _distinct(rows: list) -> tuple[list[str], list[bytes]]:
    """Language and compressed features of the distinct rows, by id (nulls last), language and features."""
    import zstandard
    unpress, by = zstandard.ZstdDecompressor(), {}
    for r in rows:
        by.setdefault((r["row"]["id"] is None, r["row"]["id"] or 0, r["row"]["lang"]), set()).add(bytes(r["z"]))
    langs, packed = [], []
    for key in sorted(by):
        own = by[key] if len(by[key]) == 1 else dict(sorted((unpress.decompress(z), z) for z in by[key])).values()
        langs += [key[2]] * len(own)
        packed += own
    return langs, packed


def _matrix(packed: list[bytes], wanted: np.ndarray) -> np.ndarray:
    """The features of the wanted rows, one text after another so that they are held once."""
    import zstandard
    unpress, at = zstandard.ZstdDecompressor(), np.flatnonzero(wanted)
    x = np.empty((len(at), DIM), np.float32)
    for k, i in enumerate(at.tolist()):
        x[k] = np.frombuffer(unpress.decompress(packed[i]), np.float32)
    return x


def fit(docs: DataFrame, usable: Column, max_rows: int = MAX_TRAIN_ROWS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on rows where ``usable`` holds and the language is not null: at most ``max_rows`` per language."""
    rows = docs.where(usable).where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    keys = rows.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs, code = sorted(counts), codewords(len(counts))
    if len(langs) == 1:
        return LanguageModel(langs, code, np.zeros((DIM, 0)), np.zeros(0), np.zeros(0))
    # a hash threshold a little above the wanted share per language, then the exact bound
    space = 1 << 30
    limit = F.create_map(*[F.lit(x) for k, n in counts.items()
                           for x in (k, int(space * min(1.0, (2.0 * max_rows + 50) / n)))])
    order = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(space))
    near = rows.where(order < limit[F.col(lang_col).cast("string")]).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"), order.alias("h"))
    from pyspark.sql import Window
    picked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(
        F.col("r") <= max_rows)
    # at most max_rows rows for each language
    labels, packed = _distinct(picked.select(F.struct("id", "lang").alias("row"), "text").mapInArrow(
        _featured, "row struct<id:long,lang:string>, z binary").collect())
    y = np.array([langs.index(k) for k in labels])
    target = (code[y] + 1) / 2
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held])) < len(langs):
        held[:] = False
    w, b = fit_dense(_matrix(packed, ~held), target[~held])
    test = held if held.any() else ~held
    right = ((_matrix(packed, test) @ w + b > 0) == (target[test] > 0.5)).mean(0)
    weight = np.maximum(right - 0.5, 0.01)
    return LanguageModel(langs, code, w, b, weight / weight.mean())


def decode(m: LanguageModel, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding of bit margins (texts x bits): language index, score, ambiguous."""
    loss = np.stack([(np.logaddexp(0, -f * c) * m.bit_weight).sum(1) for c in m.code], 1)
    like = np.exp(-(loss - loss.min(1, keepdims=True)))
    p = like / like.sum(1, keepdims=True)
    best = p.argmax(1)
    top = p[np.arange(len(p)), best]
    second = np.where(np.arange(p.shape[1])[None, :] == best[:, None], 0, p).max(1) if p.shape[1] > 1 else 0 * top
    n = m.code.shape[1]
    gram = m.code @ m.code.T - 2 * n * np.eye(len(m.code))
    reach = (n - gram.max()) / 2 if len(m.code) > 1 else n  # the least distance of two codewords
    wrong = (np.where(f > 0, 1, -1) != m.code[best]).sum(1)
    return best, top, (top - second < AMBIGUOUS_MARGIN) | (2 * wrong > reach)


def judge(m: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    known = [m is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
    lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    at = np.flatnonzero(known)
    for part in np.array_split(at, max(1, len(at) // 256)) if len(at) else []:
        if len(m.langs) == 1:
            best, top, amb = np.zeros(len(part), int), np.ones(len(part)), np.zeros(len(part), bool)
        else:
            best, top, amb = decode(m, np.vstack([features(texts[i]) for i in part]) @ m.weights + m.bias)
        for i, k in zip(part, best, strict=True):
            lang[i] = m.langs[k]
        score[part], unsure[part] = np.clip(top, 0.0, 1.0), amb
    return lang, score, unsure


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every whole text; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            yield batch(_OUT, ids, *judge(shared.value, texts))

    return map_text(docs, run, SCHEMA, id_col, text_col)


def accepted(docs: DataFrame, model: LanguageModel | None, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) whose text has a language with at least ``least_score``; only the text goes
    through Python, and nothing shuffles."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def stays(text: pa.Array) -> pa.Array:
        kept = []
        for _, texts in text_slices([pa.RecordBatch.from_arrays([text, text], ["id", "text"])]):
            lang, score, _ = judge(shared.value, texts)
            kept += [k != "und" and s >= least_score for k, s in zip(lang, score, strict=True)]
        return pa.array(kept, pa.bool_())

    return docs.where(stays(F.col(text_col).cast("string")))


__all__ = ["fit", "predict", "accepted", "decode", "codewords", "LanguageModel"]
