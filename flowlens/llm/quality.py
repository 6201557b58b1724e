"""Quality rules: base word/line counts plus a calibrated logistic regression on hashed word and character n-grams.

The model is fitted on labelled quality rows (a bounded sample, ``MAX_TRAIN_ROWS`` per class), calibrated on a
held-out fifth of them with Platt scaling weighted back to the labels' class shares, and applied to whole texts in
Arrow batches.  A document is kept when it passes the base rules and its probability of good quality reaches
``KEEP_AT``.

Defined cases: null text counts as a text without words (all counts 0, base_failed, not kept); empty text the same;
a doc_id that occurs twice gives two rows; labels with a null doc_id, a null quality or an id without a document are
not used, of several labels of one id the smallest quality counts; with labels of fewer than two classes there is no
model (``quality`` null) and only the base rules decide; an empty table gives an empty result.  Only the id and text
columns are read, so extra or clashing columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Numbered, batch, map_text, text_slices
from flowlens.llm.linear import fit_sparse, platt, sigmoid

#: Fixed thresholds of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5
#: Bound of the training sample: labelled rows per class, those with the smallest hash of their id.
MAX_TRAIN_ROWS = 1000
#: Hash space of each of the four n-gram groups (words, word pairs, character 3-grams, character 4-grams).
GROUP_DIM = 1 << 16
GROUPS = 4
#: A feature is the n-gram's share of its group's n-grams times this.
SCALE = 16.0
SYMBOLS = b"#*$%&|<>"
_WORD_BITS = 21

SCORE_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                "base_failed boolean, kept boolean, quality double")
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
                  ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                  ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality", pa.float64())])


@dataclass
class QualityModel:
    """Hashed weights (groups x dim), bias, and the calibration line of the logit."""
    weights: np.ndarray
    bias: float
    a: float
    c: float

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * logit + self.c)


class Words:
    """Word numbers and hashes of one slice of texts: each distinct word is hashed once."""

    def __init__(self) -> None:
        self.ids = Numbered()
        self.hashes = np.zeros(1024, dtype=np.uint32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if self.ids.new:
            new, self.ids.new = self.ids.new, []
            k, m = len(self.ids) - len(new), len(self.ids)
            if m > len(self.hashes):
                self.hashes = np.concatenate([self.hashes[:k], np.zeros(2 * m - k, dtype=np.uint32)])
            self.hashes[k:m] = np.fromiter(map(zlib.crc32, new), np.uint32, len(new))
        return at

    def hashed(self, numbers: np.ndarray) -> np.ndarray:
        return self.hashes[numbers]


def repeated_words(a: np.ndarray, n_ids: int) -> int:
    """Words inside 3-word windows that occur at least twice (positions count, overlaps included)."""
    if len(a) < 4:
        return 0
    if n_ids >= 1 << _WORD_BITS:
        a = np.unique(a, return_inverse=True)[1].astype(np.int64)
        n_ids = int(a.max()) + 1
    if n_ids < 1 << _WORD_BITS:
        key = (a[:-2] << (2 * _WORD_BITS)) | (a[1:-1] << _WORD_BITS) | a[2:]
    else:
        pair = np.unique(a[:-1] * n_ids + a[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] * n_ids + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    covered = np.zeros(len(a), dtype=bool)
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def grams(raw: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Hash slots of the words, word pairs, and character (byte) 3- and 4-grams of one text."""
    mask, shift = np.uint32(GROUP_DIM - 1), np.uint32(16)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    pair = hashes[:-1] * np.uint32(0x9E3779B1) + hashes[1:]
    pair ^= pair >> shift
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(0x01000193) + b[2:] * np.uint32(0x85EBCA6B)
    four = three[:-1] * np.uint32(0x01000193) + b[3:] * np.uint32(0xC2B2AE35)
    three ^= three >> shift
    four ^= four >> shift
    return [hashes & mask, pair & mask, three & mask, four & mask]


def base_counts(text: str | None, words: Words) -> tuple[tuple[int, int, int, int, int], bytes, np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.split()
    n = words.numbers(found)
    # continuation bytes are not counted, so this is code points
    joined = b"".join(found)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return ((len(found), chars, symbols, len(lines) - len(set(lines)), repeated_words(n, len(words.ids))), raw, n)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("slot", pa.binary()), ("share", pa.binary())])
    for ids, texts in text_slices(batches):
        words, slots, shares = Words(), [], []
        for t in texts:
            _, raw, n = base_counts(t, words)
            s, f = [], []
            for g, x in enumerate(grams(raw, words.hashed(n))):
                u, c = np.unique(x, return_counts=True)
                s.append((u + g * GROUP_DIM).astype("<u4"))
                f.append((SCALE * c / max(1, len(x))).astype("<f4"))
            slots.append(np.concatenate(s).tobytes())
            shares.append(np.concatenate(f).tobytes())
        yield batch(schema, ids, slots, shares)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, id_col: str = "doc_id",
        text_col: str = "text") -> QualityModel | None:
    """Fit and calibrate on at most ``max_rows`` labelled documents of each class (None without two classes)."""
    lab = (labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
           .where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y")))
    share = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return None
    order = F.xxhash64("id")
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(order, "id").limit(max_rows)
        picked = part if picked is None else picked.unionByName(part)
    chosen = {r["id"]: r["y"] for r in picked.collect()}  # at most 2 * max_rows ids
    ids = docs.sparkSession.createDataFrame(list(chosen.items()), "id long, y int")
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(ids.select("id")), "id").select("id", "text")
    rows = sorted(((r["id"], bytes(r["slot"]), bytes(r["share"])) for r in
                   sample.mapInArrow(_features, "id long, slot binary, share binary").collect()))
    # one row for each id even if documents repeats it
    rows = [r for i, r in enumerate(rows) if i == 0 or rows[i - 1][0] != r[0]]
    if not rows:
        return None
    idx = [np.frombuffer(r[1], "<u4") for r in rows]
    val = [np.frombuffer(r[2], "<f4") for r in rows]
    y = np.array([chosen[r[0]] for r in rows], dtype=np.float64)
    held = np.array([zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows])
    if len(set(y[~held])) < 2:
        held[:] = False

    def matrix(keep):
        k = np.flatnonzero(keep)
        ptr = np.concatenate([[0], np.cumsum([len(idx[i]) for i in k])]).astype(np.int64)
        return ptr, np.concatenate([idx[i] for i in k]).astype(np.int64), np.concatenate([val[i] for i in k])

    ptr, i, v = matrix(~held)
    yt = y[~held]
    balance = np.where(yt > 0.5, 0.5 / max(1, (yt > 0.5).sum()), 0.5 / max(1, (yt < 0.5).sum()))
    w, b = fit_sparse(ptr, i, v, yt, balance, GROUPS * GROUP_DIM)
    check = held if held.any() else ~held
    ptr, i, v = matrix(check)
    z = np.add.reduceat(np.append(w[i] * v, 0.0), ptr[:-1]) if len(i) else np.zeros(int(check.sum()))
    z = np.where(np.diff(ptr) > 0, z, 0.0) + b
    yc = y[check]
    prior = np.where(yc > 0.5, share[1] / max(1, (yc > 0.5).sum()), share[0] / max(1, (yc < 0.5).sum()))
    a, c = platt(z, yc, prior)
    return QualityModel(w.reshape(GROUPS, GROUP_DIM).astype(np.float32), float(b), a, c)


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text",
          min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
          keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: base counts, ``base_failed``, calibrated ``quality`` and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, texts in text_slices(batches):
            words, counts, logits = Words(), [], []
            for t in texts:
                c, raw, n = base_counts(t, words)
                counts.append(c)
                if m is not None:
                    z = m.bias
                    for g, x in enumerate(grams(raw, words.hashed(n))):
                        if len(x):
                            z += SCALE * float(m.weights[g][x].mean(dtype=np.float64))
                    logits.append(z)
            n = np.array(counts, dtype=np.int64).reshape(-1, 5)
            failed = (n[:, 0] < min_words) | (100 * n[:, 4] > max_repeat_percent * n[:, 0])
            if m is None:
                p, kept = pa.nulls(len(n), pa.float64()), ~failed
            else:
                q = m.probability(np.array(logits))
                p, kept = pa.array(q), ~failed & (q >= keep_at)
            yield batch(_OUT, ids, n[:, 0], n[:, 1], n[:, 2], n[:, 3], n[:, 4], failed, kept, p)

    return map_text(docs, run, SCORE_SCHEMA, id_col, text_col)
