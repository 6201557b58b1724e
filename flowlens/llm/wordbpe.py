"""BPE with word ends: encoding by contiguous rank arrays, and decoding.

A word (one match of the file's split pattern in the normalised text) starts as its bytes, the last one with the
word-end mark.  Its part boundaries and the ranks of adjacent parts lie in one array each; the least rank is looked
for by a plain scan (leftmost among equals), the boundary between its two parts is deleted, and the ranks of the two
neighbours are looked up anew - until no adjacent pair has a rank.  Words of equal length are scanned together as the
rows of one matrix; every row loses one boundary in each round, so the matrix stays rectangular, and finished rows
leave it.  Words longer than ``SHORT`` bytes take the same merges from a heap, so a very long word costs n log n.

``encode`` normalises as the file says (NFC, white-space runs to one space, lower case, character by character),
lets added tokens win over the rest of the text, and drops symbols that the vocabulary lacks.  Python's Unicode tables
are of another version than the library's, so texts with characters beyond a checked set are normalised and split by
the library's normalizer and pre-tokenizer; the merges are the same arrays.  ``decode`` joins token
strings by one space, as the library does for a file without decoder.

Defined cases: null or empty text has no tokens and decodes to the empty string; repeated rows give repeated results;
an empty table an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.common import batch, map_text, text_slices
from flowlens.llm.encoding import UnitPool

SHORT = 64
MEMO_UNITS = 400_000
_NONE = np.int32(2 ** 31 - 1)
_SPACE = re.compile("[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NOT_SPACE = re.compile("[\x1c-\x1f]")  # white space for str.split only
#: Blocks whose composition, case and classes are the same in Python and in the library (tests go through them); a text
#: with any other character is normalised and split by the library's own objects.
_OTHER = re.compile("[^\0-\u024f\u0300-\u036f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0482\u048a-\u0527\u1e00-\u1e95"
                    "\u1ea0-\u1ef9\u2000-\u2064\u20a0-\u20b9\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 characters are themselves,
    the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class PairRanks:
    """(left id, right id) -> (rank, merged id) as an open-addressing table for whole arrays of pairs."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.bits = max(8, (len(pairs) * 8).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, _NONE, dtype=np.int32)
        self.merged = np.zeros(1 << self.bits, dtype=np.int32)
        key = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        value = np.array(list(pairs.values()), dtype=np.int32).reshape(-1, 2)
        left, step = np.arange(len(key)), 0
        slot = self._slot(key)
        while len(left):  # one probe further each round; of keys that meet in a slot the first takes it
            at = (slot[left] + step) & ((1 << self.bits) - 1)
            won = np.zeros(len(left), dtype=bool)
            won[np.unique(at, return_index=True)[1]] = True
            won &= self.key[at] == -1
            self.key[at[won]] = key[left[won]]
            self.rank[at[won]], self.merged[at[won]] = value[left[won]].T
            left, step = left[~won], step + 1
        self.probes = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        rank, merged = np.full(key.shape, _NONE, dtype=np.int32), np.zeros(key.shape, dtype=np.int32)
        open_, at = np.arange(key.size), slot
        for _ in range(self.probes):
            there = self.key[at]
            hit = there == key[open_]
            rank[open_[hit]], merged[open_[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            more = ~hit & (there != -1)
            if not more.any():
                break
            open_, at = open_[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return rank, merged


class WordBpe(UnitPool):
    """Encoder and decoder of one tokenizer file of the kind described above."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS) -> None:
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"], kinds, split["type"], bytes_["type"], spec["decoder"]) != (
                "BPE", ["NFC", "Replace", "Lowercase"], "Split", "ByteLevel", None):
            raise ValueError(f"{path} is not a word-end BPE file of the known kind")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        end = model["end_of_word_suffix"] or ""
        self.inner = np.array([self.vocab.get(c, -1) for c in byte_symbols()], dtype=np.int32)
        self.last = np.array([self.vocab.get(c + end, -1) for c in byte_symbols()], dtype=np.int32)
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.ranks = PairRanks(self.pairs)
        super().__init__("<u4", memo_units)

    def clear(self) -> None:
        super().clear()
        self.id_text: list[str] = []
        self.token_text: list[str] = []

    def shrink(self) -> None:
        self.clear()

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges with a heap of (rank, position) over linked parts."""
        parts = [int(self.inner[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        parts = [p for p in parts if p >= 0]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] != pair[0] or j >= n or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = self.pairs[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (parts[k], parts[after[k]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], k, p))
        return [p for p in parts if p >= 0]

    def merge_equal(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words of one length together: [(word numbers, ids as a matrix)] by number of ids."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)
        parts = self.inner[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        who, out = np.arange(len(words)), []
        rank, merged = self.ranks.find(parts[:, :-1].ravel(), parts[:, 1:].ravel())
        rank, merged = rank.reshape(len(words), -1), merged.reshape(len(words), -1)
        while parts.shape[1] > 1:
            at = rank.argmin(1)
            going = rank[np.arange(len(at)), at] != _NONE
            if not going.all():
                out.append((who[~going], parts[~going]))
                who, parts, rank, merged, at = who[going], parts[going], rank[going], merged[going], at[going]
            if not len(who):
                return out
            row, width = np.arange(len(who)), parts.shape[1]
            new = merged[row, at]
            # delete boundary at + 1 of the parts and entry at of the ranks
            keep = np.arange(width)[None, :] != (at + 1)[:, None]
            parts = parts[keep].reshape(len(who), width - 1)
            parts[row, at] = new
            keep = np.arange(width - 1)[None, :] != at[:, None]
            rank, merged = rank[keep].reshape(len(who), width - 2), merged[keep].reshape(len(who), width - 2)
            for near, shift in ((at > 0, -1), (at < width - 2, 0)):
                r, c = row[near], at[near] + shift
                if len(r):
                    rank[r, c], merged[r, c] = self.ranks.find(parts[r, c], parts[r, c + 1])
        out.append((who, parts))
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[list[int]] = [[]] * len(raw)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            by.setdefault(len(w), []).append(i)
        lacking = (self.inner < 0).any() or (self.last < 0).any()
        for n, at in by.items():
            if n > SHORT or lacking:
                for i in at:
                    out[i] = self.merge_long(raw[i])
            else:
                for who, ids in self.merge_equal([raw[i] for i in at]):
                    for i, x in zip(who.tolist(), ids.tolist(), strict=True):
                        out[at[i]] = x
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [self._words(u) for u in units]
        words: dict[str, int] = {}
        for w in chain.from_iterable(pieces):
            words.setdefault(w, len(words))
        ids = self.encode_words(list(words))
        got = [ids[words[p[0]]] if len(p) == 1 else [x for w in p for x in ids[words[w]]] for p in pieces]
        names = self.tokens
        self.id_text += [" ".join(map(str, g)) for g in got]
        self.token_text += [" ".join([names[x] for x in g]) for g in got]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.dtype, int(sizes.sum())), sizes

    def _words(self, unit: str) -> list[str]:
        if _OTHER.search(unit):
            return [w for w, _ in self.split.pre_tokenize_str(unit)]
        return [unit] if unit.isalpha() else self.pattern.findall(unit)

    def units(self, text: str) -> list[str]:
        if not text.isascii():
            if _OTHER.search(text):
                return [u for u in self.normalizer.normalize_str(text).split(" ") if u]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
            # a lower-case mapping may not look at its neighbours
        if _NOT_SPACE.search(text):
            return [u for u in _SPACE.split(text.lower()) if u]
        return text.lower().split()

    def rows(self, texts: list[str | None]) -> Iterator[tuple[list[int] | None, int, str, str]]:
        """For each text: its ids as numbers of the memo (None where added tokens occur), number of ids, the ids in
        decimal and the decoded text."""
        direct = {i: self.encode(t) for i, t in enumerate(texts) if t and self.special and self.special.search(t)}
        split = [self.units(t) if t and i not in direct else [] for i, t in enumerate(texts)]
        at = self.numbers(chain.from_iterable(split), sum(map(len, split)))
        size = self.start[at + 1] - self.start[at]
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        total = np.concatenate([[0], np.cumsum(size)])
        prev = 0
        for i, e in enumerate(ends.tolist()):
            if i in direct:
                ids = direct[i]
                yield None, len(ids), " ".join(map(str, ids)), self.decode(ids)
                continue
            own = at[prev:e].tolist()
            n = int(total[e] - total[prev])
            prev = e
            yield (own, n, " ".join(filter(None, map(self.id_text.__getitem__, own))),
                   " ".join(filter(None, map(self.token_text.__getitem__, own))))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.added[part])
            else:
                units = self.units(part)
                at = self.numbers(units, len(units))
                for i in at.tolist():
                    out += self.pool[self.start[i]:self.start[i + 1]].tolist()
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_MODELS: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """The worker process's encoder of a file."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and ids (array<int>) with the decoded text; with ``digests`` the SHA-256 of both instead."""
    if digests:
        tail = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        tail = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        ddl = "doc_id long, n_tokens long, ids array<int>, decoded string"
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *tail])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for ids, texts in text_slices(batches):
            n, a, b = [], [], []
            for _, k, numbers, text in m.rows(texts):
                n.append(k)
                if digests:
                    a.append(hashlib.sha256(numbers.encode()).hexdigest())
                    b.append(hashlib.sha256(text.encode()).hexdigest())
                else:
                    a.append([int(x) for x in numbers.split()])
                    b.append(text)
            yield batch(schema, ids, n, a, b)

    return map_text(docs, run, ddl, id_col, text_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each row's ids (null ids: null)."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            yield batch(schema, b.column(0), [None if x is None else m.decode(x) for x in b.column(1).to_pylist()])

    return encoded.selectExpr(f"cast(`{id_col}` as long) id", f"`{ids_col}` ids").mapInArrow(
        run, "doc_id long, decoded string")
