"""Token ids of whole texts with the ``tokenizers`` library, each distinct space-separated unit encoded once.

A byte-level BPE file whose pre-tokenizer only splits (no normalizer) gives the ids of a text as the concatenation
of the ids of its units " word" wherever no white-space run crosses a unit's edge.  Texts for which that does not
hold (two spaces in a row, a blank line, a tab, an unusual space, ...) go to the library as they are.  Both ways give
the library's own ids; tests hold them against direct encoding.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np

from flowlens.llm.common import Numbered

#: Units kept by one worker (about 200 bytes each); when the memo is full its rarest units go.
MEMO_UNITS = 800_000
#: The same where a worker has other work before and after.
LEAN_MEMO_UNITS = 100_000
#: Units that are joined to one string for the library, whose work on a string goes beyond that on its words.
JOINED_UNITS = 256
#: A unit that ends in a few of these signs after one of these letters splits there for certain (every Unicode version
#: has them as letters), so word and signs are looked up apart.
_SIGNS, _MOST_SIGNS = ".,;:!?#$%&*", 4
_LETTERS = frozenset(map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)))) - {"\u00d7", "\u00f7"}
_PLAIN_PRETOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: White space other than space and \n: a text with one of them is encoded directly, as is one with white space in
#: a row (fixed values).
_ODD_ASCII = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_ODD_WIDE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _direct(t: str) -> bool:
    return t[:1] in ("", " ", "\n") or any(x in t for x in _ODD_ASCII) or (
        not t.isascii() and _ODD_WIDE.search(t) is not None)


def taken(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of the pool that begin at ``begin``, one after another, and their sizes."""
    ends = np.cumsum(size)
    return pool[np.arange(int(size.sum()), dtype=np.int64) + np.repeat(begin - (ends - size), size)], size


class UnitPool:
    """Units numbered as they are met, each new one worked out once; a full pool is made smaller."""

    def __init__(self, dtype: np.dtype, memo_units: int) -> None:
        self.dtype, self.memo_units = np.dtype(dtype), memo_units
        self.clear()

    def clear(self) -> None:
        self.memo = Numbered()
        self.start = np.zeros(1024, dtype=np.int64)  # start[i], start[i + 1]: unit i's ids in the pool
        self.used = np.zeros(1024, dtype=np.int32)
        self.pool = np.zeros(4096, dtype=self.dtype)

    def shrink(self) -> None:
        """Keep the units that were met more than once, at most half of the bound; what they were met counts half then."""
        m, least = len(self.memo), 2
        while np.count_nonzero(self.used[:m] >= least) > self.memo_units // 2:
            least *= 2
        keep = np.flatnonzero(self.used[:m] >= least)
        names, used = list(self.memo), self.used[keep] // 2
        ids, sizes = taken(self.pool, self.start[keep], self.start[keep + 1] - self.start[keep])
        self.clear()
        self.memo.update(zip((names[i] for i in keep.tolist()), range(len(keep))))
        self._append(ids, sizes, 0)
        self.used[:len(keep)] = used

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units and the number of ids of each."""
        raise NotImplementedError

    def _append(self, ids: np.ndarray, sizes: np.ndarray, k: int) -> None:
        """Ids of the units from number k on."""
        m, ends = k + len(sizes), np.cumsum(sizes) + self.start[k]
        if m + 1 > len(self.start):
            self.start = np.concatenate([self.start[:k + 1], np.zeros(2 * m - k, dtype=np.int64)])
            self.used = np.concatenate([self.used[:k + 1], np.zeros(2 * m - k, dtype=np.int32)])
        if len(ends) and ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.start[k]],
                                        np.zeros(2 * ends[-1] - self.start[k], dtype=self.dtype)])
        self.pool[self.start[k]:self.start[k] + len(ids)] = ids
        self.start[k + 1:m + 1] = ends

    def numbers(self, units: Iterable[str], n: int) -> np.ndarray:
        if len(self.memo) > self.memo_units:
            self.shrink()
        at = np.fromiter(map(self.memo.__getitem__, units), np.int64, n)
        if self.memo.new:
            units, self.memo.new = self.memo.new, []
            ids, sizes = self.encode_units(units)
            self._append(ids, sizes, len(self.memo) - len(units))
        self.used[:len(self.memo)] += np.bincount(at, minlength=len(self.memo)).astype(np.int32)
        return at


class UnitEncoder(UnitPool):
    """``encode(texts)`` -> (all ids, end of each text); ids as the library gives with add_special_tokens=False."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's task slots are the parallelism
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = spec.get("normalizer") is None and all(pre.get(k) == v for k, v in _PLAIN_PRETOKENIZER.items())
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        self.signs = "".join(c for c in _SIGNS if not any(c in t for t in added.values()))
        vocab = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # a byte-level piece has a character a byte
        for piece, i in vocab.items():
            self.n_bytes[i] = len(piece.encode()) if i in added else len(piece)
        self.tails: dict[str, int] = {}
        super().__init__("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4", memo_units)
        self.sign_ids, self.sign_sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text by itself."""
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.dtype, int(sizes.sum())), sizes

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that begin with white space and end with none: many as one string, whose tokens' byte
        lengths tell where each text ends."""
        whole = ["".join(texts[i:i + JOINED_UNITS]) for i in range(0, len(texts), JOINED_UNITS)]
        ids, _ = self.apart(whole)
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)))
        token_ends = np.cumsum(self.n_bytes[ids])
        last = np.searchsorted(token_ends, ends)
        if len(ids) and last[-1] == len(ids) - 1 and (token_ends[last] == ends).all():
            return ids, np.diff(last, prepend=-1)
        return self.apart(texts)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A unit that starts with \n stands for itself, others follow a space.  Words that are in the pool already and
        the signs after a word are not encoded again."""
        known, need, word, sign = len(self.memo) - len(units), {}, [], []
        for u in units:
            w = u.rstrip(self.signs)
            tail = u[len(w):]
            if not tail or len(tail) > _MOST_SIGNS or w[-1:] not in _LETTERS:
                w, tail = u, ""
            i = self.memo.get(w, known) if tail else known
            word.append(i if i < known else known + need.setdefault(w, len(need)))
            sign.append(self.tails.setdefault(tail, len(self.tails)))
        texts = [w if w[:1] == "\n" else " " + w for w in need]
        # a unit of white space alone would run together with the next
        bare = [i for i, t in enumerate(texts) if len(t) == 1]
        if bare:
            ids, sizes = self.apart(texts)
        else:
            ids, sizes = self.joined(texts)
        if len(self.tails) > len(self.sign_sizes):
            more = self.apart(list(self.tails)[len(self.sign_sizes):])
            self.sign_ids, self.sign_sizes = (np.concatenate(x) for x in zip((self.sign_ids, self.sign_sizes), more))
        signs, n_signs = self.sign_ids, self.sign_sizes
        base = int(self.start[known])
        source = np.concatenate([self.pool[:base], ids, signs])
        starts = np.concatenate([self.start[:known], base + np.cumsum(sizes) - sizes])
        size = np.concatenate([np.diff(self.start[:known + 1]), sizes])
        sign_starts = base + len(ids) + np.cumsum(n_signs) - n_signs
        begin = np.stack([starts[word], sign_starts[sign]], axis=1).ravel()
        count = np.stack([size[word], n_signs[sign]], axis=1)
        return taken(source, begin, count.ravel())[0], count.sum(1)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or "" for t in texts]
        parts: list[list[str]] = []
        whole: list[int] = []
        for i, t in enumerate(texts):
            if not self.by_unit or _direct(t):
                parts.append([])
                if t:
                    whole.append(i)
            else:
                # the first unit follows no space: a leading \n marks it, its id is dropped below
                parts.append(("\n" + t.replace("\n", " \n")).split(" "))
        at = self.numbers(chain.from_iterable(parts), sum(map(len, parts)))
        n_units = np.fromiter(map(len, parts), np.int64, len(parts))
        unit_ends = np.cumsum(n_units)
        begin, size = self.start[at], self.start[at + 1] - self.start[at]
        first = (unit_ends - n_units)[n_units > 0]  # the marker newline is one token of each first unit
        begin[first] += 1
        size[first] -= 1
        ids = taken(self.pool, begin, size)[0]
        doc_ends = np.concatenate([[0], np.cumsum(size)])[unit_ends]
        if not whole:
            return ids, doc_ends
        direct = dict(zip(whole, (e.ids for e in self.tok.encode_batch_fast([texts[i] for i in whole],
                                                                            add_special_tokens=False)), strict=True))
        out, lens, prev = [], [], 0
        for i, e in enumerate(doc_ends):
            piece = np.asarray(direct[i], dtype=self.dtype) if i in direct else ids[prev:e]
            prev = e
            out.append(piece)
            lens.append(len(piece))
        return np.concatenate(out), np.cumsum(lens)


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def encoder(path: str, memo_units: int = MEMO_UNITS) -> UnitEncoder:
    """The worker process's encoder for a tokenizer file (it and its memo live as long as the process)."""
    if (path, memo_units) not in _ENCODERS:
        _ENCODERS[path, memo_units] = UnitEncoder(path, memo_units)
    return _ENCODERS[path, memo_units]
