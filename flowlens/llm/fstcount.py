"""Token counts from a compiled finite-state transducer instead of an encoder.

The BPE encoding of a prefix has a well-defined last token, and that token is the only vocabulary token that ends
there, starts where another prefix ends, and is compatible with that prefix's last token (the merges of the two
together leave the two).  What a character does to the encoding therefore depends only on the tokens still open: the
trie nodes of the suffixes that may grow into a token, with the last token before each and its count relative to the
present one.  That tuple is the state; a transition reads one character, leads to the next state and is annotated
with the change in the number of emitted tokens.  States and transitions are compiled on first use and kept by the
worker process.  A word (spaces before non-spaces) starts in one fixed state, whatever came before, because no token
holds a space after a non-space.

So a chunk of a text is a map from incoming states that has a short normal form: a head (what lies before the first
word start and still depends on the incoming state), a constant count, and a tail (the word that the next chunk goes
on with, which names the outgoing state).  These maps compose associatively; the chunks of a long text are counted in
separate rows and their maps composed in a scan over the document's chunks.

Runs of spaces: space-only pieces have the lowest score of all, so the words' merges come first; what is left of a
run merges by itself and is counted once for each length.

Defined cases: null or empty text has no tokens; one text may be of any length; repeated rows give repeated results;
an empty table an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Numbered, batch, map_text, text_slices

SPACE = "▁"
#: Characters of a chunk: texts up to this length are one row, longer ones are composed from several.
CHUNK_CHARS = 1 << 16
MEMO_WORDS = 400_000
STATES = 200_000
_GROUP = re.compile(" *[^ ]+| +")


class Transducer:
    """Lazily compiled token-count transducer of a sentencepiece BPE file with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        if (n.name != "identity" or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces
                or not n.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix
                or not spec.trainer_spec.byte_fallback or spec.trainer_spec.model_type != 2):
            raise ValueError(f"{path} is not a BPE file of the known kind")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if spec.pieces[i].type == 1]
        if any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("user-defined or unused pieces are not compiled")
        self.score = {spec.pieces[i].piece: spec.pieces[i].score for i in ids}
        lowest = min(s for p, s in self.score.items() if p.strip(SPACE))
        for p, s in self.score.items():
            spaces_only = not p.strip(SPACE)
            if (SPACE in p.lstrip(SPACE) or not spaces_only and p.startswith(2 * SPACE)
                    or len(p) > 1 and (spaces_only and s >= lowest or any(c not in self.score for c in p))):
                raise ValueError(f"piece {p!r} breaks the word rule")
        self.trie: list[dict[str, int]] = [{}]
        self.piece_at: list[str | None] = [None]
        for p in self.score:
            if not p.strip(SPACE) and p != SPACE:
                continue
            node = 0
            for c in p:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.piece_at.append(None)
                node = self.trie[node][c]
            self.piece_at[node] = p
        self.pair_ok: dict[tuple[str, str], bool] = {}
        self.valid: dict[str, bool] = {}
        self.run_count: dict[int, int] = {0: 0}
        self.clear()

    def clear(self) -> None:
        """Forget states and words (they are compiled again when met)."""
        self.states: dict[tuple, int] = {}
        self.entries: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.words = Numbered()
        self.counts = np.zeros(1024, dtype=np.int64)
        base = self._state(((0, None, 0),))
        self.start, self.start_count = self._step(base, SPACE)

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a string without unknown characters: the definition that the transitions are compiled from."""
        parts = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-self.score[a + b], i, a + b, a) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
        heapq.heapify(heap)
        while heap:
            _, i, whole, left = heapq.heappop(heap)
            j = after[i]
            if j >= len(parts) or parts[i] != left or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts) and (w := parts[k] + parts[after[k]]) in self.score:
                    heapq.heappush(heap, (-self.score[w], k, w, parts[k]))
        return [p for p in parts if p]

    def _compatible(self, left: str | None, right: str) -> bool:
        if right not in self.valid:
            self.valid[right] = self.merge(right) == [right]
        if not self.valid[right]:
            return False
        if left is None:
            return True
        if (left, right) not in self.pair_ok:
            self.pair_ok[left, right] = self.merge(left + right) == [left, right]
        return self.pair_ok[left, right]

    def _state(self, entry: tuple) -> int:
        if entry not in self.states:
            self.states[entry] = len(self.entries)
            self.entries.append(entry)
            self.moves.append({})
        return self.states[entry]

    def _step(self, state: int, c: str) -> tuple[int, int]:
        """Compile the transition of a state under a character: (next state, emitted tokens)."""
        if c not in self.score:  # as bytes, and no merge crosses it
            move = (self._state(((0, None, 0),)), len(c.encode("utf-8", "surrogatepass")))
        else:
            grown, token, emitted = [], None, 0
            for node, last, ahead in self.entries[state]:
                child = self.trie[node].get(c)
                if child is None:
                    continue
                p = self.piece_at[child]
                if p is not None and self._compatible(last, p):
                    if token is not None:
                        raise AssertionError(f"two tokens end at one place: {token!r}, {p!r}")
                    token, emitted = p, ahead + 1
                grown.append((child, last, ahead))
            if token is None:
                raise AssertionError(f"no token ends after {c!r}")
            move = (self._state(tuple((n, t, a - emitted) for n, t, a in grown if self.trie[n]) + ((0, token, 0),)),
                    emitted)
        self.moves[state][c] = move
        return move

    def _word(self, word: str) -> int:
        """Tokens of one word with one space before it."""
        state, n, moves = self.start, self.start_count, self.moves
        for c in word:
            move = moves[state].get(c) or self._step(state, c)
            state = move[0]
            n += move[1]
        return n

    def _run(self, n: int) -> int:
        """Tokens of a run of n spaces by itself."""
        if n not in self.run_count:
            self.run_count[n] = len(self.merge(SPACE * n))
        return self.run_count[n]

    def word_counts(self, words: list[str]) -> np.ndarray:
        if len(self.words) > MEMO_WORDS or len(self.entries) > STATES:
            self.clear()
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.new:
            new, self.words.new = self.words.new, []
            k, m = len(self.words) - len(new), len(self.words)
            if m > len(self.counts):
                self.counts = np.concatenate([self.counts[:k], np.zeros(2 * m - k, dtype=np.int64)])
            self.counts[k:m] = np.fromiter(map(self._word, new), np.int64, len(new))
        return self.counts[at]

    def group(self, group: str) -> int:
        """Tokens of one group: a run of spaces and the word after it (which may be empty)."""
        word = group.lstrip(" ")
        spaces = len(group) - len(word)
        if not word or not spaces:
            return self._run(spaces) if not word else self._loose(word)
        n = int(self.word_counts([word])[0])
        if spaces == 1:
            return n
        cut = next((i for i, c in enumerate(word) if c not in self.score), len(word))
        bare = self.merge(SPACE + word[:cut])[0] == SPACE
        return n - bare + self._run(spaces - (not bare))

    def _loose(self, word: str) -> int:
        """Tokens of a word without a space before it (it only occurs where a chunk's head is asked for by itself)."""
        state, n = self._state(((0, None, 0),)), 0
        for c in word:
            state, d = self.moves[state].get(c) or self._step(state, c)
            n += d
        return n

    def chunk(self, text: str) -> tuple[str, bool, int, str]:
        """The map of one chunk (spaces as spaces): head, whether a word starts inside, constant count, tail."""
        inner = text.lstrip(" ")
        lead = len(text) - len(inner)
        first = inner.find(" ")
        if first < 0:
            return text, False, 0, ""
        last = len(text.rstrip(" "))
        cut = text.rfind(" ", 0, last) if last > lead + first else -1
        # the tail starts at the spaces of the last word start
        if last < len(text):
            cut = last
        else:
            cut = len(text[:cut].rstrip(" "))
        head, middle, tail = text[:lead + first], text[lead + first:cut], text[cut:]
        if "  " not in middle:
            n = int(self.word_counts(middle.split(" ")[1:]).sum()) if middle else 0
        else:
            n = sum(map(self.group, _GROUP.findall(middle)))
        return head, True, n, tail

    def compose(self, a: tuple[str, bool, int, str], b: tuple[str, bool, int, str]) -> tuple[str, bool, int, str]:
        """The map of two neighbouring chunks: a's outgoing word goes on with b's head."""
        if not a[1]:
            joint = self.chunk(a[0] + b[0])
            if not joint[1]:
                return joint[0], b[1], b[2], b[3]
            if not b[1]:
                return joint
            return joint[0], True, joint[2] + self.group(joint[3]) + b[2], b[3]
        joint = self.chunk(a[3] + b[0])  # a[3] starts a word, so all of it is known
        if not joint[1]:
            if not b[1]:
                return a[0], True, a[2], joint[0]
            return a[0], True, a[2] + self.group(joint[0]) + b[2], b[3]
        known = a[2] + self.group(joint[0]) + joint[2]
        if not b[1]:
            return a[0], True, known, joint[3]
        return a[0], True, known + self.group(joint[3]) + b[2], b[3]

    def total(self, m: tuple[str, bool, int, str]) -> int:
        """Tokens of a whole text from its map, the space put before every text included."""
        head, more, n, tail = m
        return self.group(head) + (n + self.group(tail) if more else 0)


def normal(text: str) -> str:
    return text.replace(SPACE, " ")


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker process's transducer of a file."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


_MAP = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()),
                  ("n_bytes", pa.int64()), ("head", pa.string()), ("more", pa.bool_()), ("n", pa.int64()),
                  ("tail", pa.string())])


def count(docs: DataFrame, path: str, limit: int, chunk_chars: int = CHUNK_CHARS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text."""
    length = F.length("text")
    # one row for each chunk; the row number keeps documents of equal id apart
    chunks = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
              .withColumn("row", F.xxhash64("doc_id", "text"))
              .withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.coalesce(length, F.lit(0)) / chunk_chars)).cast("int")))
    short = chunks.where("chunks = 1").select("doc_id", "text")
    long = (chunks.where("chunks > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("doc_id", "row", "chunk", "chunks",
                    F.col("text").substr(F.col("chunk") * chunk_chars + 1, F.lit(chunk_chars)).alias("text")))
    whole_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for ids, texts in text_slices(batches):
            size = [len((x or "").encode("utf-8", "surrogatepass")) for x in texts]
            plain = [normal(x).split(" ") if x and "  " not in x and SPACE not in x and x[0] != " " and x[-1] != " "
                     else [] for x in texts]
            ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
            n = np.concatenate([[0], np.cumsum(t.word_counts(list(chain.from_iterable(plain))))])
            got = np.diff(np.concatenate([[0], n[ends]]))
            for i, x in enumerate(texts):
                if x and not plain[i]:
                    got[i] = t.total(t.chunk(" " + normal(x)))
            yield batch(whole_schema, ids, size, got)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            rows = []
            for doc, row, chunk, chunks, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = (" " if chunk == 0 else "") + normal(text)
                rows.append((doc, row, chunk, chunks, len(text.encode("utf-8", "surrogatepass")), *t.chunk(x)))
            if rows:
                yield batch(_MAP, *map(list, zip(*rows, strict=True)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compose the maps of each document; rows come sorted by document and chunk, one text's rows together."""
        t, out, acc, size = transducer(path), [], [], 0
        for b in batches:
            for r in b.to_pylist():
                acc.append((r["head"], r["more"], r["n"], r["tail"]))
                size += r["n_bytes"]
                if len(acc) == r["chunks"]:
                    while len(acc) > 1:  # a balanced tree of compositions
                        acc = [t.compose(acc[i], acc[i + 1]) if i + 1 < len(acc) else acc[i]
                               for i in range(0, len(acc), 2)]
                    out.append((r["doc_id"], size, t.total(acc[0])))
                    acc, size = [], 0
            if out:
                yield batch(whole_schema, *map(list, zip(*out, strict=True)))
                out = []

    ddl = "doc_id long, n_bytes long, n_tokens long"
    copies = F.row_number().over(_copies())
    mapped = long.mapInArrow(maps, "doc_id long, row long, chunk int, chunks int, n_bytes long, head string, "
                                   "more boolean, n long, tail string")
    composed = (mapped.withColumn("copy", copies).repartition("doc_id", "row", "copy")
                .sortWithinPartitions("doc_id", "row", "copy", "chunk").drop("copy").mapInArrow(scan, ddl))
    counted = map_text(short, whole, ddl).unionByName(composed)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _copies():
    from pyspark.sql import Window
    return Window.partitionBy("doc_id", "row", "chunk").orderBy("n")
