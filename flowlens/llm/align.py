"""Alignment of two tokenizers' tokens over whole texts, with corpus-wide counts of the linked ids.

Inside a task the work is a pipeline over Arrow arrays: the id lists of a slice of documents are flattened with their
parent indices, the tokens' byte ends are segmented cumulative sums, an Acero hash join on (document, end) finds the
places where a token of either side ends, and the tokens between two such places are a group.  The last tokens of a
group are a link.  A slice is a *bundle*: its links are dictionary-encoded, ``Table.group_by`` gives their partial
counts (one row a bundle) and how often each occurs in each document.  Spark adds the partial counts up by id pair,
takes the highest count of each B id, and sends every bundle the figures of its own pairs; the document sums are taken
where bundle and figures meet.  What is exchanged is distinct pairs of bundles, never links, and no table of pairs is
broadcast.

Defined cases: texts that are null, empty or whose joined token bytes differ from space + text on either side have no
tokens (zeros, empty groups); rows that repeat an id, and rows with a null id, are rows of their own and all count; a
very long text is a bundle by itself; pairs of equal count are all best; an empty table gives an empty result; only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import map_text, stored, text_slices
from flowlens.llm.encoding import UnitEncoder, UnitPool, _direct

SPACE = "▁"
MEMO_UNITS = 400_000
_SCHEMA = pa.schema([("bundle", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                     ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
                     ("pairs", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("k", pa.list_(pa.int64()))])
_SCHEMA_SQL = ("bundle long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
               "pairs array<long>, place array<int>, k array<long>")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevelSide(UnitEncoder):
    """Ids and token bytes of space + text by a byte-level BPE file; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path, MEMO_UNITS)
        self.tok.encode_special_tokens = True
        alphabet, added = byte_alphabet(), self.tok.get_added_tokens_decoder()
        pieces = [b""] * self.tok.get_vocab_size()
        for piece, i in self.tok.get_vocab().items():
            pieces[i] = piece.encode() if i in added else bytes(alphabet[c] for c in piece)
        self.bytes = pa.array(pieces, pa.binary())

    def units(self, text: str) -> list[str]:
        return text.replace("\n", " \n").split(" ")

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide(UnitPool):
    """Ids and token bytes of a sentencepiece file, which puts the space before the text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = spec.normalizer_spec
        # units are words only where nothing reaches over a space that follows a word
        self.by_unit = (n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix
                        and not n.remove_extra_whitespaces and n.escape_whitespaces and spec.trainer_spec.model_type == 2
                        and not spec.trainer_spec.treat_whitespace_as_suffix
                        and not any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces if p.type in (1, 4)))
        self.bytes = pa.array([bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode()
                               for p in spec.pieces], pa.binary())
        super().__init__("<u2" if len(spec.pieces) <= 1 << 16 else "<u4", MEMO_UNITS)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.whole(units)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.dtype, int(sizes.sum())), sizes

    def units(self, text: str) -> list[str]:
        return text.split(" ")

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


def id_lists(side: ByteLevelSide | PieceSide, texts: list[str]) -> pa.ListArray:
    """Ids of space + text for each text; units met before are looked up, odd texts go to the library whole."""
    parts, whole = [], []
    for i, t in enumerate(texts):
        plain = side.by_unit and not _direct(t) and t[-1] != " "
        parts.append(side.units(t) if plain else [])
        if not plain and t:
            whole.append(i)
    at = side.numbers(chain.from_iterable(parts), sum(map(len, parts)))
    begin, size = side.start[at], side.start[at + 1] - side.start[at]
    ends = np.cumsum(size)
    ids = side.pool[np.arange(int(size.sum())) + np.repeat(begin - (ends - size), size)]
    doc_ends = np.concatenate([[0], ends])[np.cumsum([len(p) for p in parts])]
    if whole:
        direct = dict(zip(whole, side.whole([texts[i] for i in whole]), strict=True))
        starts = [0, *doc_ends[:-1].tolist()]
        lists = [np.asarray(direct[i], ids.dtype) if i in direct else ids[s:e]
                 for i, (s, e) in enumerate(zip(starts, doc_ends.tolist(), strict=True))]
        ids, doc_ends = np.concatenate(lists), np.cumsum([len(x) for x in lists])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], doc_ends]).astype(np.int32)), pa.array(ids, pa.int64()))


def _offsets(counts: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(counts, pa.int64()))])


class Tokens:
    """The flattened tokens of a slice: document, byte end inside it and id, for documents whose bytes agree."""

    def __init__(self, lists: pa.ListArray, pieces: pa.Array, size: pa.Array) -> None:
        self.id, self.doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
        total = _offsets(size.take(self.id))
        starts = total.take(pc.cast(lists.offsets, pa.int64()))
        self.bounds = starts.to_numpy()
        self.end = pc.subtract(total.slice(1), starts.take(self.doc))
        self.joined = memoryview(pieces.take(self.id).buffers()[2] or b"").cast("B")

    def text(self, doc: int) -> memoryview:
        return self.joined[self.bounds[doc]:self.bounds[doc + 1]]

    def keep(self, good: pa.Array) -> None:
        mask = good.take(self.doc)
        self.id, self.doc, self.end = (x.filter(mask) for x in (self.id, self.doc, self.end))

    def table(self, name: str) -> pa.Table:
        return pa.table({"doc": self.doc, "end": self.end, name: self.id, f"at_{name}": np.arange(len(self.id))})

    def per_doc(self, n: int) -> np.ndarray:
        return np.bincount(self.doc.to_numpy(), minlength=n)


def _joined_groups(tokens: Tokens, last: pa.Array) -> pa.Array:
    """Decimal ids of each group, joined by commas; ``last`` is the position of each group's last token."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.add(last, 1)])
    return pc.binary_join(pa.ListArray.from_arrays(pc.cast(offsets, pa.int32()), pc.cast(tokens.id, pa.string())), ",")


def align_slice(texts: list[str], side_a: ByteLevelSide, side_b: PieceSide) -> dict:
    """Counts a document, group texts, and the slice's links: their pair, document and number of tokens."""
    n, a, b = len(texts), None, None
    sides = [Tokens(id_lists(s, texts), s.bytes, s.size) for s in (side_a, side_b)]
    wanted = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    good = pa.array([bool(w) and all(s.text(i) == w for s in sides) for i, w in enumerate(wanted)], pa.bool_())
    for s in sides:
        s.keep(good)
    a, b = sides
    link = a.table("a").join(b.table("b"), keys=["doc", "end"], join_type="inner", use_threads=False).sort_by("at_a")
    link = link.combine_chunks()
    at_a, at_b, doc = (link.column(c).combine_chunks() for c in ("at_a", "at_b", "doc"))
    texts_of = pc.binary_join_element_wise(_joined_groups(a, at_a), _joined_groups(b, at_b), "|")
    n_links = np.bincount(doc.to_numpy(), minlength=n)
    offsets = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts_of), ";")
    pair = pc.bit_wise_or(pc.shift_left(link.column("a"), 32), link.column("b")).combine_chunks()
    return {"n_a": a.per_doc(n), "n_b": b.per_doc(n), "n_links": n_links, "groups": groups, "pair": pair, "doc": doc}


def _bundle_rows(bundle: int, ids: pa.Array, found: dict, digests: bool) -> Iterator[pa.RecordBatch]:
    n, coded = len(ids), found["pair"].dictionary_encode()
    links = pa.table({"doc": found["doc"], "place": coded.indices})
    partial = links.group_by("place", use_threads=False).aggregate([("place", "count")]).sort_by("place")
    per_doc = links.group_by(["doc", "place"], use_threads=False).aggregate([("place", "count")]).sort_by("doc")
    parts = np.bincount(per_doc.column("doc").to_numpy(), minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(parts)]).astype(np.int32))
    flat = [per_doc.column(c).combine_chunks() for c in ("place", "place_count")]
    groups = found["groups"]
    if digests:
        groups = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups.to_pylist()], pa.string())
    longs = [pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_links", "n_links")]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, bundle), pa.int64()), ids, *longs, groups, pa.nulls(n, pa.list_(pa.int64())),
         pa.ListArray.from_arrays(offsets, pc.cast(flat[0], pa.int32())),
         pa.ListArray.from_arrays(offsets, pc.cast(flat[1], pa.int64()))], schema=_SCHEMA)
    if len(coded):
        one = pa.array([0, len(coded.dictionary)], pa.int32())
        own = {"bundle": pa.array([bundle], pa.int64()), "pairs": pa.ListArray.from_arrays(one, coded.dictionary),
               "k": pa.ListArray.from_arrays(one, partial.column("place_count").combine_chunks())}
        yield pa.RecordBatch.from_arrays([own.get(c.name, pa.nulls(1, c.type)) for c in _SCHEMA], schema=_SCHEMA)


_SIDES: dict[tuple[str, str], tuple[ByteLevelSide, PieceSide]] = {}


def _sides(path_a: str, path_b: str) -> tuple[ByteLevelSide, PieceSide]:
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = sides = ByteLevelSide(path_a), PieceSide(path_b)
        for s in sides:
            s.size = pc.cast(pc.binary_length(s.bytes), pa.int64())
    return _SIDES[path_a, path_b]


def bundles(docs: DataFrame, path_a: str, path_b: str, digests: bool, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """A row for each document (``place`` and ``k``: its distinct pairs by their place in the bundle, and how often)
    and one for each bundle with links (``pairs`` and ``k``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = TaskContext.get().partitionId() << 33
        sides = _sides(path_a, path_b)
        for ids, texts in text_slices(batches):
            yield from _bundle_rows(bundle, ids, align_slice([t or "" for t in texts], *sides), digests)
            bundle += 1

    return map_text(docs, run, _SCHEMA_SQL, id_col, text_col)


def pair_counts(bundle_rows: DataFrame) -> DataFrame:
    """a_id, b_id, n (links corpus-wide), best (n is the highest of its B id) of every linked id pair."""
    n = stored(_partial(bundle_rows).groupBy("pair").agg(F.sum("k").alias("n")), "pairs")
    top = n.groupBy(_low("pair").alias("b_id")).agg(F.max("n").alias("top"))
    return (n.select(F.shiftrightunsigned("pair", 32).alias("a_id"), _low("pair").alias("b_id"), "n").join(top, "b_id")
            .select("a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best")))


def _low(pair: str):
    return F.col(pair).bitwiseAND(F.lit((1 << 32) - 1))


def _partial(bundle_rows: DataFrame) -> DataFrame:
    return (bundle_rows.where("pairs is not null")
            .select("bundle", F.posexplode(F.arrays_zip("pairs", "k")).alias("place", "x"))
            .select("bundle", "place", F.col("x.pairs").alias("pair"), F.col("x.k").alias("k")))


def align(docs: DataFrame, path_a: str, path_b: str, digests: bool = False, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2``; with ``digests`` their
    SHA-256 as groups_sha256) of every document."""
    rows = stored(bundles(docs, path_a, path_b, digests, id_col, text_col), "aligned")
    counts = pair_counts(rows).select(F.shiftleft("a_id", 32).bitwiseOR(F.col("b_id")).alias("pair"), "n", "best")
    figures = _partial(rows).join(counts, "pair").select(F.col("bundle").alias("of"), "place", "n", "best")
    name = "groups_sha256" if digests else "groups"
    out = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in
                                               ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                     (name, pa.string())])

    def total(own: pa.Table, known: pa.Table) -> pa.Table:
        known, own = known.sort_by("place"), own.combine_chunks()
        lists = [own.column(c).combine_chunks() for c in ("place", "k")]
        place, k = (pc.list_flatten(x) for x in lists)
        sums = [np.zeros(own.num_rows, np.int64)] * 2
        if len(place):
            doc = pc.list_parent_indices(lists[0])
            n, best = (known.column(c).combine_chunks().take(place) for c in ("n", "best"))
            per = pa.table({"doc": doc, "best": pc.multiply(k, pc.cast(best, pa.int64())), "n": pc.multiply(k, n)})
            per = per.group_by("doc", use_threads=False).aggregate([("best", "sum"), ("n", "sum")])
            sums = [np.zeros(own.num_rows, np.int64) for _ in range(2)]
            for s, c in zip(sums, ("best_sum", "n_sum"), strict=True):
                s[per.column("doc").to_numpy()] = per.column(c).to_numpy()
        return pa.Table.from_arrays([*(own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
                                     *(pa.array(s) for s in sums), own.column("groups")], schema=out)

    return (rows.where("pairs is null").drop("pairs").groupBy("bundle").cogroup(figures.groupBy("of"))
            .applyInArrow(total, ", ".join(f"{f.name} {'string' if f.name == name else 'long'}" for f in out)))


__all__ = ["align", "bundles", "pair_counts", "align_slice", "ByteLevelSide", "PieceSide"]
