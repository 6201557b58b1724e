"""Fill-in-the-middle transformation of whole texts, and back.

Where a text is cut and which form it takes follows from a hash of its id, in built-in expressions.  The texts are
rearranged in an Arrow pipeline: a batch's code points become the elements of list arrays (offsets into the text
bytes, nothing is copied), the lists are flattened with their parent indices, a unit's ordinal decides its role
(prefix, middle, suffix), each role's units are filtered and their lists rebuilt, and ``binary_join`` makes the
pieces, which are joined with the markers in the order of the form.  A text longer than ``WINDOW`` bytes passes
through in windows that know the ordinal of their first unit, so memory for units does not follow a text's length.

Forms: ``plain`` (the text as it is), ``psm`` (<P>prefix<S>suffix<M>middle), ``spm`` (<S>suffix<P>prefix<M>middle).
Since no rearranged text holds a marker, the first occurrence of each marker in an output is its own, and ``restored``
gives back the exact text.

Defined cases: null and empty texts are empty and plain, texts with a marker are plain; equal ids are cut alike; a null
id is hashed as the empty string; repeated rows give repeated results; an empty table an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20   # of 100: draws from PLAIN_FROM on stay plain, second draws below SPM_BELOW are spm
WINDOW = 1 << 19                 # bytes whose units are in memory at a time (plus at most three)
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                  ("middle_chars", pa.int64()), ("output", pa.string())])


def draws(id_col: Column, salt: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``salt:id``."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n, form, first and second cut (in code points)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    n = F.char_length("text").cast("long")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (n == 0) | marked | (h3 % 100 >= PLAIN_FROM)
    return rows.select("doc_id", "text", n.alias("n"), F.when(plain, "plain").when(h4 % 100 < SPM_BELOW, "spm")
                       .otherwise("psm").alias("form"), F.least(h1 % (n + 1), h2 % (n + 1)).alias("first"),
                       F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("second"))


def _units(texts: pa.Array) -> pa.ListArray:
    """The code points of each text as a list of one-character strings that share the texts' bytes."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data or b"", np.uint8)[:bounds[-1]]
    starts = np.flatnonzero((raw[bounds[0]:] & 0xC0) != 0x80).astype(np.int32) + bounds[0]
    units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, bounds[-1]).astype(np.int32)), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, bounds).astype(np.int32)), units)


def split_roles(texts: pa.Array, base: pa.Array, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text, whose first unit has the ordinal ``base``."""
    lists = _units(texts)
    unit, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begin = pc.cast(lists.offsets.slice(0, len(lists)), pa.int64())
    ordinal = pc.add(pc.subtract(pa.array(np.arange(len(unit))), begin.take(parent)), base.take(parent))
    before, until = pc.less(ordinal, first.take(parent)), pc.less(ordinal, second.take(parent))
    pieces = []
    for role in (before, pc.and_not(until, before), pc.invert(until)):
        counts = np.bincount(parent.filter(role).to_numpy(), minlength=len(lists))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        pieces.append(pc.binary_join(pa.ListArray.from_arrays(offsets, unit.filter(role)), ""))
    return pieces


def _long_roles(text: str, first: int, second: int) -> list[pa.Array]:
    """The same for one long text, a window at a time."""
    raw, at, base, parts = text.encode("utf-8", "surrogatepass"), 0, 0, [[], [], []]
    while at < len(raw):
        end = min(at + WINDOW, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        window = pa.array([raw[at:end]], pa.binary()).cast(pa.string())
        for found, piece in zip(parts, split_roles(window, *(pa.array([x]) for x in (base, first, second))), strict=True):
            found.append(piece)
        base += pc.utf8_length(window)[0].as_py()
        at = end
    return [pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), pa.concat_arrays(p)), "")
            for p in parts]


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most WINDOW bytes of text, a longer text by itself."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + WINDOW, side="right")))
        yield start, stop
        start = stop


def _rearranged(rows: pa.RecordBatch) -> pa.Array:
    """The outputs of the rows (text, form, first, second), none of them plain."""
    text, form, first, second = (rows.column(c) for c in ("text", "form", "first", "second"))
    if rows.num_rows == 1 and text.nbytes > WINDOW:
        roles = _long_roles(text[0].as_py(), first[0].as_py(), second[0].as_py())
    else:
        roles = split_roles(text, pa.array(np.zeros(rows.num_rows, np.int64)), first, second)
    p, m, s = roles
    psm = pc.binary_join_element_wise(PREFIX, p, SUFFIX, s, MIDDLE, m, "")
    return pc.if_else(pc.equal(form, "psm"), psm, pc.binary_join_element_wise(SUFFIX, s, PREFIX, p, MIDDLE, m, ""))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars (null if plain) and output of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, stop in _runs(size):
                b = whole.slice(start, stop - start)
                moved = pc.not_equal(b.column("form"), "plain")
                output = b.column("text")
                if pc.any(moved).as_py():
                    output = pc.replace_with_mask(output, moved, _rearranged(b.filter(moved)))
                none = pa.scalar(None, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("n"), b.column("form"), pc.if_else(moved, b.column("first"), none),
                     pc.if_else(moved, pc.subtract(b.column("second"), b.column("first")), none), output], schema=_OUT)

    return cuts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from: pieces between the markers, put back in order."""
    s, m = F.instr(output, SUFFIX), F.instr(output, MIDDLE)
    middle = F.substring(output, m + 3, F.char_length(output))
    psm = F.concat(F.substring(output, F.lit(4), s - 4), middle, F.substring(output, s + 3, m - s - 3))
    p = F.instr(output, PREFIX)
    spm = F.concat(F.substring(output, p + 3, m - p - 3), middle, F.substring(output, F.lit(4), p - 4))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(transformed: DataFrame) -> DataFrame:
    """The transformed rows with SHA-256 of output and restored text instead of the output."""
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                              F.sha2("output", 256).alias("output_sha256"),
                              F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle_sql(table: str = "documents") -> str:
    """DuckDB SQL of ``digest(transform(documents))``, from the definition."""
    return f"""
with d as (select cast(doc_id as bigint) as doc_id, coalesce(text, '') as t,
                  sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from {table}),
h as (select doc_id, t, cast(length(t) as bigint) as n,
             cast(('0x' || h[1:8]) as bigint) as h1, cast(('0x' || h[9:16]) as bigint) as h2,
             cast(('0x' || h[17:24]) as bigint) as h3, cast(('0x' || h[25:32]) as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when n = 0 or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}')
                       or h3 % 100 >= {PLAIN_FROM} then 'plain'
                  when h4 % 100 < {SPM_BELOW} then 'spm' else 'psm' end as form from h),
p as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars,
       case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
                        when 'spm' then '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid else t end)
           as output_sha256,
       sha256(t) as restored_sha256 from p"""


__all__ = ["transform", "restored", "digest", "cuts", "draws", "split_roles", "oracle_sql"]
