"""Capture files as a Spark data source (``format("pcap")``), batch and streaming.

``read_captures`` reads captures of any size in byte ranges.  In the data source itself, whose files are the segments
of a rotated capture, there is one input partition per capture file; each partition decodes its file with a fixed
IPv4 / TCP / UDP header decode (link types Ethernet with VLAN tags, Linux SLL and SLL2,
raw IP; classic pcap in both byte orders with µs or ns stamps, and pcapng) and yields
Arrow record batches of the ``packets`` schema.  ``segment_id`` is the number at the
end of the file name (``capture.pcap12`` -> 12).  Options:

* ``path``            folder or glob of capture files (``capture.pcap*`` by default)
* ``min_age_s``       only files whose last change is at least this old (settled)
* ``skip_bare``       skip the file still being written (name without a number), default true

The writer (``df.write.format("pcap")``) writes one file per ``segment_id`` with
synthetic Ethernet/IPv4/TCP|UDP|ICMP headers padded to ``len``; it exists so that tests
and the registered source query can produce captures from the driver tables.
"""

from __future__ import annotations

import fnmatch
import io
import os
import re
import struct
import time
import zlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter,
                                    InputPartition, WriterCommitMessage)

PACKET_DDL = ("segment_id bigint, pkt_idx bigint, t_us bigint, is_ip boolean, src_ip string, src_port int, "
              "dst_ip string, dst_port int, proto int, len int")

# --- fixed values of the file formats ---------------------------------------------------
LINK_ETHERNET, LINK_RAW, LINK_SLL, LINK_SLL2 = 1, 101, 113, 276
ETH_IPV4, ETH_VLAN, ETH_QINQ = 0x0800, 0x8100, 0x88A8
PCAP_MAGIC_US, PCAP_MAGIC_NS = 0xA1B2C3D4, 0xA1B23C4D
PCAPNG_SHB, PCAPNG_IDB, PCAPNG_EPB, PCAPNG_SPB = 0x0A0D0D0A, 1, 6, 3
# ----------------------------------------------------------------------------------------

_NUM = re.compile(r"(\d+)$")
_CAPTURE = re.compile(r"\.pcap(ng)?\d*$")


def segment_number(path: str) -> int | None:
    m = _NUM.search(os.path.basename(path))
    return int(m.group(1)) if m else None


def store_of(path: str):
    """(pyarrow file system, path inside it) of a plain path or a URI (``file:``, ``hdfs:``, ``s3:``, ``gs:``, ``abfs:``)."""
    from pyarrow import fs
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", path)))
    return fs.LocalFileSystem(), path


def _found(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """((path, last change, bytes) of the files that ``path`` names, whether it names a folder)."""
    from pyarrow import fs
    store, inner = store_of(path)
    head = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    globbed = any(ch in inner for ch in "*?[")
    folder = os.path.dirname(inner) if globbed else inner
    info = store.get_file_info(folder)
    if info.type == fs.FileType.NotFound:
        if globbed:
            return [], False
        raise FileNotFoundError(path)
    infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder))
    if globbed:
        infos = [i for i in infos if fnmatch.fnmatchcase(i.base_name, os.path.basename(inner))]
    files = [(head + i.path, (i.mtime_ns or 0) / 1e9, i.size) for i in infos if i.type == fs.FileType.File]
    return files, not globbed and info.type == fs.FileType.Directory


def list_captures(path: str, min_age_s: float = 0.0, skip_bare: bool = True,
                  now: float | None = None) -> list[tuple[str, int]]:
    """Settled capture files with their sizes, ordered by segment number, then path (F12); one listing of the folder.

    ``path`` is a file (read whatever its name), a glob, or a folder: there ``*.pcap``, ``*.pcapng`` and rotated
    ``*.pcap<N>`` count.  ``skip_bare`` leaves out the unnumbered ``capture.pcap`` of a folder that is still written.
    """
    now = time.time() if now is None else now
    found, folder = _found(path)
    out = []
    for f, changed, size in found:
        name = os.path.basename(f)
        if folder and (not _CAPTURE.search(name) or skip_bare and name == "capture.pcap"):
            continue
        if not min_age_s or now - changed >= min_age_s:
            out.append((f, size))
    return sorted(out, key=lambda x: (-1 if segment_number(x[0]) is None else segment_number(x[0]), x[0]))


def list_segments(path: str, min_age_s: float = 0.0, skip_bare: bool = True, now: float | None = None) -> list[str]:
    """The paths of ``list_captures``."""
    return [f for f, _ in list_captures(path, min_age_s, skip_bare, now)]


def segment_id(path: str) -> int:
    """N of ``capture.pcap<N>``, else a number of 62 bits from the whole path: it follows from the file's own name, so it
    is the same in every process and stays when other files come."""
    n = plain_number(path)
    if n is not None:
        return n
    store, inner = store_of(path)
    b = (inner if store.type_name != "local" else os.path.abspath(inner)).encode()
    return (1 << 61) | zlib.crc32(b) << 29 | zlib.crc32(b[::-1]) >> 3


def plain_number(path: str) -> int | None:
    """N where the name is exactly ``capture.pcap<N>`` (no leading zeros)."""
    name, n = os.path.basename(path), segment_number(path)
    return n if n is not None and name == f"capture.pcap{n}" else None


def segment_ids(files: list[str]) -> dict[str, int]:
    return {f: segment_id(f) for f in files}


def _ip(b: bytes) -> str:
    return f"{b[0]}.{b[1]}.{b[2]}.{b[3]}"


def decode_frame(frame: bytes, link: int):
    """-> (is_ip, src_ip, src_port, dst_ip, dst_port, proto); ports 0 unless TCP/UDP."""
    off = 0
    if link == LINK_ETHERNET:
        if len(frame) < 14:
            return (False, None, 0, None, 0, 0)
        etype = struct.unpack_from("!H", frame, 12)[0]
        off = 14
        while etype in (ETH_VLAN, ETH_QINQ) and len(frame) >= off + 4:
            etype = struct.unpack_from("!H", frame, off + 2)[0]
            off += 4
    elif link == LINK_SLL:
        if len(frame) < 16:
            return (False, None, 0, None, 0, 0)
        etype = struct.unpack_from("!H", frame, 14)[0]
        off = 16
    elif link == LINK_SLL2:
        if len(frame) < 20:
            return (False, None, 0, None, 0, 0)
        etype = struct.unpack_from("!H", frame, 0)[0]
        off = 20
    elif link == LINK_RAW:
        etype = ETH_IPV4 if frame and (frame[0] >> 4) == 4 else 0
    else:
        return (False, None, 0, None, 0, 0)
    if etype != ETH_IPV4 or len(frame) < off + 20 or (frame[off] >> 4) != 4:
        return (False, None, 0, None, 0, 0)
    ihl = (frame[off] & 0x0F) * 4
    proto = frame[off + 9]
    src, dst = _ip(frame[off + 12:off + 16]), _ip(frame[off + 16:off + 20])
    frag_off = struct.unpack_from("!H", frame, off + 6)[0] & 0x1FFF
    l4 = off + ihl
    sport = dport = 0
    if proto in (6, 17) and frag_off == 0 and len(frame) >= l4 + 4:
        sport, dport = struct.unpack_from("!HH", frame, l4)
    return (True, src, sport, dst, dport, proto)


def iter_packets(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """Yield (t_us, frame, link) from classic pcap or pcapng bytes."""
    if len(data) < 4:
        return
    magic_le = struct.unpack_from("<I", data, 0)[0]
    if magic_le == PCAPNG_SHB:
        yield from _iter_pcapng(io.BytesIO(data))
        return
    for endian in ("<", ">"):
        magic = struct.unpack_from(endian + "I", data, 0)[0]
        if magic in (PCAP_MAGIC_US, PCAP_MAGIC_NS):
            break
    else:
        raise ValueError("not a pcap file")
    ns = magic == PCAP_MAGIC_NS
    link = struct.unpack_from(endian + "I", data, 20)[0] & 0x0FFFFFFF
    pos = 24
    rec = struct.Struct(endian + "IIII")
    while pos + 16 <= len(data):
        sec, frac, incl, _orig = rec.unpack_from(data, pos)
        pos += 16
        frame = data[pos:pos + incl]
        pos += incl
        t_us = sec * 1_000_000 + (frac // 1000 if ns else frac)
        yield t_us, frame, link


def _iter_pcapng(fh):
    """Packets of a pcapng file object, read block by block."""
    endian = "<"
    links: list[tuple[int, int]] = []   # (link type, ticks per second)
    while len(head := fh.read(12)) == 12:
        btype = struct.unpack_from(endian + "I", head, 0)[0]
        if btype == PCAPNG_SHB:
            bom = struct.unpack_from("<I", head, 8)[0]
            endian = "<" if bom == 0x1A2B3C4D else ">"
            links = []
        blen = struct.unpack_from(endian + "I", head, 4)[0]
        rest = fh.read(blen - 12) if blen >= 12 else b""
        if blen < 12 or len(rest) < blen - 12:
            break
        body = (head[8:] + rest)[:blen - 12]
        if btype == PCAPNG_IDB:
            link = struct.unpack_from(endian + "H", body, 0)[0]
            res = 1_000_000
            opos = 8
            while opos + 4 <= len(body):
                code, olen = struct.unpack_from(endian + "HH", body, opos)
                if code == 0:
                    break
                if code == 9 and olen >= 1:      # if_tsresol
                    v = body[opos + 4]
                    res = 2 ** (v & 0x7F) if v & 0x80 else 10 ** v
                opos += 4 + ((olen + 3) & ~3)
            links.append((link, res))
        elif btype == PCAPNG_EPB:
            iface, hi, lo, cap, _orig = struct.unpack_from(endian + "IIIII", body, 0)
            link, res = links[iface] if iface < len(links) else (LINK_ETHERNET, 1_000_000)
            ticks = (hi << 32) | lo
            yield ticks * 1_000_000 // res, body[20:20 + cap], link
        elif btype == PCAPNG_SPB:
            link, _ = links[0] if links else (LINK_ETHERNET, 1_000_000)
            _orig = struct.unpack_from(endian + "I", body, 0)[0]
            yield 0, body[4:4 + min(_orig, len(body) - 4)], link


#: Bytes of a capture read at a time, and the largest frame that resynchronisation expects.
READ_BYTES = 8 << 20
MAX_FRAME = 1 << 18
#: Buffer of a capture being written, and the most tasks that captures of up to MAX_TASKS * 64 MB are read in.
WRITE_BYTES = 1 << 20
MAX_TASKS = 1000


class ClassicHeader(NamedTuple):
    """Byte order, whether stamps are in ns, link type, and the second of the first record (None: no record)."""
    endian: str
    ns: bool
    link: int
    first_s: int | None


def classic_header(fh) -> ClassicHeader | None:
    """Header of a classic pcap whose link type the decoder knows, else None."""
    fh.seek(0)
    data = fh.read(40)
    for endian in ("<", ">"):
        if len(data) >= 24 and struct.unpack_from(endian + "I", data, 0)[0] in (PCAP_MAGIC_US, PCAP_MAGIC_NS):
            break
    else:
        return None
    ns = struct.unpack_from(endian + "I", data, 0)[0] == PCAP_MAGIC_NS
    link = struct.unpack_from(endian + "I", data, 20)[0] & 0x0FFFFFFF
    first = struct.unpack_from(endian + "I", data, 24)[0] if len(data) == 40 else None
    return ClassicHeader(endian, ns, link, first) if link in (LINK_ETHERNET, LINK_SLL, LINK_SLL2, LINK_RAW) else None


def walk(fh, size: int, endian: str, at: int, end: int, read_bytes: int | None = None):
    """Records that begin in [at, end), a buffer at a time: (offset of the buffer, bytes, record offsets inside it, offset
    after its last record).  The only per-record Python is this walk over the length fields."""
    length = struct.Struct(endian + "I").unpack_from
    want = read_bytes or min(READ_BYTES, end - at + MAX_FRAME + 16)  # no more than a range and its last record
    while at < end and at + 16 <= size:
        fh.seek(at)
        data = fh.read(min(want, size - at))
        records, pos, n, last = [], 0, len(data), at + len(data) >= size
        while pos + 16 <= n and at + pos < end:
            after = pos + 16 + length(data, pos + 8)[0]
            if after > n and not last:
                break
            records.append(pos)
            pos = after
        if not records:  # a record longer than the buffer
            want *= 2
            continue
        yield at, data, records, at + pos
        at += pos


def first_record(fh, size: int, head: ClassicHeader, start: int) -> int:
    """First place from ``start`` on where a chain of plausible record headers begins that is longer than any frame, or
    reaches the end of the file; ``size`` if there is none.  A chain that starts inside a frame would have to go on
    outside of it; that it does not is checked against where the range before ends (``read_captures``)."""
    import numpy as np
    fh.seek(start)
    data = fh.read(min(4 * MAX_FRAME, size - start))
    n = len(data) - 15
    if n <= 0:
        return size
    buf = np.frombuffer(data, np.uint8).astype(np.uint32)
    order = (0, 1, 2, 3) if head.endian == "<" else (3, 2, 1, 0)

    def u32(off: int) -> np.ndarray:
        return sum(buf[off + i:off + i + n] << np.uint32(8 * order[i]) for i in range(4))

    sec, frac, incl, orig = (u32(o) for o in (0, 4, 8, 12))
    fine = ((frac < (10 ** 9 if head.ns else 10 ** 6)) & (incl <= MAX_FRAME) & (orig >= incl)
            & (np.abs(sec.astype(np.int64) - (head.first_s or 0)) < 400 * 86400))
    for p in np.flatnonzero(fine[:MAX_FRAME + 17]).tolist():
        pos = p
        while pos < n and fine[pos] and pos <= p + MAX_FRAME + 16:
            pos += 16 + int(incl[pos])
        if pos > p + MAX_FRAME + 16 or start + pos >= size - 15 and (pos >= n):
            return start + p
    return size


def _decode_records(buf, records, first_idx: int, head: ClassicHeader, segment_id: int):
    """numpy decode of classic pcap records (Ethernet incl. VLAN, SLL, SLL2, raw IPv4) at the given offsets."""
    import numpy as np
    import pyarrow as pa
    buf, hdr, link = np.frombuffer(buf, np.uint8), np.asarray(records, np.int64), head.link
    n = len(hdr)
    sec = buf[(hdr[:, None] + np.arange(16)[None, :]).ravel()].copy().view(np.dtype(head.endian + "u4")).reshape(-1, 4)
    t_us = sec[:, 0].astype(np.int64) * 1_000_000 + (sec[:, 1].astype(np.int64) // (1000 if head.ns else 1))
    # a capture cut off in its last record keeps what there is of it
    start, length = hdr + 16, np.minimum(sec[:, 2].astype(np.int64), len(buf) - hdr - 16)
    end = start + length
    pad = np.concatenate([buf, np.zeros(64, dtype=np.uint8)])   # gathers past a short frame read zeros

    def u8(off):
        return pad[np.minimum(off, len(buf) + 63)].astype(np.int64)

    def u16(off):
        return (u8(off) << 8) | u8(off + 1)

    if link == LINK_ETHERNET:
        etype, l3 = u16(start + 12), start + 14
        for _ in range(2):                                   # VLAN / QinQ tags
            tagged = (etype == ETH_VLAN) | (etype == ETH_QINQ)
            etype = np.where(tagged, u16(l3 + 2), etype)
            l3 = np.where(tagged, l3 + 4, l3)
        ok = length >= 14
    elif link == LINK_SLL:
        etype, l3, ok = u16(start + 14), start + 16, length >= 16
    elif link == LINK_SLL2:
        etype, l3, ok = u16(start), start + 20, length >= 20
    else:
        etype, l3, ok = np.full(n, ETH_IPV4), start, length >= 1
    is_ip = ok & (etype == ETH_IPV4) & (end >= l3 + 20) & ((u8(l3) >> 4) == 4)
    ihl = (u8(l3) & 0x0F) * 4
    proto = np.where(is_ip, u8(l3 + 9), 0)
    src = (u8(l3 + 12) << 24) | (u8(l3 + 13) << 16) | (u8(l3 + 14) << 8) | u8(l3 + 15)
    dst = (u8(l3 + 16) << 24) | (u8(l3 + 17) << 16) | (u8(l3 + 18) << 8) | u8(l3 + 19)
    frag = u16(l3 + 6) & 0x1FFF
    l4 = l3 + ihl
    has_ports = is_ip & ((proto == 6) | (proto == 17)) & (frag == 0) & (end >= l4 + 4)
    sport = np.where(has_ports, u16(l4), 0)
    dport = np.where(has_ports, u16(l4 + 2), 0)

    def ip_text(v):
        uniq, inv = np.unique(v, return_inverse=True)
        names = pa.array([f"{(x >> 24) & 255}.{(x >> 16) & 255}.{(x >> 8) & 255}.{x & 255}" for x in uniq.tolist()])
        out = pa.DictionaryArray.from_arrays(pa.array(inv.astype(np.int32)), names).cast(pa.string())
        return pa.compute.if_else(pa.array(is_ip), out, pa.scalar(None, pa.string()))

    import pyarrow.compute  # noqa: F401
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, segment_id, dtype=np.int64)), pa.array(first_idx + np.arange(n, dtype=np.int64)),
         pa.array(t_us), pa.array(is_ip), ip_text(src), pa.array(sport.astype(np.int32)), ip_text(dst),
         pa.array(dport.astype(np.int32)), pa.array(proto.astype(np.int32)), pa.array(length.astype(np.int32))],
        names=["segment_id", "pkt_idx", "t_us", "is_ip", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "len"])


def decode_range(path: str, segment_id: int, at: int, end: int, first_idx: int = 0):
    """Arrow record batches of the records of a classic capture that begin in [at, end), ``at`` being a record's start."""
    store, inner = store_of(path)
    with store.open_input_file(inner) as fh:
        head, size = classic_header(fh), fh.size()
        for _, data, records, _ in walk(fh, size, head.endian, at, end):
            yield _decode_records(data, records, first_idx, head, segment_id)
            first_idx += len(records)


def decode_file(path: str, segment_id: int):
    """Arrow record batches of one capture file (pkt_idx = position in the file), read a buffer at a time.

    Classic pcap with a known link type is decoded with numpy gathers; pcapng and other
    link types go through the per-frame decoder."""
    import pyarrow as pa
    store, inner = store_of(path)
    with store.open_input_file(inner) as fh:
        head, size = classic_header(fh), fh.size()
    if head is not None:
        yield from decode_range(path, segment_id, 24, size)
        return
    cols = {k: [] for k in ("segment_id", "pkt_idx", "t_us", "is_ip", "src_ip", "src_port", "dst_ip", "dst_port",
                            "proto", "len")}
    types = {"segment_id": pa.int64(), "pkt_idx": pa.int64(), "t_us": pa.int64(), "is_ip": pa.bool_(),
             "src_ip": pa.string(), "src_port": pa.int32(), "dst_ip": pa.string(), "dst_port": pa.int32(),
             "proto": pa.int32(), "len": pa.int32()}
    batch_rows = 65536

    def flush():
        b = pa.RecordBatch.from_arrays([pa.array(cols[k], type=types[k]) for k in cols], names=list(cols))
        for v in cols.values():
            v.clear()
        return b

    with store.open_input_stream(inner, buffer_size=1 << 20) as fh:
        magic = fh.read(4)
        fh = _Again(magic, fh)
        frames = _iter_pcapng(fh) if magic == struct.pack("<I", PCAPNG_SHB) else iter_packets(fh.read(-1))
        for i, (t_us, frame, link) in enumerate(frames):
            is_ip, src, sport, dst, dport, proto = decode_frame(frame, link)
            for k, v in zip(cols, (segment_id, i, t_us, is_ip, src, sport, dst, dport, proto, len(frame))):
                cols[k].append(v)
            if len(cols["pkt_idx"]) >= batch_rows:
                yield flush()
    if cols["pkt_idx"]:
        yield flush()


class _Again:
    """A stream with the bytes already read put back."""

    def __init__(self, head: bytes, fh) -> None:
        self.head, self.fh = head, fh

    def read(self, n: int) -> bytes:
        if n < 0:
            return self.head + self.fh.read()
        take, self.head = self.head[:n], self.head[n:]
        return take + self.fh.read(n - len(take))


class _FilePartition(InputPartition):
    def __init__(self, path: str, segment_id: int):
        super().__init__(path)
        self.path, self.segment_id = path, segment_id


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path") or options.get("paths")
        self.min_age = float(options.get("min_age_s", 0))
        self.skip_bare = str(options.get("skip_bare", "true")).lower() == "true"

    def partitions(self):
        ids = segment_ids(list_segments(self.path, self.min_age, self.skip_bare))
        return [_FilePartition(f, n) for f, n in ids.items()]

    def read(self, partition):
        yield from decode_file(partition.path, partition.segment_id)


def runs_of(numbers) -> list[list[int]]:
    """Sorted runs [first, last] of a set of numbers."""
    runs: list[list[int]] = []
    for n in sorted(numbers):
        if runs and n <= runs[-1][1] + 1:
            runs[-1][1] = max(n, runs[-1][1])
        else:
            runs.append([n, n])
    return runs


def runs_between(start: list[list[int]], end: list[list[int]]) -> list[list[int]]:
    """The runs of numbers that ``end`` has and ``start`` lacks."""
    out, known = [], [*start, [float("inf"), float("inf")]]
    k = 0
    for lo, hi in end:
        while known[k][1] < lo:
            k += 1
        i = k
        while lo <= hi:
            a, b = known[i]
            if a > lo:
                out.append([lo, min(hi, a - 1)])
            lo, i = max(lo, b + 1), i + 1
    return out


class PcapStreamReader(DataSourceStreamReader):
    """Offset = the files already taken, as a ledger: runs of numbers for ``capture.pcap<N>``, and other names.

    A file is taken once it is settled (``min_age_s``), in whatever order files settle: one with a lower number than
    those taken before is still new.  A batch is what the end offset has and the start offset lacks; its files follow
    from the offsets, so the folder is listed once a batch, and the offset grows with the gaps, not with the files."""

    def __init__(self, options: dict):
        self.path = options.get("path")
        self.min_age = float(options.get("min_age_s", 5))

    def initialOffset(self):
        return {"runs": [], "names": []}

    def latestOffset(self):
        files = list_segments(self.path, self.min_age, True)
        plain = [plain_number(f) for f in files]
        return {"runs": runs_of(n for n in plain if n is not None),
                "names": sorted(os.path.basename(f) for f, n in zip(files, plain, strict=True) if n is None)}

    def partitions(self, start, end):
        new = [f"capture.pcap{n}" for lo, hi in runs_between(start["runs"], end["runs"]) for n in range(lo, hi + 1)]
        names = new + [f for f in end["names"] if f not in set(start["names"])]
        folder = os.path.dirname(self.path) if any(ch in self.path for ch in "*?[") else self.path.rstrip("/")
        folder += "/"
        return [_FilePartition(folder + f, segment_id(folder + f)) for f in names]

    def read(self, partition):
        yield from decode_file(partition.path, partition.segment_id)

    def commit(self, end):
        pass


def _frame(src: str, sport: int, dst: str, dport: int, proto: int, length: int, is_ip: bool) -> bytes:
    eth = b"\x00\x11\x22\x33\x44\x55" + b"\x66\x77\x88\x99\xaa\xbb"
    if not is_ip:
        body = eth + struct.pack("!H", 0x0806)
        return body + b"\x00" * max(0, length - len(body))
    if proto == 6:
        l4 = struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 0x50, 0x18, 1024, 0, 0)
    elif proto == 17:
        l4 = struct.pack("!HHHH", sport, dport, 8, 0)
    else:
        l4 = struct.pack("!BBHI", 8, 0, 0, 0)
    total = max(20 + len(l4), length - 14)
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, total, 0, 0, 64, proto, 0,
                     bytes(int(x) for x in src.split(".")), bytes(int(x) for x in dst.split(".")))
    body = eth + struct.pack("!H", ETH_IPV4) + ip + l4
    return body + b"\x00" * max(0, length - len(body))


def file_header(link: int = LINK_ETHERNET) -> bytes:
    """Header of a classic little-endian µs pcap."""
    return struct.pack("<IHHiIII", PCAP_MAGIC_US, 2, 4, 0, 0, 262144, link)


def record_bytes(t_us, is_ip, src, sport, dst, dport, proto, length) -> bytes:
    fr = _frame(src, sport or 0, dst, dport or 0, proto or 0, length, is_ip)
    return struct.pack("<IIII", t_us // 1_000_000, t_us % 1_000_000, len(fr), len(fr)) + fr


def record_size():
    """Bytes of a packet's record, as a column: what ``record_bytes`` writes for it."""
    from pyspark.sql import functions as F
    ip = F.lit(34) + F.when(F.col("proto") == 6, 20).otherwise(8)
    return F.lit(16) + F.greatest(F.when(F.col("is_ip"), ip).otherwise(14), "len").cast("long")


def pcap_bytes(rows, link: int = LINK_ETHERNET) -> bytes:
    """Classic little-endian µs pcap of rows (t_us, is_ip, src, sport, dst, dport, proto, len)."""
    return b"".join([file_header(link), *(record_bytes(*r) for r in rows)])


class _Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class PcapWriter(DataSourceWriter):
    """One file per segment_id in ``path`` (rows must arrive sorted by segment, pkt_idx)."""

    def __init__(self, options: dict):
        from ..session import local_path
        self.path = local_path(options.get("path"))   # a POSIX path (local or a shared mount)

    def write(self, iterator):
        """A segment's records go to its file as its rows come, so memory does not follow the segment's size."""
        os.makedirs(self.path, exist_ok=True)
        files = []
        for segment, rows in groupby(iterator, key=lambda r: r.segment_id):
            if segment is None:
                continue
            name = os.path.join(self.path, f"capture.pcap{segment}")
            tmp = name + ".inprogress"
            with open(tmp, "wb", WRITE_BYTES) as fh:
                fh.write(file_header())
                for r in rows:
                    fh.write(record_bytes(r.t_us, r.is_ip, r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.proto, r.len))
            os.replace(tmp, name)   # atomic publish: a reader never sees half a segment
            files.append(name)
        return _Written(files)


class PcapDataSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return PACKET_DDL

    def reader(self, schema):
        return PcapReader(self.options)

    def streamReader(self, schema):
        return PcapStreamReader(self.options)

    def writer(self, schema, overwrite):
        return PcapWriter(self.options)


def register(spark) -> None:
    spark.dataSource.register(PcapDataSource)


def write_segments(packets, path: str) -> None:
    """Write a packets DataFrame as one capture file per segment (atomic renames)."""
    (packets.repartition("segment_id").sortWithinPartitions("segment_id", "pkt_idx")
     .write.format("pcap").mode("append").option("path", path).save())


def write_capture(packets, path: str, segment: int = 0) -> None:
    """Write a packets DataFrame, in the order of ``pkt_idx``, as the one capture file of ``segment``.

    The packets are sorted into ranges; the sizes of a range's records give where in the file it begins, and each range
    is written there by a task of its own, record by record.  The file gets its name when all ranges are written.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from ..session import local_path, stored_table
    folder = local_path(path)   # a POSIX path (local or a shared mount), as in PcapWriter
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, f"capture.pcap{segment}")
    tmp = name + ".inprogress"
    ranges = stored_table(packets.repartitionByRange("pkt_idx").select("*", F.spark_partition_id().alias("_range")),
                          "capture-ranges")
    starts, at = {}, 24
    for r in ranges.groupBy("_range").agg(F.sum(record_size()).alias("size")).orderBy("_range").collect():
        starts[r["_range"]] = (at, at + r["size"])
        at += r["size"]
    with open(tmp, "wb") as fh:
        fh.write(file_header())
        fh.truncate(at)

    fields = ["t_us", "is_ip", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "len"]

    def put(batches):
        rows = ((r["_range"], [r[c] for c in fields]) for b in batches for k in range(0, b.num_rows, 4096)
                for r in b.slice(k, 4096).to_pylist())
        for number, own in groupby(rows, key=lambda r: r[0]):
            n = 0
            with open(tmp, "r+b", WRITE_BYTES) as fh:
                fh.seek(starts[number][0])
                for _, row in own:
                    fh.write(record_bytes(*row))
                    n += 1
                if fh.tell() != starts[number][1]:
                    raise ValueError(f"{tmp}: range {number} ends at {fh.tell()}, not at {starts[number][1]}")
            yield pa.RecordBatch.from_pydict({"n": [n]})

    if starts:
        (ranges.repartition(len(starts), "_range").sortWithinPartitions("_range", "pkt_idx")
         .select("_range", *fields).mapInArrow(put, "n long").agg(F.sum("n")).collect())
    os.replace(tmp, name)   # atomic publish: a reader never sees half a capture


def _located(rows: Iterator, from_end: bool) -> Iterator:
    """Add to each byte range where its first record begins, where the first record after it begins, and its records."""
    import pyarrow as pa
    for batch in rows:
        out = batch.to_pylist()
        for r in out:
            store, inner = store_of(r["path"])
            with store.open_input_file(inner) as fh:
                head, at, n = classic_header(fh), r["sync"], 0
                if head is None:  # not split: the first range has the whole file
                    at = stop = r["size"]
                else:
                    if not from_end:
                        at = 24 if r["k"] == 0 else first_record(fh, r["size"], head, r["start"])
                    stop = at
                    for _, _, records, stop in walk(fh, r["size"], head.endian, at, r["stop_at"]):
                        n += len(records)
                r.update(sync=at, stop=min(stop, r["size"]), n=n, classic=head is not None)
        yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


_RANGE = ("path string, segment_id long, size long, k int, start long, stop_at long, sync long, stop long, n long, "
          "classic boolean")


def read_captures(spark, path: str, min_age_s: float = 0.0, split_bytes: int = 64 << 20):
    """Packets of capture files that may be large: classic captures are read in byte ranges of ``split_bytes``.

    A first pass finds, for every range, its first record by resynchronisation and walks the length fields to the first
    record of the next range.  Where a range's first record is not the one that the range before it ends at, it is
    walked again from there, until all agree; as the first range starts behind the file header, all are then right.
    The counts of the ranges give each its first ``pkt_idx``.  The second pass decodes the ranges.  Buffers have
    READ_BYTES, whatever the file's size; pcapng files are one range.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..session import cut_lineage
    rows = [(f, segment_id(f), size, k, at, min(at + split_bytes, size), 0, 0, 0, True)
            for f, size in list_captures(path, min_age_s)
            for k, at in enumerate(range(0, max(size, 1), split_bytes))]
    tasks = max(1, min(len(rows), max(MAX_TASKS, sum(r[5] - r[4] for r in rows) >> 26)))

    def located(ranges, from_end: bool):
        return cut_lineage(ranges.repartition(tasks).mapInArrow(lambda b: _located(b, from_end), _RANGE))

    found = located(spark.createDataFrame(rows, _RANGE), False)
    along = Window.partitionBy("path").orderBy("k")
    while True:
        seen = found.select("*", F.lag("stop").over(along).alias("expect"))
        wrong = seen.where("expect is not null and expect <> sync")
        if wrong.limit(1).count() == 0:
            break
        again = located(wrong.withColumn("sync", F.col("expect")).drop("expect"), True)
        found = cut_lineage(seen.where("expect is null or expect = sync").drop("expect").unionByName(again))
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = found.select("*", before.alias("first_idx")).where("n > 0 or (k = 0 and not classic)")

    def decode(batches):
        for b in batches:
            for r in b.to_pylist():
                if r["classic"]:
                    yield from decode_range(r["path"], r["segment_id"], r["sync"], r["stop_at"], r["first_idx"])
                else:
                    yield from decode_file(r["path"], r["segment_id"])

    return ranges.repartition(tasks, "path", "k").mapInArrow(decode, PACKET_DDL)


def read_pcap(spark, path: str, min_age_s: float = 0.0):
    register(spark)
    return spark.read.format("pcap").option("path", path).option("min_age_s", str(min_age_s)).load()
