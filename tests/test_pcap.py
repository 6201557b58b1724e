import io
import os
import random
import struct
import time

from pyspark.sql import functions as F

from flowlens.sources import pcap as PC

ROWS = [(1_704_067_200_000_000, True, "10.0.0.1", 40000, "10.0.1.1", 80, 6, 100),
        (1_704_067_201_500_000, True, "10.0.0.2", 5353, "10.0.1.2", 53, 17, 90),
        (1_704_067_202_000_000, True, "10.0.0.3", 0, "10.0.1.3", 0, 1, 74),
        (1_704_067_203_000_000, False, None, 0, None, 0, 0, 60)]


def _check(rows):
    assert [(r.is_ip, r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.proto) for r in rows] == \
        [(True, "10.0.0.1", 40000, "10.0.1.1", 80, 6), (True, "10.0.0.2", 5353, "10.0.1.2", 53, 17),
         (True, "10.0.0.3", 0, "10.0.1.3", 0, 1), (False, None, 0, None, 0, 0)]
    assert [r.t_us for r in rows] == [r[0] for r in ROWS]


def _sll(frame: bytes) -> bytes:
    # Linux cooked v1: 16-byte header, protocol at offset 14
    return b"\x00\x00\x00\x01\x00\x06" + b"\x00" * 8 + frame[12:14] + frame[14:]


def _sll2(frame: bytes) -> bytes:
    return frame[12:14] + b"\x00" * 18 + frame[14:]


def _write(path, data):
    with open(path, "wb") as fh:
        fh.write(data)


def test_link_types_and_formats(spark, tmp):
    eth = PC.pcap_bytes(ROWS)
    _write(os.path.join(tmp, "capture.pcap1"), eth)
    frames = list(PC.iter_packets(eth))
    sll = [struct.pack("<IHHiIII", PC.PCAP_MAGIC_US, 2, 4, 0, 0, 65535, PC.LINK_SLL)]
    sll2 = [struct.pack(">IHHiIII", PC.PCAP_MAGIC_NS, 2, 4, 0, 0, 65535, PC.LINK_SLL2)]
    for t, fr, _ in frames:
        a = _sll(fr)
        sll.append(struct.pack("<IIII", t // 10**6, t % 10**6, len(a), len(a)) + a)
        b = _sll2(fr)
        sll2.append(struct.pack(">IIII", t // 10**6, (t % 10**6) * 1000, len(b), len(b)) + b)
    _write(os.path.join(tmp, "capture.pcap2"), b"".join(sll))
    _write(os.path.join(tmp, "capture.pcap3"), b"".join(sll2))
    # pcapng: SHB, IDB (ethernet, µs), EPBs
    ng = [struct.pack("<IIIHHq", PC.PCAPNG_SHB, 28, 0x1A2B3C4D, 1, 0, -1) + struct.pack("<I", 28)]
    ng.append(struct.pack("<IIHHI", PC.PCAPNG_IDB, 20, PC.LINK_ETHERNET, 0, 65535) + struct.pack("<I", 20))
    for t, fr, _ in frames:
        pad = (4 - len(fr) % 4) % 4
        blen = 32 + len(fr) + pad
        ng.append(struct.pack("<IIIIIII", PC.PCAPNG_EPB, blen, 0, t >> 32, t & 0xFFFFFFFF, len(fr), len(fr))
                  + fr + b"\x00" * pad + struct.pack("<I", blen))
    _write(os.path.join(tmp, "capture.pcap4"), b"".join(ng))
    _write(os.path.join(tmp, "capture.pcap"), eth)   # still being written: skipped
    df = PC.read_pcap(spark, tmp)
    assert df.rdd.getNumPartitions() == 4
    for seg in (1, 2, 3, 4):
        _check(df.where(f"segment_id = {seg}").orderBy("pkt_idx").collect())


def test_settled_files_only(tmp):
    for n in (1, 2):
        _write(os.path.join(tmp, f"capture.pcap{n}"), PC.pcap_bytes(ROWS[:1]))
    old = os.path.join(tmp, "capture.pcap1")
    os.utime(old, (1, 1))
    assert [os.path.basename(f) for f in PC.list_segments(tmp, min_age_s=60)] == ["capture.pcap1"]
    assert len(PC.list_segments(tmp)) == 2


def test_vectorized_decode_equals_frame_decoder(tmp):
    frames = list(PC.iter_packets(PC.pcap_bytes(ROWS)))
    vlan = frames[0][1][:12] + b"\x81\x00\x00\x07" + frames[0][1][12:]          # one VLAN tag
    short = frames[1][1][:30]                                                    # truncated IPv4
    frag = bytearray(frames[0][1]); frag[20] = 0x00; frag[21] = 0x10             # non-first fragment
    extra = [(5_000_000, vlan), (6_000_000, short), (7_000_000, bytes(frag))]
    out = [struct.pack("<IHHiIII", PC.PCAP_MAGIC_US, 2, 4, 0, 0, 65535, PC.LINK_ETHERNET)]
    for t, fr in [(t, f) for t, f, _ in frames] + extra:
        out.append(struct.pack("<IIII", t // 10**6, t % 10**6, len(fr), len(fr)) + fr)
    data = b"".join(out)
    path = os.path.join(tmp, "x.pcap")
    _write(path, data)
    fast = [r for b in PC.decode_file(path, 9) for r in b.to_pylist()]
    pieces = [r for _ in [0] for _, buf, at, _ in PC.walk(io.BytesIO(data), len(data), "<", 24, len(data), 90)
              for r in PC._decode_records(buf, at, 0, PC.classic_header(io.BytesIO(data)), 9).to_pylist()]
    assert [{k: v for k, v in r.items() if k != "pkt_idx"} for r in pieces] == [
        {k: v for k, v in r.items() if k != "pkt_idx"} for r in fast]  # buffers smaller than a record
    slow = [dict(zip(("is_ip", "src_ip", "src_port", "dst_ip", "dst_port", "proto"), PC.decode_frame(fr, link)),
                 t_us=t, len=len(fr)) for t, fr, link in PC.iter_packets(data)]
    assert len(fast) == len(slow) == 7
    for a, b in zip(fast, slow):
        assert {k: a[k] for k in b} == b


def _capture(n, seed=0, embed=True):
    """A capture whose frames may themselves hold captures: payloads with plausible record headers."""
    rng, out, t = random.Random(seed), [struct.pack("<IHHiIII", PC.PCAP_MAGIC_US, 2, 4, 0, 0, 262144, PC.LINK_ETHERNET)], 1_704_067_200
    for i in range(n):
        t += rng.random() < 0.05
        fr = PC._frame("10.0.0.1", 1000 + i % 50, f"10.0.1.{i % 7}", 80, 6, 60 + rng.randrange(300), True)
        if embed and i % 9 == 0:
            inner = PC._frame("9.9.9.9", 1, "9.9.9.8", 2, 6, 60, True)
            fr += b"".join(struct.pack("<IIII", t, j, len(inner), len(inner)) + inner for j in range(rng.randrange(60)))
        out.append(struct.pack("<IIII", t, i % 10**6, len(fr), len(fr)) + fr)
    return b"".join(out)


def test_one_capture_in_byte_ranges(spark, tmp):
    data = _capture(3000)
    _write(os.path.join(tmp, "capture.pcap7"), data)
    _write(os.path.join(tmp, "capture.pcap8"), _capture(40, 1)[:-30])    # cut off in its last record
    _write(os.path.join(tmp, "capture.pcap9"), _capture(0))
    whole = sorted(map(tuple, PC.read_pcap(spark, tmp).collect()))
    for size in (20_000, 7_001, 1 << 20):
        df = PC.read_captures(spark, "file://" + tmp, split_bytes=size)
        assert sorted(map(tuple, df.collect())) == whole
        if size == 20_000:
            tasks = df.groupBy(F.spark_partition_id()).count().count()
            assert tasks > len(data) // size // 3
    assert len(whole) == 3040 and [r[1] for r in whole if r[0] == 7] == list(range(3000))


def test_resynchronisation_meets_record_starts(tmp):
    data = _capture(400, 3)
    head, size = PC.classic_header(io.BytesIO(data)), len(data)
    starts = [at + r for at, _, rec, _ in PC.walk(io.BytesIO(data), size, "<", 24, size) for r in rec]
    plain = _capture(400, 3, embed=False)
    plain_starts = [at + r for at, _, rec, _ in PC.walk(io.BytesIO(plain), len(plain), "<", 24, len(plain)) for r in rec]
    for p in range(24, len(plain), 977):
        want = next((s for s in plain_starts if s >= p), len(plain))
        assert PC.first_record(io.BytesIO(plain), len(plain), PC.classic_header(io.BytesIO(plain)), p) == want
    assert starts[0] == 24 and head.first_s == 1_704_067_200


def test_ledger_runs_and_a_hundred_thousand_files():
    assert PC.runs_of([5, 1, 2, 3, 9, 8]) == [[1, 3], [5, 5], [8, 9]]
    rng = random.Random(2)
    for _ in range(200):
        a = {rng.randrange(40) for _ in range(rng.randrange(30))}
        b = a | {rng.randrange(40) for _ in range(rng.randrange(30))}
        new = {n for lo, hi in PC.runs_between(PC.runs_of(a), PC.runs_of(b)) for n in range(lo, hi + 1)}
        assert new == b - a
    names = [f"/x/capture.pcap{56_000_000 + i}" for i in range(100_000) if i != 777]
    t = time.perf_counter()
    ids = PC.segment_ids(names)
    runs = PC.runs_of(ids.values())
    assert len(runs) == 2 and time.perf_counter() - t < 5


def test_ids_follow_from_the_name_alone(tmp):
    first = PC.segment_id(os.path.join(tmp, "other.pcap3"))
    assert PC.segment_id(os.path.join(tmp, "capture.pcap3")) == 3 and first > 1 << 60
    assert PC.segment_ids([os.path.join(tmp, "other.pcap3"), os.path.join(tmp, "capture.pcap3")])[os.path.join(tmp, "other.pcap3")] == first
    assert PC.segment_id("file://" + tmp + "/other.pcap3") == first


def test_writer_does_not_hold_a_segment(tmp):
    import tracemalloc
    from collections import namedtuple
    row = namedtuple("row", "segment_id t_us is_ip src_ip src_port dst_ip dst_port proto len")
    made = (row(None if i < 3 else 5, i, True, "10.0.0.1", 1, f"10.0.1.{i % 7}", 2, 17, 200) for i in range(30_000))
    tracemalloc.start()
    files = PC.PcapWriter({"path": tmp}).write(made).files
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [os.path.basename(f) for f in files] == ["capture.pcap5"] and peak < 3 << 20
    assert os.path.getsize(files[0]) == 24 + 29_997 * 216


def test_one_capture_is_written_by_many_tasks(spark, tmp, monkeypatch):
    rng = random.Random(4)
    rows = [(9, i, 1_704_067_200_000_000 + i, None if i == 7 else rng.random() < 0.9, "10.0.0.1", i % 60_000,
             "10.0.1.2", None if i == 8 else 80, None if i == 9 else rng.choice([1, 6, 17]), rng.randrange(20, 400))
            for i in range(4000)]
    want = PC.pcap_bytes([r[2:] for r in rows])
    rng.shuffle(rows)
    packets = spark.createDataFrame(rows, PC.PACKET_DDL)
    seen, put = [], type(packets).mapInArrow
    monkeypatch.setattr(type(packets), "mapInArrow", lambda df, *a: seen.append(df.rdd.getNumPartitions()) or put(df, *a))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        PC.write_capture(packets, "file://" + tmp, 3)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    with open(os.path.join(tmp, "capture.pcap3"), "rb") as fh:
        assert fh.read() == want
    assert os.listdir(tmp) == ["capture.pcap3"] and max(seen) > 1
    PC.write_capture(packets.limit(0), tmp, 4)
    with open(os.path.join(tmp, "capture.pcap4"), "rb") as fh:
        assert fh.read() == PC.pcap_bytes([])


def test_a_range_is_not_read_beyond_its_last_record():
    data = _capture(30_000, embed=False)
    read = []

    class File(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    list(PC.walk(File(data), len(data), "<", 24, 5000))
    assert sum(read) <= 5000 + PC.MAX_FRAME + 16 < len(data)
