import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import labels as LB
from flowlens.sources import adapter as AD

BASE = 1_704_067_200


def _intervals(spark, lines, chunk=1 << 16):
    log = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string")
    return LB.attack_intervals(log, chunk_lines=chunk)


def test_fixture_log_intervals_in_match_order(spark):
    iv = LB.attack_intervals(AD.attack_log_fixture(spark))
    got = [(r.name, r.start_us // 1_000_000 - BASE, r.end_us // 1_000_000 - BASE)
           for r in iv.orderBy("base_line", "start_line").collect()]
    assert got == [("RECON", 180, 240), ("BRUTEFORCE", 1200, 1320), ("C2_BEACON", 660, 840),
                   ("EXFIL_RANSOMWARE", 720, 900), ("EXFIL_RANSOMWARE", 750, 780)]


def _paired(events):
    """Push a START's time, pop it at an END: (name, start, end) by first line of the name, then line of the START.

    ``events``: (line, name, is_end, seconds) of the well-formed lines."""
    stacks, first, closed = {}, {}, []
    for line, name, is_end, at in events:
        first.setdefault(name, line)
        stack = stacks.setdefault(name, [])
        if not is_end:
            stack.append((line, at))
        elif stack:
            start_line, start = stack.pop()
            closed.append((first[name], start_line, name, start, at))
    return [(name, start, end) for _, _, name, start, end in sorted(closed)]


@pytest.mark.parametrize("seed,chunk", [(0, 1 << 16), (1, 5), (2, 3), (3, 1 << 16), (4, 2)])
def test_pairing_equals_stack(spark, seed, chunk):
    rnd = random.Random(seed)
    lines, events = [], []
    for i in range(80):
        name, kind = rnd.choice(["RECON", "C2_BEACON", "SCAN"]), rnd.choice(["START", "START", "END", "END", "STOP"])
        t = f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z"
        if rnd.random() < 0.7:
            lines.append(f"{t},{name}_{kind},a,b")
            events.append((i, name, kind == "END", BASE + i))
        else:  # not an event: blank, no time, too few fields
            lines.append(rnd.choice(["", "bad,RECON_START,a,b", f"{t},{name}_END,a"]))
    got = [(r.name, r.start_us // 1_000_000, r.end_us // 1_000_000)
           for r in _intervals(spark, lines, chunk).orderBy("base_line", "start_line").collect()]
    assert got == _paired(events)


def _flows(spark, spans):
    rows = [(0, i, float(BASE + a), float(BASE + b)) for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, "segment_id long, seq long, start_time double, end_time double")


@pytest.mark.parametrize("strategy", ["broadcast", "cover"])
def test_first_match_in_list_order(spark, strategy):
    iv = LB.attack_intervals(AD.attack_log_fixture(spark))
    fl = _flows(spark, [(730, 730), (870, 870), (240.0, 241), (2410, 2410), (100, 180), (1300, 1400)])
    got = {r.seq: r.label for r in LB.label_flows(fl, iv, strategy=strategy, bucket_s=60).collect()}
    assert got == {0: "C2_BEACON", 1: "EXFIL_RANSOMWARE", 2: "RECON", 3: "NORMAL", 4: "RECON", 5: "BRUTEFORCE"}


def test_strategies_agree_on_large_log(spark):
    iv = LB.attack_intervals(AD.read_attack_log(spark, "/root/testdata/sf0.001"))
    rnd = random.Random(7)
    spans = []
    for _ in range(300):
        a = rnd.uniform(0, 2600)
        spans.append((a, a + rnd.uniform(0, 30)))
    fl = _flows(spark, spans)
    a = {r.seq: r.label for r in LB.label_flows(fl, iv, strategy="broadcast").collect()}
    b = {r.seq: r.label for r in LB.label_flows(fl, iv, strategy="cover", bucket_s=17).collect()}
    assert a == b


def test_session_time_zone_does_not_change_labels(spark):
    iv = LB.attack_intervals(AD.attack_log_fixture(spark))
    fl = _flows(spark, [(730, 730), (870, 870), (239, 239.5)])
    before = {r.seq: r.label for r in LB.label_flows(fl, iv).collect()}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        iv2 = LB.attack_intervals(AD.attack_log_fixture(spark))
        after = {r.seq: r.label for r in LB.label_flows(fl, iv2).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before == after


def test_label_distribution_sf001(spark):
    from flowlens.plans import registry as R
    got = {r.label: r["count"] for r in LB.label_distribution(R.labeled_of(spark, "/root/testdata/sf0.01")).collect()}
    assert got == {"NORMAL": 3842, "C2_BEACON": 322, "BRUTEFORCE": 213, "RECON": 110, "EXFIL_RANSOMWARE": 105}
    assert F is not None


def test_chunked_pairing_equals_small_path_on_derived_log(spark):
    log = AD.read_attack_log(spark, "/root/testdata/sf0.001")
    cols = ["name", "start_us", "end_us", "base_line", "start_line"]
    small = LB.attack_intervals(log, closed_only=False, chunk_lines=0).select(*cols)
    chunked = LB.attack_intervals(log, closed_only=False, chunk_lines=97).select(*cols)
    assert small.count() > 100
    assert small.exceptAll(chunked).count() == 0 and chunked.exceptAll(small).count() == 0
