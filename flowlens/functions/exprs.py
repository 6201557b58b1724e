"""Scalar column expressions used across the operators.

Every helper returns a ``Column`` made of built-in functions, so it stays inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (ANOMALY_ELEVATED, ANOMALY_WEIGHT_ATTACK, ANOMALY_WEIGHT_NORMAL,
                       COMMON_PORTS, LOG_TS_FORMAT, NORMAL, PROTO_NAMES, PROTO_OTHER, US)

__all__ = [
    "col_or", "uncommon_port", "proto_name", "safe_rate",
    "ipv4_to_long", "in_subnet", "parse_log_ts", "event_base", "event_is_end", "is_attack",
    "binary_label", "anomaly_score", "anomaly_status", "format_bytes", "label_display",
    "time_of_day", "tod_from_seconds", "utc_format", "utc_timestamp", "fround", "fixed_text",
]


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uncommon_port(dst_port: str | Column = "dst_port") -> Column:
    """1 unless the destination port is a common service port (ICMP's port 0 is flagged)."""
    return (~col_or(dst_port).isin(*COMMON_PORTS)).cast("int")


def proto_name(proto: str | Column = "proto") -> Column:
    """Protocol number -> TCP / UDP / ICMP, else OTHER."""
    p = col_or(proto)
    expr = None
    for num, name in PROTO_NAMES.items():
        expr = F.when(p == num, F.lit(name)) if expr is None else expr.when(p == num, F.lit(name))
    return expr.otherwise(F.lit(PROTO_OTHER))


def safe_rate(x: str | Column, duration: str | Column) -> Column:
    """``x / duration`` if duration > 0 else 0.0 (ANSI division never sees a zero)."""
    d = col_or(duration)
    return F.when(d > 0, col_or(x).cast("double") / d).otherwise(F.lit(0.0))


def ipv4_to_long(ip: str | Column) -> Column:
    """Dotted IPv4 text -> BIGINT (NULL when not four octets 0..255)."""
    parts = F.split(col_or(ip), r"\.")
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("long") for i in range(1, 5)]
    ok = (F.size(parts) == 4)
    for o in octets:
        ok = ok & o.isNotNull() & (o >= 0) & (o <= 255)
    val = (octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3])
    return F.when(ok, val)


def in_subnet(ip: str | Column, cidr: str) -> Column:
    """Is ``ip`` inside the IPv4 ``cidr`` (e.g. ``192.168.50.0/24``)?"""
    net, bits = cidr.split("/")
    bits = int(bits)
    a, b, c, d = (int(x) for x in net.split("."))
    base = (a << 24) | (b << 16) | (c << 8) | d
    shift = 32 - bits
    return F.coalesce(F.shiftright(ipv4_to_long(ip), shift) == F.lit(base >> shift), F.lit(False))


def parse_log_ts(s: str | Column) -> Column:
    """Strict ``%Y-%m-%dT%H:%M:%SZ`` (UTC) -> TIMESTAMP, NULL when unparsable.

    The trailing ``Z`` is parsed as the zero offset, so the instant does not depend on
    the session time zone; other offsets are rejected like the reference's format."""
    c = col_or(s)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"),
                  F.try_to_timestamp(c, F.lit(LOG_TS_FORMAT)))


def event_base(event: str | Column) -> Column:
    """Name before the last underscore; the whole name when there is none."""
    return F.regexp_replace(col_or(event), r"_[^_]*$", "")


def event_is_end(event: str | Column) -> Column:
    return col_or(event).endswith("_END")


def is_attack(label: str | Column = "label") -> Column:
    """``label != 'NORMAL'`` where a NULL label counts as an attack."""
    return ~col_or(label).eqNullSafe(F.lit(NORMAL))


def binary_label(label: str | Column = "label") -> Column:
    return F.when(col_or(label).eqNullSafe(F.lit(NORMAL)), F.lit(0)).otherwise(F.lit(1))


def anomaly_score(entropy: str | Column = "dst_ip_entropy", label: str | Column | None = "label") -> Column:
    """Entropy weighted by 0.12 for attack rows and 0.02 otherwise (no label: all 0.02)."""
    e = col_or(entropy)
    if label is None:
        return e * F.lit(ANOMALY_WEIGHT_NORMAL)
    return F.when(is_attack(label), e * F.lit(ANOMALY_WEIGHT_ATTACK)).otherwise(e * F.lit(ANOMALY_WEIGHT_NORMAL))


def anomaly_status(score: str | Column) -> Column:
    return F.when(col_or(score) > F.lit(ANOMALY_ELEVATED), F.lit("ELEVATED")).otherwise(F.lit("NORMAL"))


def fround(c: Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` in plain IEEE steps."""
    s = float(10 ** digits)
    return F.floor(c * F.lit(s) + F.lit(0.5)).cast("double") / F.lit(s)


def fixed_text(x: str | Column, digits: int) -> Column:
    """A number with ``digits`` decimals as text, rounded half up."""
    return F.format_string(f"%.{digits}f", fround(col_or(x), digits))


def format_bytes(b: str | Column) -> Column:
    """``<1024 -> 'nB'``, ``<1 MiB -> 'nKB'`` (0 dp), else ``'n.nMB'`` (1 dp)."""
    x = col_or(b)
    return (F.when(x < 1024, F.concat(x.cast("long").cast("string"), F.lit("B")))
            .when(x < 1048576, F.concat(F.floor(x / F.lit(1024.0) + F.lit(0.5)).cast("long").cast("string"), F.lit("KB")))
            .otherwise(F.concat(fixed_text(x / F.lit(1048576.0), 1), F.lit("MB"))))


def label_display(label: str | Column = "label") -> Column:
    """First underscore -> space (``C2_BEACON`` -> ``C2 BEACON``)."""
    return F.regexp_replace(col_or(label), r"^([^_]*)_", "$1 ")


def tod_from_seconds(sec: str | Column) -> Column:
    """``HH:MM:SS`` (UTC) of epoch seconds, by arithmetic (no session time zone)."""
    s = F.pmod(col_or(sec).cast("long"), F.lit(86400))
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), (s % 60).cast("int"))


def time_of_day(ts: str | Column) -> Column:
    """``strftime('%H:%M:%S')`` of a timestamp, in UTC."""
    return tod_from_seconds(F.unix_seconds(col_or(ts)))


def utc_format(ts: str | Column, pattern: str) -> Column:
    """``date_format`` of an instant in UTC whatever the session time zone (formats the
    zone-less timestamp epoch + micros)."""
    us = F.unix_micros(col_or(ts))
    ntz = F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return F.date_format(ntz, pattern)


def utc_timestamp(text: str) -> Column:
    """A literal instant from ``YYYY-MM-DD HH:MM:SS`` text read as UTC."""
    from datetime import datetime, timezone
    dt = datetime.fromisoformat(text.replace("Z", "")).replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(int(dt.timestamp()) * 1_000_000 + dt.microsecond))
