"""Small helpers: sizes, checksums, hex, and option strings."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import InvalidArgument

MEMORY_OVERHEAD, LOG_OVERHEAD, APPEND_OVERHEAD = 32, 40, 32


def current_timestamp() -> int:
    return int(time.time())


def payload_bytes() -> Column:
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))


def entry_bytes(overhead: int = MEMORY_OVERHEAD) -> Column:
    """Accounted size of a log row: a tombstone has no value bytes."""
    return (payload_bytes() + overhead).cast("bigint")


def hex_key(column: str = "key") -> Column:
    return F.lower(F.hex(F.encode(F.col(column), "UTF-8")))


def unhex_key(column: str) -> Column:
    return F.decode(F.unhex(F.col(column)), "UTF-8")


def checksum(column: str) -> Column:
    return F.crc32(F.encode(F.col(column), "UTF-8"))


def common_prefix_length(a: str, b: str) -> Column:
    """Characters that two string columns share at their beginning."""
    return F.expr(f"coalesce(array_position(transform(sequence(1, least(length({a}), length({b})) + 1), i -> i > least(length({a}), length({b})) OR substr({a}, i, 1) <> substr({b}, i, 1)), true), 1) - 1")


_SIZE = re.compile(r"\s*([0-9]*\.?[0-9]+)\s*([a-z]*)\s*", re.IGNORECASE)


def parse_size(text: str) -> int:
    """Bytes of a size such as ``4MiB``, ``1.5 KiB``, ``1K`` or ``512``; every unit is a power of 1024."""
    m = _SIZE.fullmatch(text)
    unit = m[2].lower() if m else ""
    letter, rest = unit[:1], unit[1:]
    if not m or unit not in ("", "b") and (letter not in "kmgt" or rest not in ("", "b", "ib")):
        raise InvalidArgument(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** ("kmgt".index(letter) + 1 if unit not in ("", "b") else 0))


def parse_log_number(name: str) -> int | None:
    """The number in ``wal_00012.log``."""
    m = re.fullmatch(r"wal_(\d+)\.log", name)
    return int(m[1]) if m else None
