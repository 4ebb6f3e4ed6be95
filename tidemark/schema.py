"""Schemas, engine profiles and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _fields(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in columns])


_LONG, _TEXT = T.LongType(), T.StringType()

#: One mutation per row; a null value is a deletion, expire_at 0 never expires.
KV_LOG = _fields(("seq", _LONG, False), ("ts", _LONG, False), ("key", _TEXT, False), ("value", _TEXT, True), ("expire_at", _LONG, False))
KV_SNAPSHOT = _fields(("key", _TEXT, False), ("seq", _LONG, True), ("value", _TEXT, True), ("expire_at", _LONG, True))
#: max_expire_at is 0 if any entry has no time to live.
MANIFEST = _fields(
    ("filename", _TEXT, False), ("level", T.IntegerType(), False), ("min_key", _TEXT, True), ("max_key", _TEXT, True), ("size_bytes", _LONG, False),
    ("entry_count", _LONG, False), ("max_expire_at", _LONG, False), ("min_seq", _LONG, False), ("max_seq", _LONG, False),
)
#: A null expected value means that the key must not exist.
CAS_OP = _fields(("seq", _LONG, False), ("key", _TEXT, False), ("expected", _TEXT, True), ("new_value", _TEXT, False), ("expire_at", _LONG, False))
CAS_RESULT = _fields(("seq", _LONG, False), ("key", _TEXT, False), ("success", T.BooleanType(), False), ("current_value", _TEXT, True))


class StoreError(Exception):
    """Base of the store's errors."""


class KeyNotFound(StoreError):
    pass


class InvalidArgument(StoreError):
    pass


class ReadOnlyError(StoreError):
    pass


@dataclass(frozen=True)
class EngineProfile:
    """Where the four engines differ to a caller."""

    name: str = "lsm"
    delete_missing: str = "ok"  # or "error"
    batch_get: str = "dedup_sorted"  # or "ordered"
    batch_delete_count: str = "submitted"  # or "found", or "strict": stop at the first missing key
    most_entry_bytes: int | None = None


PROFILES = {
    "memory": EngineProfile("memory", "error", "ordered", "strict"),
    "log": EngineProfile("log", "ok", "ordered", "submitted"),
    "lsm": EngineProfile(),
    "btree": EngineProfile("btree", "error", "ordered", "found"),
}
