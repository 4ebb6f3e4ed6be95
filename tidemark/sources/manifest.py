"""The manifest: which segments and log parts make up a store. It is the only thing readers trust."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tidemark.schema import MANIFEST
from tidemark.sources.files import Folder

NAME = "MANIFEST.json"
VERSION = 1


@dataclass(frozen=True)
class Segment:
    filename: str
    level: int
    min_key: str | None
    max_key: str | None
    size_bytes: int
    entry_count: int
    max_expire_at: int
    min_seq: int
    max_seq: int

    @property
    def unit(self) -> str:
        """What counts as one segment: on level 0 a whole run, however many files a flush has made of it; below, each file."""
        return self.filename.split("/")[0] if self.level == 0 else self.filename

    def may_hold_key(self, key: str) -> bool:
        return self.min_key is not None and self.min_key.encode() <= key.encode() <= self.max_key.encode()

    def may_hold_prefix(self, prefix: str) -> bool:
        if self.min_key is None or self.max_key.encode() < prefix.encode():
            return False
        return self.min_key.encode() <= prefix.encode() or self.min_key.startswith(prefix)

    def overlaps(self, other: Segment) -> bool:
        """Bytewise, as keys are ordered."""
        if self.min_key is None or other.min_key is None:
            return False
        return self.min_key.encode() <= other.max_key.encode() and self.max_key.encode() >= other.min_key.encode()

    def all_expired(self, now: int) -> bool:
        return 0 < self.max_expire_at < now


@dataclass(frozen=True)
class LogPart:
    name: str
    min_seq: int
    max_seq: int
    size_bytes: int
    mtime: int
    entry_bytes: int = 0  # as accounted in memory
    flushed: bool = False
    rows: int = 0

    @property
    def number(self) -> int:
        return number(self.name)


def number(name: str) -> int:
    """The running number in the name of a folder, as in ``log-000000012-5f0c``."""
    return int(name.split("-")[1])


@dataclass(frozen=True)
class Manifest:
    next_id: int = 1
    last_seq: int = 0
    flushed_seq: int = 0
    gc_seq: int = -1  # compaction may have dropped deletions up to here, so nothing as old may come in any more
    segments: tuple[Segment, ...] = ()
    parts: tuple[LogPart, ...] = ()
    retired: int = 0  # the largest number of a log part that retention took away
    dropped: tuple[tuple[str, int], ...] = ()  # folders that were named once, and since when they aren't
    cursor: int = 0  # of a follower: how often it began anew
    followed: int = 0  # of a follower: all of the leader's log parts up to this number are applied
    version: int = field(default=VERSION)

    def names(self) -> set[str]:
        """The folders that make up the store."""
        return {s.filename.split("/")[0] for s in self.segments} | {p.name for p in self.parts}

    def level(self, n: int) -> tuple[Segment, ...]:
        return tuple(s for s in self.segments if s.level == n)

    def levels(self) -> list[int]:
        return sorted({s.level for s in self.segments})

    def without(self, gone: set[str]) -> Manifest:
        return replace(self, segments=tuple(s for s in self.segments if s.filename not in gone))

    def open_parts(self) -> tuple[LogPart, ...]:
        return tuple(p for p in self.parts if not p.flushed)

    def older_elsewhere(self, sources: tuple[Segment, ...], seq: int) -> bool:
        """Whether entries below ``seq`` of keys in the range of the sources may lie outside them, on any level or in open log."""
        outside = (s for s in self.segments if s not in sources and s.min_seq < seq)
        return any(s.overlaps(x) for s in outside for x in sources) or any(p.min_seq < seq for p in self.open_parts())

    def forgettable(self, s: Segment, now: int) -> bool:
        """Every row of the segment has expired and hides no older one, so reads at ``now`` and merges may leave it out."""
        return s.all_expired(now) and not self.older_elsewhere((s,), s.max_seq)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(s).values()) for s in self.segments], MANIFEST)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        if raw.get("version") != VERSION:
            raise ValueError(f"unknown manifest version {raw.get('version')!r}")
        parts = {"segments": tuple(Segment(**s) for s in raw["segments"]), "parts": tuple(LogPart(**p) for p in raw["parts"])}
        return cls(**{**raw, **parts, "dropped": tuple((n, at) for n, at in raw.get("dropped", ()))})


def load(folder: Folder) -> Manifest:
    return Manifest.from_json(folder.read(NAME)) if folder.exists(NAME) else Manifest()


def save(folder: Folder, manifest: Manifest) -> None:
    folder.replace(NAME, manifest.to_json())
