"""Replication: what a leader offers to its followers, and a follower that copies segments and streams the log behind them."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.visibility import newest
from tidemark.schema import KV_LOG, InvalidArgument
from tidemark.sources import manifest as manifests
from tidemark.sources import segments
from tidemark.sources.files import Folder
from tidemark.store import FILE_BYTES, KVStore

CATCH_UP_FILES = 1000
MOST_FILE_AGE = "90d"  # a follower that was away longer than this begins anew, as retention ends far earlier
NAMED_SECONDS = 20  # how long a batch waits for the manifest to name a log part that it has read
MOST_WAIT = 60.0
RETRIES = 3


class SnapshotRequired(Exception):
    """The leader no longer has log that the follower hasn't applied."""


class NotNamedYet(Exception):
    """A log part that the leader's manifest doesn't name, neither now nor before: its writer is at work, or died."""


@dataclass(frozen=True)
class SnapshotInfo:
    """Whether a follower needs the segments, which files they are, where the log goes on, and their size."""

    required: bool
    files: tuple[str, ...]
    resume: int
    size_bytes: int


class Leader:
    """The replication side of a store's folder, read only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def manifest(self) -> manifests.Manifest:
        return manifests.load(self.folder)

    def info(self) -> tuple[int, int]:
        """(number of the newest log part, last seq)."""
        m = self.manifest()
        return max((p.number for p in m.parts), default=m.retired), m.last_seq

    def request_snapshot(self, followed: int) -> SnapshotInfo:
        """For a follower that has applied all log parts up to ``followed``."""
        m = self.manifest()
        required = m.retired > followed
        files = tuple(s.filename for s in m.segments) if required else ()
        return SnapshotInfo(required, files, m.retired if required else followed, sum(s.size_bytes for s in m.segments) if required else 0)

    def read_snapshot(self, filename: str) -> DataFrame:
        """The rows of one file of the snapshot; only files that the manifest names."""
        if filename not in {s.filename for s in self.manifest().segments}:
            raise InvalidArgument(f"not a file of the snapshot: {filename!r}")
        return segments.read(self.spark, self.folder, [filename])


class Follower:
    """A read-only copy of the leader's store, until it is promoted.

    Entries keep their seq and absolute expiry, so replays and disorder do no harm. Which log parts are applied is in the
    follower's manifest; the stream's checkpoint says which files are read. Beginning anew is one replacement of the manifest,
    with a new checkpoint, so that a crash leaves the old state or the new one.
    """

    def __init__(self, spark: SparkSession, leader_path: str, path: str):
        self.spark, self.leader_path = spark, leader_path.rstrip("/")
        self.source = Leader(spark, self.leader_path)
        self.store = KVStore(spark, path, writable=True)
        self.store.writable = False
        # Files of a log part come in any order, so rows older than applied ones are still to come: until the promotion,
        # compaction collects nothing, and gc_seq stays where the bootstrap put it.
        self.store.collects = False
        self.service: Leader | None = None
        self._run: Following | None = None

    @property
    def writable(self) -> bool:
        return self.store.writable

    @property
    def checkpoint(self) -> str:
        return f"{self.store.path}/cursor-{self.store.manifest.cursor}"

    def leader(self) -> manifests.Manifest:
        return self.source.manifest()

    def gap(self) -> bool:
        """Whether the leader has given up log parts that we haven't applied."""
        return self.leader().retired > self.store.manifest.followed

    def _as_writer(self, work) -> None:
        self.store.writable = True
        try:
            work()
        finally:
            self.store.writable = False

    def bootstrap(self) -> None:
        """Replace what is here by the leader's segments, newest versions only; the log that the leader still has follows by stream.

        All that the leader collected lies at or below its ``gc_seq``, and of such rows the segments have what is left. So
        the stream leaves them out, and takes everything above.
        """
        with self.source.folder.held():
            leader = self.leader()
            own = self.store.manifest
            added: tuple[manifests.Segment, ...] = ()
            if leader.segments:
                size, keys = sum(s.size_bytes for s in leader.segments), sum(s.entry_count for s in leader.segments)
                rows = newest(segments.read(self.spark, self.source.folder, [s.filename for s in leader.segments]), "ts")
                run = segments.write_run(rows, self.store.folder, self.store._name("seg"), max(1, -(-size // FILE_BYTES)), keys)
                added = tuple(segments.segment(self.store.folder, path, 1, stats) for path, stats in run)
        fresh = manifests.Manifest(
            next_id=own.next_id + 1, last_seq=max(leader.flushed_seq, leader.gc_seq, 0), flushed_seq=leader.flushed_seq, gc_seq=leader.gc_seq,
            segments=added, dropped=own.dropped, cursor=own.cursor + 1, followed=leader.retired,
        )
        self._as_writer(lambda: self.store._install(fresh))
        for name in self.store.folder.names():
            if name.startswith("cursor-") and name != f"cursor-{fresh.cursor}":
                self.store.folder.delete(name)

    def reload(self) -> None:
        """Take the state that another process of this follower has left in the folder."""
        self.store.reload()

    def _stream(self) -> DataFrame:
        # Every log part is a folder of files, complete when the job that wrote it committed.
        source = self.spark.readStream.schema(KV_LOG).option("maxFilesPerTrigger", CATCH_UP_FILES).option("pathGlobFilter", "*.parquet").option("maxFileAge", MOST_FILE_AGE)
        part = F.regexp_extract(F.col("_metadata.file_path"), r"/(log-[^/]+)/[^/]+$", 1)
        return source.parquet(f"{self.leader_path}/log-*").select(*KV_LOG.names, part.alias("part"))

    def _orphans(self, parts: set[str]) -> list[str]:
        """Those that a crashed writer left. One that is being written is waited for until the manifest names it."""
        until = time.monotonic() + NAMED_SECONDS
        while True:
            leader = self.leader()
            unknown = parts - {p.name for p in leader.parts}
            if not any(manifests.number(p) >= leader.next_id for p in unknown):
                return sorted(p for p in unknown if manifests.number(p) > leader.retired)
            if time.monotonic() > until:
                raise NotNamedYet(", ".join(sorted(unknown)))
            time.sleep(0.2)

    def _apply(self, batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col("seq") > self.store.manifest.gc_seq)
        if "part" in batch.columns:
            seen = {r.part for r in batch.select("part").distinct().collect()}  # at most one per file of the batch
            if orphans := self._orphans(seen):
                rows = rows.where(~F.col("part").isin(orphans))
        self._as_writer(lambda: self.store.ingest(rows.select(*KV_LOG.names)))

    def catch_up(self) -> None:
        """Apply all log that the leader has now, then stop. A gap raises SnapshotRequired."""
        before, ours = self.leader(), self.store.manifest.followed
        if before.retired > ours:
            raise SnapshotRequired("the leader's log begins behind our last entry")
        if before.parts:  # else there may be no folder to list
            query = self._stream().writeStream.foreachBatch(self._apply).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
            if error := query.exception():
                raise error
        if self.leader().retired > ours:
            raise SnapshotRequired("log was given up while it was read")
        followed = max(ours, before.next_id - 1)
        if followed > ours:
            self._as_writer(lambda: self.store._install(replace(self.store.manifest, followed=followed)))

    def sync(self) -> bool:
        """Catch up, over a new bootstrap if there is a gap; whether there was one."""
        try:
            self.catch_up()
            return False
        except SnapshotRequired:
            self.bootstrap()
            self.catch_up()
            return True

    def follow(self, interval: float = 1.0) -> Following:
        """Keep applying in the background: a round of the stream every ``interval`` seconds, over gaps and errors."""
        self.stop()
        self._run = Following(self, interval)
        return self._run

    def stop(self) -> None:
        if self._run is not None:
            self._run.stop()
            self._run = None

    def promote(self, enable_service: bool = False) -> tuple[bool, str]:
        """Stop following and take writes; a store that does already says so. With ``enable_service`` others can follow it:
        the folder is what they read, so there is no port, and ``service`` is its replication side."""
        if self.writable:
            return False, "already a leader"
        self.stop()
        self.store.writable = self.store.collects = True
        if enable_service:
            self.service = Leader(self.spark, self.store.path)
        return True, "promoted"

    def live(self, now: int) -> DataFrame:
        return self.store.live(now)

    def lag(self) -> DataFrame:
        """(leader_seq, applied_seq, behind) in one row."""
        leader = self.leader().last_seq
        return self.spark.range(1).select(F.lit(leader).alias("leader_seq"), F.lit(self.store.manifest.last_seq).alias("applied_seq"), F.lit(max(0, leader - self.store.manifest.last_seq)).alias("behind"))


class Following:
    """Rounds of a follower in a thread of its own. An error is kept in ``error`` and tried again after a growing wait; after
    some failures on end the follower begins anew, as its files may be gone."""

    def __init__(self, follower: Follower, interval: float):
        self.follower, self.interval = follower, interval
        self.rounds = self.bootstraps = self.failures = 0
        self.error: Exception | None = None
        self._ended = threading.Event()
        self._thread = threading.Thread(target=self._rounds, name="tidemark-follower", daemon=True)
        self._thread.start()

    def _rounds(self) -> None:
        wait = 0.0
        while not self._ended.wait(wait):
            try:
                if self.failures >= RETRIES:
                    self.follower.bootstrap()
                    self.bootstraps += 1
                    self.failures = 0
                self.bootstraps += self.follower.sync()
                self.rounds, self.failures, self.error, wait = self.rounds + 1, 0, None, self.interval
            except Exception as e:  # any of Spark's; the next round tries again
                self.error, self.failures = e, self.failures + 1
                wait = min(MOST_WAIT, self.interval * 2**self.failures)

    @property
    def running(self) -> bool:
        return self._thread.is_alive()

    def wait_for(self, rounds: int, seconds: float) -> bool:
        """Whether so many rounds have been done, after at most so long."""
        until = time.monotonic() + seconds
        while self.rounds < rounds and time.monotonic() < until and self.running:
            time.sleep(0.05)
        return self.rounds >= rounds

    def stop(self) -> None:
        self._ended.set()
        self._thread.join()
