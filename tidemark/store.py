"""A store of versioned keys: an append-only log, leveled sorted segments, and a manifest that names them.

One writer per store. Every batch of mutations is one part of the log, written before the manifest names it; so it is
durable before it is visible, and a crash in between leaves an orphan that ``gc`` removes. Reads union the segments that may
hold the keys with the unflushed parts, take the newest version per key, and apply visibility last.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import current_timestamp, entry_bytes
from tidemark.functions.visibility import counted, is_live, newest, newest_keys
from tidemark.operators import maintenance, mutate, reads
from tidemark.schema import KV_LOG, PROFILES, EngineProfile, InvalidArgument, KeyNotFound, ReadOnlyError
from tidemark.sources import manifest as manifests
from tidemark.sources import segments
from tidemark.sources.files import Folder

FILE_BYTES = 64 << 20
RETENTION_SECONDS = 7 * 86400
RETENTION_BYTES = 1 << 30
CACHE_BYTES = 64 << 20
KEPT_UNREAD = 600  # seconds that files nobody names stay, for readers of an older manifest
STALE_RUNS = 2  # level 0 runs behind this many newer ones are stale


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a store beside the checkpoints, which all executors share. Only a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise InvalidArgument("a cluster must name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="tidemark-")
    return f"{named}/{name}-{uuid.uuid4().hex}"


class KVStore:
    """The methods of the service, over one folder."""

    def __init__(self, spark: SparkSession, path: str, profile: EngineProfile | str = "lsm", writable: bool = True, memory_bytes: int = 4 << 20, auto: bool = True, cache_bytes: int = CACHE_BYTES):
        """``auto``: open log parts of ``memory_bytes`` and more are flushed, and levels compacted, as writes come in.
        ``cache_bytes``: a snapshot of at most so many bytes of files is kept, and then serves the reads."""
        self.spark, self.folder = spark, Folder(spark, path)
        self.path = self.folder.path
        self.profile = PROFILES[profile] if isinstance(profile, str) else profile
        self.writable, self.memory_bytes, self.auto, self.cache_bytes = writable, memory_bytes, auto, cache_bytes
        self.collects = True  # whether compaction may drop deleted and expired rows, and end the history there
        self._cached: tuple[manifests.Manifest, DataFrame] | None = None
        if writable:
            self.folder.make()
        self.manifest = manifests.load(self.folder)
        self.counters: Counter[str] = Counter()
        if writable and self.manifest != manifests.Manifest():
            self.gc()  # what a crash or an older manifest left

    def __enter__(self) -> KVStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Flush what isn't in a segment yet."""
        if self.writable and self.manifest.open_parts():
            self.flush()

    def reload(self) -> None:
        """Take the manifest that is in the folder now, and forget what was kept of the former."""
        self.forget()
        self.manifest = manifests.load(self.folder)

    def recover(self, now: int | None = None) -> None:
        """What a server does when it starts: remove orphans, and merge level 0 runs that were left behind."""
        self.gc()
        if len(self._runs()) > STALE_RUNS:
            self.compact(0, now, stale_only=True)

    def _install(self, manifest: manifests.Manifest) -> None:
        if gone := self.manifest.names() - manifest.names():
            at = int(time.time())
            manifest = replace(manifest, dropped=(*manifest.dropped, *((n, at) for n in sorted(gone))))
        manifests.save(self.folder, manifest)
        self.manifest = manifest
        self.forget()

    def _name(self, kind: str) -> str:
        """A new folder's name; what a crash left under the same number is another one."""
        return f"{kind}-{self.manifest.next_id:09d}-{uuid.uuid4().hex[:8]}"

    # Writing.

    def _guard(self) -> None:
        if not self.writable:
            raise ReadOnlyError("this store is a read-only replica")

    def ingest(self, rows: DataFrame, now: int | None = None) -> None:
        """Append KV_LOG rows that have their seq; one job, one log part. Rows may repeat, but not be older than what
        compaction has collected. Logs of an older form, without ts or expire_at, get 0 for them. A compaction that this
        sets off takes rows as expired at ``now``."""
        self._guard()
        rows = rows.withColumns({c: F.lit(0).cast("bigint") for c in ("ts", "expire_at") if c not in rows.columns})
        name = self._name("log")
        rows.select(*KV_LOG.names).write.option("compression", "zstd").parquet(self.folder.full(name))
        part = segments.read(self.spark, self.folder, [name]).agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.sum(entry_bytes()).alias("size"), F.count("*").alias("n")).first()
        if part.a is not None and part.a <= self.manifest.gc_seq:
            self.folder.delete(name)
            raise InvalidArgument(f"entry {part.a} is older than the collected history, which ends at {self.manifest.gc_seq}")
        if part.b is None:
            self.folder.delete(name)
            return
        added = manifests.LogPart(name, part.a, part.b, self.folder.size(name), self.folder.modified(name), part.size, rows=part.n)
        self._install(replace(self.manifest, next_id=self.manifest.next_id + 1, last_seq=max(self.manifest.last_seq, part.b), parts=(*self.manifest.parts, added)))
        if self.auto and self.needs_flush():
            self.flush()
            self.maybe_compact(now)

    def _append(self, items: list[tuple[str, str | None, int]], now: int) -> None:
        most = self.profile.most_entry_bytes
        for k, v, _ in items:
            if most is not None and 32 + len(k.encode()) + len((v or "").encode()) > most:
                raise InvalidArgument(f"an entry is larger than {most} bytes")
        first = self.manifest.last_seq + 1
        self.ingest(self.spark.createDataFrame([(first + i, now, k, v, e) for i, (k, v, e) in enumerate(items)], KV_LOG), now)

    def set(self, key: str, value: str, ttl_seconds: int = 0, now: int | None = None, if_not_exists: bool = False, if_match: str | None = None) -> bool:
        """A plain set clears any time to live. The conditions turn it into a compare-and-set."""
        now = current_timestamp() if now is None else now
        if if_not_exists or if_match is not None:
            return self.compare_and_set(key, None if if_not_exists else if_match, value, ttl_seconds, now)[0]
        self._guard()
        self._append([(key, value, now + ttl_seconds if ttl_seconds else 0)], now)
        self.counters["set_count"] += 1
        return True

    def set_with_expire_at(self, key: str, value: str, expire_at: int, now: int | None = None) -> None:
        """An expiry that is past leaves the store as it is, without an error."""
        now = current_timestamp() if now is None else now
        self._guard()
        if expire_at == 0 or expire_at > now:
            self._append([(key, value, expire_at)], now)
            self.counters["set_count"] += 1

    def batch_set(self, items: Iterable[tuple], now: int | None = None) -> int:
        """(key, value[, expire_at]) in order, the last of a key wins; the number submitted."""
        now = current_timestamp() if now is None else now
        self._guard()
        rows = [(i[0], i[1], i[2] if len(i) > 2 else 0) for i in items]
        if kept := [r for r in rows if r[2] == 0 or r[2] > now]:
            self._append(kept, now)
        self.counters["batch_set_count"] += len(rows)
        return len(rows)

    def batch_set_frame(self, items: DataFrame, now: int | None = None) -> int:
        """The same for a frame (pos, key, value[, expire_at]) of any size; pos is 0.. without gaps or repeats."""
        now = current_timestamp() if now is None else now
        self._guard()
        n = self._positions(items)
        first = self.manifest.last_seq + 1
        kept = items.where(mutate.accepted(now)) if "expire_at" in items.columns else items
        self.ingest(mutate.set_rows(kept, first, now), now)
        self.counters["batch_set_count"] += n
        return n

    @staticmethod
    def _positions(items: DataFrame) -> int:
        """The number of items, whose positions must be 0.. as they become seqs; only positions are looked at."""
        n, least, most, distinct = items.agg(F.count("*"), F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
        if n and (distinct != n or least != 0 or most != n - 1):
            raise InvalidArgument(f"positions must be 0 to {n - 1}, each once")
        return n

    def delete(self, key: str, now: int | None = None) -> None:
        now = current_timestamp() if now is None else now
        self._guard()
        # A key that expired but is still stored counts as there.
        if self.profile.delete_missing == "error" and not self._rows_for([key]).groupBy("key").agg(F.max_by(F.col("value").isNotNull(), "seq").alias("held")).where("held").take(1):
            raise KeyNotFound("Key not found")
        self._append([(key, None, 0)], now)
        self.counters["delete_count"] += 1

    def batch_delete(self, keys: Iterable[str], now: int | None = None) -> int:
        now = current_timestamp() if now is None else now
        self._guard()
        keys = list(keys)
        self.counters["batch_delete_count"] += len(keys)
        if not keys:
            return 0
        held = set()
        if self.profile.batch_delete_count != "submitted":
            held = {r.key for r in newest(self._rows_for(keys)).where("value IS NOT NULL").select("key").collect()}
        if self.profile.batch_delete_count == "strict":
            for i, k in enumerate(keys):
                if k not in held or k in keys[:i]:
                    if i:
                        self._append([(d, None, 0) for d in keys[:i]], now)  # those before the missing one stay deleted
                    raise KeyNotFound("Key not found")
        self._append([(k, None, 0) for k in keys], now)
        return len(held & set(keys)) if self.profile.batch_delete_count == "found" else len(keys)

    def batch_delete_frame(self, keys: DataFrame, now: int | None = None) -> int:
        """The same for a frame (pos, key) of any size; pos is 0.. without gaps or repeats."""
        now = current_timestamp() if now is None else now
        self._guard()
        n = self._positions(keys)
        self.counters["batch_delete_count"] += n
        gone, result = keys.select("pos", "key"), n
        if self.profile.batch_delete_count != "submitted":
            held = newest(reads.wanted(self.rows(), keys)).where("value IS NOT NULL").select("key")
            found = gone.join(held, "key", "left_semi")
            result = found.agg(F.count_distinct("key")).first()[0] if self.profile.batch_delete_count == "found" else n
        if self.profile.batch_delete_count == "strict":
            # Each key is deleted once, so the first missing place is that of an absent key or of a key's second mention.
            again = gone.join(gone.groupBy("key").agg(F.min("pos").alias("first")), "key").where("pos > first").select("pos")
            stop = gone.join(held, "key", "left_anti").select("pos").unionAll(again).agg(F.min("pos")).first()[0]
            if stop is not None:
                if stop:
                    self.ingest(mutate.delete_rows(gone.where(F.col("pos") < stop), self.manifest.last_seq + 1, now), now)
                raise KeyNotFound("Key not found")
        self.ingest(mutate.delete_rows(gone, self.manifest.last_seq + 1, now), now)
        return result

    def compare_and_set(self, key: str, expected: str | None, new: str, ttl_seconds: int = 0, now: int | None = None) -> tuple[bool, str | None]:
        """(success, value before); expected None means that the key must not exist."""
        now = current_timestamp() if now is None else now
        self._guard()
        found = newest(self._rows_for([key])).where(is_live(now)).collect()
        current = found[0].value if found else None
        self.counters["cas_count"] += 1
        if current != expected:
            self.counters["cas_conflicts"] += 1
            return False, current
        self._append([(key, new, now + ttl_seconds if ttl_seconds else 0)], now)
        self.counters["set_count"] += 1
        return True, current

    def rpc_compare_and_set(self, key: str, expected: str, new: str, expect_exists: bool, ttl_seconds: int = 0, now: int | None = None) -> tuple[bool, str]:
        """The service's form: without ``expect_exists`` the key must not exist, and a missing value comes back as ""."""
        done, current = self.compare_and_set(key, expected if expect_exists else None, new, ttl_seconds, now)
        return done, current or ""

    def compare_and_set_batch(self, ops: DataFrame, now: int | None = None) -> DataFrame:
        """CAS_RESULT of many operations (CAS_OP); those that succeed are written as one log part.

        Seqs must follow the store's last one, each once.
        """
        now = current_timestamp() if now is None else now
        self._guard()
        folded = mutate.cas_fold(ops, reads.wanted(self.rows(), ops), now)
        name = self._name("cas")
        folded.write.parquet(self.folder.full(name))  # both results and rows come from one run of the fold
        done = self.spark.read.parquet(self.folder.full(name))
        n, least, distinct, succeeded = done.agg(F.count("*"), F.min("seq"), F.count_distinct("seq"), F.count_if("success")).first()
        if n and (least <= self.manifest.last_seq or distinct != n):
            self.folder.delete(name)
            raise InvalidArgument(f"seqs must follow {self.manifest.last_seq}, each once")
        self.ingest(mutate.cas_rows(done, now), now)
        self.counters["cas_count"] += n
        self.counters["cas_conflicts"] += n - succeeded
        self.counters["set_count"] += succeeded
        return mutate.cas_results(done)

    # Reading.

    def _chosen(self, keep, now: int | None = None) -> list[str]:
        """Files that a read needs; of a read at ``now``, not those with nothing but expired rows."""
        chosen = [s for s in self.manifest.segments if keep(s) and (now is None or not self.manifest.forgettable(s, now))]
        searched = len({s.unit for s in chosen})
        self.counters["segment_searches"] += searched
        self.counters["segments_pruned"] += len({s.unit for s in self.manifest.segments}) - searched
        return [s.filename for s in chosen]

    def _tail(self) -> DataFrame:
        return segments.read(self.spark, self.folder, [p.name for p in self.manifest.open_parts()])

    def rows(self, keep=lambda s: True, now: int | None = None) -> DataFrame:
        """All stored versions that reads of the chosen segments need."""
        return segments.read(self.spark, self.folder, self._chosen(keep, now)).unionByName(self._tail())

    def _rows_for(self, keys: list[str]) -> DataFrame:
        return self._versions(lambda s: any(s.may_hold_key(k) for k in keys)).where(F.col("key").isin(keys))

    def _versions(self, keep=lambda s: True, now: int | None = None) -> DataFrame:
        """What a read resolves: the kept snapshot if there is one of this manifest, else the files."""
        if self._cached is not None and self._cached[0] == self.manifest:
            self.counters["cache_hits"] += 1
            return self._cached[1]
        self.counters["cache_misses"] += 1
        return self.rows(keep, now)

    def live(self, now: int | None = None) -> DataFrame:
        now = current_timestamp() if now is None else now
        return newest(self._versions(now=now)).where(is_live(now))

    def snapshot(self) -> DataFrame:
        """The newest version of every key. If the store's files are under ``cache_bytes``, it is kept in memory or on disk until
        the store changes or ``forget`` is called, and reads are served from it."""
        if self._cached is not None and self._cached[0] == self.manifest:
            self.counters["cache_hits"] += 1
            return self._cached[1]
        self.forget()
        self.counters["cache_misses"] += 1
        found = newest(self.rows())
        if sum(s.size_bytes for s in self.manifest.segments) + sum(p.size_bytes for p in self.manifest.open_parts()) <= self.cache_bytes:
            found = found.persist()
            self._cached = (self.manifest, found)
        return found

    def forget(self) -> None:
        if self._cached is not None:
            self._cached[1].unpersist()
            self._cached = None
            self.counters["cache_evictions"] += 1

    def get_with_expire_at(self, key: str, now: int | None = None) -> tuple[str, int]:
        now = current_timestamp() if now is None else now
        self.counters["get_count"] += 1
        if self._cached is not None and self._cached[0] == self.manifest:
            found = self._rows_for([key]).collect()
        else:
            self.counters["cache_misses"] += 1
            chosen = self._chosen(lambda s: s.may_hold_key(key))
            stored = segments.read(self.spark, self.folder, chosen, with_file=True).unionByName(self._tail().withColumn("file", F.lit(None).cast("string")))
            # One row, and at most a name per file searched.
            own = stored.where(F.col("key") == key).groupBy("key").agg(F.max_by(F.struct("value", "expire_at"), "seq").alias("m"), F.collect_set("file").alias("files"))
            found = own.select("key", "m.value", "m.expire_at", "files").collect()
            self.counters["segment_false_positives"] += len(chosen) - (len(found[0].files) if found else 0)
        if not found:
            raise KeyNotFound("Key not found")
        if found[0].value is None:
            raise KeyNotFound("Key deleted")
        if 0 < found[0].expire_at < now:
            raise KeyNotFound("Key expired")
        return found[0].value, found[0].expire_at

    def get(self, key: str, now: int | None = None) -> str:
        return self.get_with_expire_at(key, now)[0]

    def get_expire_at(self, key: str, now: int | None = None) -> tuple[bool, int]:
        try:
            return True, self.get_with_expire_at(key, now)[1]
        except KeyNotFound:
            return False, 0

    def batch_get(self, keys: Iterable[str], now: int | None = None) -> list[tuple[str, str]]:
        """Found pairs: in the order of the request with duplicates, or each once by key, as the profile says."""
        now = current_timestamp() if now is None else now
        keys = list(keys)
        asked = sorted(set(keys), key=str.encode)
        self.counters["batch_get_count"] += len(asked) if self.profile.batch_get == "dedup_sorted" else len(keys)
        found = {r.key: r.value for r in newest(self._rows_for(asked)).where(is_live(now)).collect()} if keys else {}
        return [(k, found[k]) for k in (asked if self.profile.batch_get == "dedup_sorted" else keys) if k in found]

    def batch_get_frame(self, requests: DataFrame, now: int | None = None) -> DataFrame:
        """(pos, key, value) of the found keys of (pos, key), for request lists of any length."""
        now = current_timestamp() if now is None else now
        self.counters["batch_get_count"] += requests.agg(F.count_distinct("key") if self.profile.batch_get == "dedup_sorted" else F.count("key")).first()[0]
        return reads.batch_get(self._versions(now=now), requests, now)

    def get_expire_at_frame(self, requests: DataFrame, now: int | None = None) -> DataFrame:
        """(pos, key, exists, expire_at) for every request (pos, key)."""
        now = current_timestamp() if now is None else now
        self.counters["batch_get_count"] += requests.count()
        return reads.get_expire_at(self._versions(now=now), requests, now)

    def count(self, prefix: str = "", now: int | None = None) -> int:
        now = current_timestamp() if now is None else now
        rows = self._versions(lambda s: s.may_hold_prefix(prefix) if prefix else True, now)
        rows = rows.where(F.col("key").startswith(prefix)) if prefix else rows
        return newest_keys(rows).where(counted(now)).count()

    def rpc_count(self, prefix: str, now: int | None = None) -> int:
        """The service's count, for which the empty prefix is an error."""
        if not prefix:
            raise KeyNotFound("Prefix cannot be empty")
        return self.count(prefix, now)

    def scan_prefix(self, prefix: str, now: int | None = None) -> DataFrame:
        now = current_timestamp() if now is None else now
        return reads.scan_prefix(self._versions(lambda s: s.may_hold_prefix(prefix), now), prefix, now)

    # Maintenance.

    def needs_flush(self) -> bool:
        return sum(p.entry_bytes for p in self.manifest.open_parts()) >= self.memory_bytes

    def flush(self) -> None:
        """The newest versions of the open log parts become a level 0 segment; the LSN is what it really holds."""
        self._guard()
        parts = self.manifest.open_parts()
        if not parts:
            return
        rows = newest(segments.read(self.spark, self.folder, [p.name for p in parts]), "ts")
        added = self._write(rows, 0, sum(p.size_bytes for p in parts), sum(p.rows for p in parts))
        flushed_seq = max(self.manifest.flushed_seq, *(p.max_seq for p in parts))
        marked = tuple(replace(p, flushed=True) for p in self.manifest.parts)
        self._install(replace(self.manifest, next_id=self.manifest.next_id + 1, flushed_seq=flushed_seq, segments=(*self.manifest.segments, *added), parts=marked))
        self.counters["flush_count"] += 1
        self.counters["flush_bytes"] += sum(s.size_bytes for s in added)

    def _write(self, rows: DataFrame, level: int, size: int, keys: int) -> tuple[manifests.Segment, ...]:
        """Rows of about ``size`` bytes as one run of segments."""
        run = segments.write_run(rows, self.folder, self._name("seg"), max(1, -(-size // FILE_BYTES)), keys)
        return tuple(segments.segment(self.folder, path, level, stats) for path, stats in run)

    def _runs(self) -> list[str]:
        """The level 0 runs, oldest first."""
        return sorted({s.filename.split("/")[0] for s in self.manifest.level(0)}, key=manifests.number)

    def compaction_level(self) -> int | None:
        """The level to compact: 0 from four runs on, else the first that is larger than its target."""
        if len(self._runs()) >= maintenance.L0_TRIGGER:
            return 0
        for n in self.manifest.levels():
            if n and sum(s.size_bytes for s in self.manifest.level(n)) > maintenance.level_target(n):
                return n
        return None

    def maybe_compact(self, now: int | None = None) -> bool:
        level = self.compaction_level()
        if level is None:
            return False
        self.compact(level, now)
        return True

    def compact(self, level: int = 0, now: int | None = None, stale_only: bool = False) -> None:
        """Merge a level, or its first file, with what it overlaps below; ``stale_only``: of level 0, the runs with newer ones
        behind them. Deleted and expired rows go only if no overlapping segment of any level and no open log part has
        older entries; otherwise an older version could come back. Files of nothing but expired rows aren't read then."""
        now = current_timestamp() if now is None else now
        self._guard()
        own = self.manifest.level(level)
        if stale_only:
            stale = set(self._runs()[:-STALE_RUNS])
            own = tuple(s for s in own if s.filename.split("/")[0] in stale)
        if not own:
            return
        upper = own if level == 0 else (min(own, key=lambda s: (s.min_key or "").encode()),)
        lower = tuple(s for s in self.manifest.level(level + 1) if any(s.overlaps(u) for u in upper))
        sources = (*upper, *lower)
        collect = self.collects and not self.manifest.older_elsewhere(sources, max(s.max_seq for s in sources))
        self._merge(sources, level + 1, now, collect)

    def _merge(self, sources: tuple[manifests.Segment, ...], level: int, now: int, collect: bool) -> None:
        read = [s for s in sources if not (collect and self.manifest.forgettable(s, now))]
        rows = newest(segments.read(self.spark, self.folder, [s.filename for s in read]), "ts")
        size = sum(s.size_bytes for s in read)
        added = self._write(rows.where(is_live(now)) if collect else rows, level, size, sum(s.entry_count for s in read)) if read else ()
        left = self.manifest.without({s.filename for s in sources})
        gc_seq = max(left.gc_seq, *(s.max_seq for s in sources)) if collect else left.gc_seq
        self._install(replace(left, next_id=left.next_id + 1, gc_seq=gc_seq, segments=(*left.segments, *added)))
        self.counters["compaction_count"] += 1
        self.counters["compaction_bytes_read"] += size
        self.counters["compaction_bytes_written"] += sum(s.size_bytes for s in added)

    def compact_all(self, now: int | None = None) -> None:
        """Flush, then rewrite everything as one sorted run without deleted and expired rows."""
        now = current_timestamp() if now is None else now
        self._guard()
        self.flush()
        if sources := self.manifest.segments:
            self._merge(sources, max(max(self.manifest.levels()), 1), now, self.collects)

    def retain(self, now: int | None = None, most_age: int = RETENTION_SECONDS, most_bytes: int = RETENTION_BYTES) -> list[str]:
        """Take flushed log parts that are too old, and oldest first while the rest is too large, out of the store; their names.
        The files go with the ``gc`` after the time that readers of the former manifest have."""
        now = current_timestamp() if now is None else now
        self._guard()
        flushed = sorted((p for p in self.manifest.parts if p.flushed), key=lambda p: p.number)
        total, gone = sum(p.size_bytes for p in flushed), []
        for p in flushed:
            if now - p.mtime > most_age or total > most_bytes:
                gone.append(p)
                total -= p.size_bytes
        if gone:
            retired = max(self.manifest.retired, *(p.number for p in gone))
            self._install(replace(self.manifest, retired=retired, parts=tuple(p for p in self.manifest.parts if p not in gone)))
        return [p.name for p in gone]

    def gc(self, now: int | None = None, grace: int = KEPT_UNREAD) -> list[str]:
        """Delete folders that the manifest hasn't named for ``grace`` seconds, or that it never did; none while someone holds the folder."""
        now = int(time.time()) if now is None else now
        self._guard()
        if self.folder.holds(now):
            return []
        named, since, there = self.manifest.names(), dict(self.manifest.dropped), self.folder.names()
        orphans = [n for n in there if n[:4] in ("seg-", "log-", "cas-") and n not in named and now - since.get(n, self.folder.modified(n)) >= grace]
        for n in orphans:
            self.folder.delete(n)
        left = tuple((n, at) for n, at in self.manifest.dropped if n in there and n not in orphans)
        if left != self.manifest.dropped:
            cached = self._cached
            manifests.save(self.folder, replace(self.manifest, dropped=left))
            self.manifest = replace(self.manifest, dropped=left)
            self._cached = (self.manifest, cached[1]) if cached else None
        return orphans

    def entry_count(self, now: int | None = None) -> int:
        """The number of live keys."""
        return self.count("", now)

    def metrics(self) -> dict[str, float]:
        """Counters, and ratios that are 0 where nothing was counted."""
        out: dict[str, float] = {k: self.counters[k] for k in COUNTERS}
        checks, lookups = out["segments_pruned"] + out["segment_searches"], out["cache_hits"] + out["cache_misses"]
        out["pruning_effectiveness"] = out["segments_pruned"] / checks if checks else 0.0
        out["cache_hit_ratio"] = out["cache_hits"] / lookups if lookups else 0.0
        kept = self._cached[1].select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() if self._cached else 0
        out |= {"cache_entries": int(self._cached is not None), "cache_size_bytes": int(str(kept)), "cache_max_size_bytes": self.cache_bytes}
        out |= {
            "segment_count": len(self.manifest.segments), "segment_bytes": sum(s.size_bytes for s in self.manifest.segments), "open_parts": len(self.manifest.open_parts()),
            "last_seq": self.manifest.last_seq, "stored_entries": sum(s.entry_count for s in self.manifest.segments) + sum(p.rows for p in self.manifest.open_parts()),
        }
        return out

    def report(self) -> str:
        """The metrics as text."""
        return report(self.metrics())

    def metrics_frame(self) -> DataFrame:
        """The metrics as one row."""
        return self.spark.createDataFrame([{k: float(v) if k.endswith(("ratio", "effectiveness")) else int(v) for k, v in self.metrics().items()}])

    def reset_metrics(self) -> None:
        self.counters.clear()


COUNTERS = (
    "get_count", "set_count", "delete_count", "batch_get_count", "batch_set_count", "batch_delete_count", "cas_count", "cas_conflicts",
    "segment_searches", "segments_pruned", "segment_false_positives", "flush_count", "flush_bytes",
    "compaction_count", "compaction_bytes_read", "compaction_bytes_written", "cache_hits", "cache_misses", "cache_evictions",
)
#: The parts of the text report.
SECTIONS = {
    "Operations": ("get_count", "set_count", "delete_count", "batch_get_count", "batch_set_count", "batch_delete_count", "cas_count", "cas_conflicts"),
    "Segments": ("segment_count", "segment_bytes", "segment_searches", "segments_pruned", "segment_false_positives", "pruning_effectiveness"),
    "Log": ("open_parts", "last_seq", "flush_count", "flush_bytes"),
    "Compaction": ("compaction_count", "compaction_bytes_read", "compaction_bytes_written"),
    "Cache": ("cache_entries", "cache_size_bytes", "cache_max_size_bytes", "cache_hits", "cache_misses", "cache_evictions", "cache_hit_ratio"),
}


def report(metrics: dict[str, float]) -> str:
    """Metrics as lines under headings; sizes also in MB, shares in percent."""

    def shown(name: str) -> str:
        value = metrics[name]
        if name.endswith(("ratio", "effectiveness")):
            return f"{100 * value:.1f} %"
        return f"{value} ({value / (1 << 20):.2f} MB)" if "bytes" in name else f"{value}"

    return "\n".join(f"{title}\n" + "\n".join(f"  {n.replace('_', ' ')}: {shown(n)}" for n in names) for title, names in SECTIONS.items())
