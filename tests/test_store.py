"""The store's folder: flush, compaction, recovery, retention, replication."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark import cli, workload
from tidemark.schema import CAS_OP, KV_LOG, EngineProfile, InvalidArgument, KeyNotFound, ReadOnlyError
from tidemark.sources import manifest as manifests
from tidemark.store import KVStore
from tidemark.streaming.replicate import Follower, SnapshotRequired

NOW = 1000


@pytest.fixture
def store(spark, tmp_path):
    return KVStore(spark, str(tmp_path / "store"))


def live(store):
    return {r.key: r.value for r in store.live(NOW).collect()}


def test_round_trip(store):
    store.set("a", "1", now=NOW)
    store.batch_set([("b", "2"), ("b", "3"), ("c", "4", NOW + 10), ("d", "5", NOW - 10)], now=NOW)
    assert live(store) == {"a": "1", "b": "3", "c": "4"}
    assert store.get_with_expire_at("c", NOW) == ("4", NOW + 10)
    assert store.get_expire_at("a", NOW) == (True, 0)
    assert store.get_expire_at("d", NOW) == (False, 0)
    with pytest.raises(KeyNotFound, match="expired"):
        store.get("c", NOW + 11)
    store.delete("a", NOW)
    with pytest.raises(KeyNotFound, match="deleted"):
        store.get("a", NOW)
    assert store.count("", NOW) == 2
    with pytest.raises(KeyNotFound, match="empty"):
        store.rpc_count("")


def test_versions_across_segments_and_reopening(spark, store):
    store.set("key", "v1", now=NOW)
    store.flush()
    store.set("key", "v2", now=NOW)
    store.flush()
    store.set("key", "v3", now=NOW)
    assert store.get("key", NOW) == "v3"
    again = KVStore(spark, store.path)
    assert again.get("key", NOW) == "v3"
    assert again.manifest == store.manifest


def test_compaction_drops_deletions_only_at_the_bottom(store):
    store.batch_set([("a", "1"), ("b", "1"), ("z", "1")], now=NOW)
    store.flush()
    store.compact(0, NOW)
    store.compact(1, NOW)
    assert [s.level for s in store.manifest.segments] == [2]
    store.delete("b", NOW)
    store.flush()
    store.compact(0, NOW)  # level 2 still holds b, so the deletion must stay
    assert live(store) == {"a": "1", "z": "1"}
    assert sum(s.entry_count for s in store.manifest.level(1)) == 1
    store.compact(1, NOW)
    assert live(store) == {"a": "1", "z": "1"}
    assert sum(s.entry_count for s in store.manifest.segments) == 2


def test_late_old_entries_are_refused_after_collection(spark, store):
    store.batch_set([("a", "1"), ("b", "1")], now=NOW)
    store.delete("a", NOW)
    store.flush()
    store.compact(0, NOW)
    with pytest.raises(InvalidArgument, match="older"):
        store.ingest(spark.createDataFrame([(1, NOW, "a", "1", 0)], KV_LOG))
    assert live(store) == {"b": "1"}


def test_logs_of_an_older_form(spark, store):
    store.ingest(spark.createDataFrame([(1, "a", "1"), (2, "b", None)], "seq bigint, key string, value string"))
    assert store.get_with_expire_at("a", NOW) == ("1", 0)
    assert live(store) == {"a": "1"}


def test_trigger_and_garbage(store):
    for i in range(4):
        assert store.compaction_level() is None
        store.set(f"k{i}", "v", now=NOW)
        store.flush()
    assert store.maybe_compact(NOW)
    assert store.manifest.levels() == [1]
    assert store.gc(grace=3600) == []
    gone = store.gc(grace=0)
    assert len(gone) == 4
    assert len(live(store)) == 4
    parts = store.retain(NOW, most_age=10**12, most_bytes=0)
    assert len(parts) == 4 and store.manifest.retired == manifests.number(parts[-1])
    assert all(store.folder.exists(n) for n in parts)  # for readers of the former manifest
    with store.folder.held():
        assert store.gc(grace=0) == []
    assert sorted(store.gc(grace=0)) == sorted(parts)
    assert store.manifest.dropped == ()
    assert len(live(store)) == 4


def test_a_crash_before_the_manifest_leaves_the_old_state(spark, store, monkeypatch):
    store.set("a", "1", now=NOW)

    def crash(*_):
        raise OSError("crash")

    monkeypatch.setattr(manifests, "save", crash)
    with pytest.raises(OSError):
        store.set("a", "2", now=NOW)
    monkeypatch.undo()
    again = KVStore(spark, store.path)
    assert again.get("a", NOW) == "1"
    again.set("a", "3", now=NOW)  # beside what the crash left
    assert again.get("a", NOW) == "3"
    assert len(again.gc(grace=0)) == 1


def test_writes_flush_and_compact_by_themselves(spark, tmp_path):
    store = KVStore(spark, str(tmp_path / "auto"), memory_bytes=80)
    for i in range(8):
        store.batch_set([(f"k{i}", "v" * 20), ("same", str(i))], now=NOW)
    assert store.metrics()["flush_count"] == 8
    assert store.metrics()["compaction_count"] >= 1
    assert live(store) == {f"k{i}": "v" * 20 for i in range(8)} | {"same": "7"}
    store.delete("same", NOW)
    assert store.metrics()["flush_bytes"] > 0
    store.compact_all(NOW)
    assert sum(s.entry_count for s in store.manifest.segments) == 8


def test_cached_snapshot_follows_the_store(store):
    store.set("a", "1", now=NOW)
    assert store.snapshot().count() == store.snapshot().count() == 1
    store.set("b", "1", now=NOW)
    assert store.snapshot().count() == 2
    assert (store.metrics()["cache_hits"], store.metrics()["cache_misses"]) == (1, 2)
    store.forget()


def test_pruning_reads_only_files_that_may_hold_the_key(store):
    for k in ("a", "m", "z"):
        store.set(k, k, now=NOW)
        store.flush()
    store.reset_metrics()
    assert store.get("m", NOW) == "m"
    m = store.metrics()
    assert (m["segment_searches"], m["segments_pruned"], m["segment_false_positives"]) == (1, 2, 0)
    assert m["pruning_effectiveness"] == pytest.approx(2 / 3)
    store.batch_set([("a0", "1"), ("y", "1")], NOW)
    store.flush()
    assert not store.get_expire_at("n", NOW)[0]  # in the range of one file, which hasn't got it
    assert store.metrics()["segment_false_positives"] == 1
    assert "pruning effectiveness: 62.5 %" not in store.report() and "segment searches: 2" in store.report()
    assert store.metrics_frame().first().get_count == 2


def test_profiles(spark, tmp_path):
    memory = KVStore(spark, str(tmp_path / "m"), "memory")
    memory.batch_set([("a", "1"), ("b", "2")], now=NOW)
    assert memory.batch_get(["b", "a", "x", "b"], NOW) == [("b", "2"), ("a", "1"), ("b", "2")]
    with pytest.raises(KeyNotFound):
        memory.delete("x", NOW)
    with pytest.raises(KeyNotFound):
        memory.batch_delete(["a", "x", "b"], NOW)
    assert live(memory) == {"b": "2"}
    tree = KVStore(spark, str(tmp_path / "t"), "btree")
    tree.batch_set([("a", "1")], now=NOW)
    assert tree.batch_delete(["a", "x"], NOW) == 1
    lsm = KVStore(spark, str(tmp_path / "l"))
    assert lsm.batch_delete(["a", "x"], NOW) == 2
    lsm.batch_set([("b", "2"), ("a", "1")], now=NOW)
    assert lsm.batch_get(["b", "a", "x", "b"], NOW) == [("a", "1"), ("b", "2")]
    small = KVStore(spark, str(tmp_path / "s"), EngineProfile(most_entry_bytes=40))
    with pytest.raises(InvalidArgument):
        small.set("key", "much too long", now=NOW)


def test_compare_and_set(spark, store):
    assert store.compare_and_set("k", None, "a", now=NOW) == (True, None)
    assert store.compare_and_set("k", None, "b", now=NOW) == (False, "a")
    assert store.compare_and_set("k", "a", "b", 5, NOW) == (True, "a")
    assert store.get_with_expire_at("k", NOW) == ("b", NOW + 5)
    assert store.set("n", "1", now=NOW, if_not_exists=True)
    assert not store.set("n", "2", now=NOW, if_match="9")
    first = store.manifest.last_seq + 1
    ops = spark.createDataFrame([(first, "n", "1", "2", 0), (first + 1, "n", "1", "3", 0), (first + 2, "x", None, "4", 0)], CAS_OP)
    assert [tuple(r) for r in store.compare_and_set_batch(ops, NOW).orderBy("seq").collect()] == [(first, "n", True, "1"), (first + 1, "n", False, "2"), (first + 2, "x", True, None)]
    assert live(store) == {"k": "b", "n": "2", "x": "4"}
    m = store.metrics()
    assert (m["cas_count"], m["cas_conflicts"]) == (8, 3)
    for seqs in ((1, 2), (first + 3, first + 3)):
        with pytest.raises(InvalidArgument, match="follow"):
            store.compare_and_set_batch(spark.createDataFrame([(q, "y", None, "1", 0) for q in seqs], CAS_OP), NOW)
    assert store.rpc_compare_and_set("z", "ignored", "1", False, 0, NOW) == (True, "")
    assert store.rpc_compare_and_set("z", "2", "3", True, 0, NOW) == (False, "1")


def test_manifest_text():
    m = manifests.Manifest(segments=(manifests.Segment("f", 0, "a", "ü", 1, 1, 0, 1, 2),), parts=(manifests.LogPart("p", 1, 2, 3, 4),))
    assert manifests.Manifest.from_json(m.to_json()) == m
    with pytest.raises(ValueError):
        manifests.Manifest.from_json('{"version": 99}')


def test_key_ranges():
    a, b, c = (manifests.Segment("f", 0, x, y, 1, 1, 0, 1, 2) for x, y in (("a", "c"), ("d", "f"), ("g", "i")))
    probe = manifests.Segment("p", 0, "b", "e", 1, 1, 0, 1, 2)
    assert [s.overlaps(probe) for s in (a, b, c)] == [True, True, False]
    assert [s.may_hold_prefix("d") for s in (a, b, c)] == [False, True, False]
    assert manifests.Segment("f", 0, "da", "dz", 1, 1, 0, 1, 2).may_hold_prefix("d")
    assert b.may_hold_key("e") and not b.may_hold_key("g")
    assert manifests.Segment("f", 0, "a", "b", 1, 1, 5, 1, 2).all_expired(6)


def test_follower(spark, tmp_path):
    leader = KVStore(spark, str(tmp_path / "leader"))
    leader.batch_set([("a", "1"), ("b", "1"), ("t", "1", NOW + 3)], now=NOW)
    leader.flush()
    follower = Follower(spark, leader.path, str(tmp_path / "f"))
    follower.bootstrap()
    leader.delete("a", NOW)
    leader.set("a", "again", now=NOW)
    leader.delete("b", NOW)
    follower.catch_up()
    assert {r.key: r.value for r in follower.live(NOW).collect()} == {"a": "again", "t": "1"}
    assert {r.key: r.value for r in follower.live(NOW + 4).collect()} == {"a": "again"}
    assert follower.lag().first().behind == 0
    with pytest.raises(ReadOnlyError):
        follower.store.set("x", "y", now=NOW)
    assert follower.promote() == (True, "promoted")
    assert follower.promote()[0] is False
    follower.store.set("x", "y", now=NOW)
    assert follower.store.get("x", NOW) == "y"


def test_a_gap_asks_for_a_snapshot(spark, tmp_path):
    leader = KVStore(spark, str(tmp_path / "leader"))
    leader.set("a", "1", now=NOW)
    leader.flush()
    leader.retain(NOW, most_age=10**12, most_bytes=0)
    leader.set("b", "1", now=NOW)
    follower = Follower(spark, leader.path, str(tmp_path / "f"))
    with pytest.raises(SnapshotRequired):
        follower.catch_up()
    offer = follower.source.request_snapshot(follower.store.manifest.followed)
    assert offer.required and offer.resume == leader.manifest.retired
    assert [r.key for f in offer.files for r in follower.source.read_snapshot(f).collect()] == ["a"]
    for name in ("../x", "MANIFEST.json"):
        with pytest.raises(InvalidArgument):
            follower.source.read_snapshot(name)
    follower.bootstrap()
    follower.catch_up()
    assert {r.key for r in follower.live(NOW).collect()} == {"a", "b"}


def test_workload_and_command_line(spark, tmp_path):
    sets = workload.random_sets(spark, 50, 10, 8, seed=3)
    assert sorted(map(tuple, sets.collect())) == sorted(map(tuple, workload.random_sets(spark, 50, 10, 8, seed=3).collect()))
    assert all(1 <= int(r.key) <= 10 and len(r.value) == 8 for r in sets.collect())
    run = lambda *a: cli.run(cli.parser().parse_args(["--path", str(tmp_path / "c"), *a]), spark)
    assert run("set", "user:1", "v") is True
    assert run("get", "user:1") == "v"
    assert run("count", "user:") == 1
    assert run("set", "user:1", "w", "--if-not-exists") is False
    assert run("random-set", "--count", "30")["succeeded"] == 30
    assert run("random-set", "--count", "3", "--each", "--ttl", "9")["p99_s"] > 0
    assert run("random-get", "--count", "2", "--each", "--keys", "1000000")["succeeded"] == 0
    assert run("batch-get", "--count", "30")["total"] == 30
    cas = run("random-cas", "--count", "20")
    assert cas["succeeded"] + cas["conflicts"] == 20
    assert run("batch-delete", "--count", "10")["succeeded"] == 10
    assert run("set", "user:1", "w", "--expect", "v") == {"success": True, "current_value": "v"}
    run("flush")
    run("compact", "--stale-only")
    assert run("metrics", "--json")["segment_count"] >= 1
    assert "Compaction" in run("metrics")


KEYS = st.sampled_from(["a", "b", "ab", "日"])
STEPS = st.one_of(
    st.tuples(st.just("set"), KEYS, st.sampled_from(["", "1", "2"]), st.sampled_from([0, NOW - 1, NOW, NOW + 1])),
    st.tuples(st.just("delete"), KEYS), st.tuples(st.just("cas"), KEYS, st.sampled_from([None, "1", "2"]), st.sampled_from(["1", "2"])),
    st.tuples(st.just("flush")), st.tuples(st.just("compact"), st.sampled_from([0, 1])),
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(STEPS, min_size=4, max_size=8))
def test_store_equals_a_dictionary(spark, tmp_path_factory, steps):
    store, model = KVStore(spark, str(tmp_path_factory.mktemp("h"))), {}
    seq = 0
    for kind, *rest in steps:
        if kind == "set":
            seq += 1
            store._append([(rest[0], rest[1], rest[2])], NOW)
            model[rest[0]] = (rest[1], rest[2])
        elif kind == "delete":
            store.delete(rest[0], NOW)
            model.pop(rest[0], None)
        elif kind == "cas":
            v, until = model.get(rest[0], (None, 0))
            current = None if until and NOW > until else v
            assert store.compare_and_set(rest[0], rest[1], rest[2], now=NOW) == (current == rest[1], current)
            if current == rest[1]:
                model[rest[0]] = (rest[2], 0)
        elif kind == "flush":
            store.flush()
        else:
            store.compact(rest[0], NOW)
    assert live(store) == {k: v for k, (v, until) in model.items() if not until or NOW <= until}


def test_a_write_compacts_at_its_own_time(spark, tmp_path):
    store = KVStore(spark, str(tmp_path / "s"), memory_bytes=1)
    for i in range(5):  # every write flushes, the fourth compacts
        store.set(f"t{i}", "1", ttl_seconds=10, now=NOW)
    assert store.counters["compaction_count"] > 0
    assert set(live(store)) == {f"t{i}" for i in range(5)}
    rows = KVStore(spark, str(tmp_path / "r"), memory_bytes=1)
    for i in range(5):
        rows.ingest(spark.createDataFrame([(i + 1, NOW, f"t{i}", "1", NOW + 10)], KV_LOG), NOW)
    assert rows.counters["compaction_count"] > 0
    assert set(live(rows)) == {f"t{i}" for i in range(5)}


def test_a_follower_takes_older_rows_after_it_compacted(spark, tmp_path):
    leader = KVStore(spark, str(tmp_path / "leader"))
    follower = Follower(spark, leader.path, str(tmp_path / "f"))
    follower.store.memory_bytes = 1
    for i in range(6, 0, -1):  # newest first; every batch flushes, the fourth compacts
        follower._apply(spark.createDataFrame([(i, NOW, f"k{i}", "1", 0), (i + 10, NOW, "d", None if i == 6 else "1", 0)], KV_LOG), 0)
    assert follower.store.counters["compaction_count"] > 0
    assert live(follower) == {f"k{i}": "1" for i in range(1, 7)}  # d's deletion is its newest version
    follower.promote()
    assert follower.store.collects


def rows(spark, *entries):
    return spark.createDataFrame([(seq, NOW, k, v, 0) for seq, k, v in entries], KV_LOG)


def test_a_deletion_stays_while_an_upper_level_has_older_entries(spark, store):
    store.collects = False
    store.ingest(rows(spark, (100, "k", None), (101, "z", "1")), NOW)
    store.flush()
    store.compact(0, NOW)
    store.ingest(rows(spark, (50, "k", "v")), NOW)
    store.flush()
    store.collects = True
    store.compact(1, NOW)  # merges the deletion downwards; level 0 has the older entry
    assert live(store) == {"z": "1"}
    store.compact(0, NOW)
    assert live(store) == {"z": "1"}


LATE = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from([None, "1", "2"]), st.sampled_from(["flush", "compact0", "compact1", "stale", "all", ""])), min_size=4, max_size=9)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(LATE, st.randoms(use_true_random=False))
def test_order_is_by_seq_whatever_comes_when(spark, tmp_path_factory, entries, rng):
    """Entries come in any order of seq, with compactions in between; what is refused was collected."""
    store, model = KVStore(spark, str(tmp_path_factory.mktemp("late"))), {}
    seqs = list(range(1, len(entries) + 1))
    rng.shuffle(seqs)
    for seq, (k, v, then) in zip(seqs, entries, strict=True):
        try:
            store.ingest(rows(spark, (seq, k, v)), NOW)
        except InvalidArgument:
            assert seq <= store.manifest.gc_seq
        else:
            if seq > model.get(k, (0, None))[0]:
                model[k] = (seq, v)
        if then == "flush":
            store.flush()
        elif then == "all":
            store.compact_all(NOW)
        elif then:
            store.flush()
            store.compact(int(then[-1]) if then[-1].isdigit() else 0, NOW, stale_only=then == "stale")
    assert live(store) == {k: v for k, (_, v) in model.items() if v is not None}


@pytest.mark.parametrize("bound", [1, 1000, 4 << 20])
def test_results_do_not_depend_on_the_bound(spark, tmp_path, bound):
    store = KVStore(spark, str(tmp_path / "s"), memory_bytes=bound)
    for i in range(6):
        store.batch_set([("same", str(i)), (f"t{i}", "v", NOW + 1 + i)], NOW)
    store.delete("t0", NOW)
    assert live(store) == {"same": "5"} | {f"t{i}": "v" for i in range(1, 6)}


def test_batches_as_frames(spark, store):
    store.set("k", "v", now=NOW)
    items = spark.createDataFrame([(0, "k", "late", NOW - 1), (1, "a", "1", 0), (2, "a", "2", NOW + 1)], "pos bigint, key string, value string, expire_at bigint")
    assert store.batch_set_frame(items, NOW) == 3
    assert live(store) == {"k": "v", "a": "2"}
    for bad in ([0, 0], [0, 2], [1, 2]):
        with pytest.raises(InvalidArgument, match="positions"):
            store.batch_set_frame(spark.createDataFrame([(p, "x", "y") for p in bad], "pos bigint, key string, value string"), NOW)
    assert store.batch_set_frame(items.where("pos < 0"), NOW) == 0
    assert store.metrics()["batch_set_count"] == 3
    assert sorted(map(tuple, store.get_expire_at_frame(items.select("pos", "key"), NOW).collect())) == [(0, "k", True, 0), (1, "a", True, NOW + 1), (2, "a", True, NOW + 1)]


def test_stale_runs_are_merged_on_recovery(spark, store):
    for i in range(3):
        store.set("k", str(i), now=NOW)
        store.flush()
    store.recover(NOW)
    assert sorted(s.level for s in store.manifest.segments) == [0, 0, 1]
    assert live(store) == {"k": "2"}
    store.recover(NOW)
    assert store.metrics()["compaction_count"] == 1


def test_a_segment_of_expired_rows_is_left_out(spark, store):
    store.batch_set([("a", "1", NOW + 1), ("b", "1", NOW + 2)], NOW)
    store.flush()
    store.set("c", "1", now=NOW)
    store.flush()
    assert store.count("", NOW + 9) == 1
    assert store.metrics()["segments_pruned"] == 1
    store.set("a", "2", now=NOW + 9)
    assert store.get("a", NOW + 9) == "2"
    store.flush()
    store.compact(0, NOW + 9)
    assert sorted((s.entry_count, s.min_seq) for s in store.manifest.segments) == [(2, 3)]
    older = KVStore(spark, f"{store.path}-2")
    older.ingest(rows(spark, (1, "a", "old")), NOW)
    older.flush()
    older.ingest(spark.createDataFrame([(2, NOW, "a", "timed", NOW + 1)], KV_LOG), NOW)
    older.flush()
    assert older.count("", NOW + 9) == 0  # the expired entry hides an older one, so it must be read


def test_a_snapshot_serves_reads_within_its_bound(spark, tmp_path):
    store = KVStore(spark, str(tmp_path / "s"))
    store.set("a", "1", now=NOW)
    store.snapshot()
    assert store.get("a", NOW) == "1" and store.count("", NOW) == 1 and store.batch_get(["a"], NOW) == [("a", "1")]
    m = store.metrics()
    assert (m["cache_hits"], m["cache_misses"], m["cache_entries"], m["cache_evictions"]) == (3, 1, 1, 0)
    assert 0 < m["cache_size_bytes"] <= m["cache_max_size_bytes"]
    store.delete("a", NOW)
    assert store.metrics()["cache_evictions"] == 1
    small = KVStore(spark, store.path, cache_bytes=1)
    small.snapshot()
    assert small.metrics()["cache_entries"] == 0


def test_bootstrap_keeps_late_entries_of_open_log(spark, tmp_path):
    leader = KVStore(spark, str(tmp_path / "leader"))
    leader.ingest(rows(spark, (10, "a", "1"), (20, "b", "1")), NOW)
    leader.flush()
    leader.ingest(rows(spark, (5, "c", "1")), NOW)
    follower = Follower(spark, leader.path, str(tmp_path / "f"))
    follower.bootstrap()
    follower.catch_up()
    assert live(follower) == live(leader) == {"a": "1", "b": "1", "c": "1"}


def test_a_follower_heals_a_gap(spark, tmp_path):
    leader = KVStore(spark, str(tmp_path / "leader"))
    leader.batch_set([("a", "1"), ("b", "1")], NOW)
    follower = Follower(spark, leader.path, str(tmp_path / "f"))
    assert follower.sync() is False
    leader.delete("a", NOW)
    leader.set("c", "1", now=NOW)
    leader.compact_all(NOW)
    leader.retain(NOW, most_age=10**12, most_bytes=0)
    leader.gc(grace=0)
    leader.set("d", "1", now=NOW)
    assert follower.gap()
    assert follower.sync() is True
    assert live(follower) == live(leader) == {"b": "1", "c": "1", "d": "1"}
    again = Follower(spark, leader.path, follower.store.path)  # resumes from the manifest
    leader.set("e", "1", now=NOW)
    assert again.sync() is False
    follower.reload()
    assert live(follower) == live(leader)


def test_what_a_crashed_writer_left_is_not_applied(spark, tmp_path, monkeypatch):
    leader = KVStore(spark, str(tmp_path / "leader"))
    leader.set("a", "1", now=NOW)
    follower = Follower(spark, leader.path, str(tmp_path / "f"))

    def crash(*_):
        raise OSError("crash")

    with monkeypatch.context() as m:
        m.setattr(manifests, "save", crash)
        with pytest.raises(OSError):
            leader.set("x", "lost", now=NOW)
    leader = KVStore(spark, leader.path)
    leader.set("b", "1", now=NOW)  # under the number and the seq of what was lost
    follower.sync()
    assert live(follower) == live(leader) == {"a": "1", "b": "1"}


def test_following_in_the_background(spark, tmp_path):
    leader = KVStore(spark, str(tmp_path / "leader"))
    leader.set("a", "1", now=NOW)
    follower = Follower(spark, leader.path, str(tmp_path / "f"))
    run = follower.follow(0.1)
    assert run.wait_for(1, 60)
    leader.delete("a", NOW)
    leader.set("b", "1", now=NOW)
    leader.compact_all(NOW)
    leader.retain(NOW, most_age=10**12, most_bytes=0)
    assert run.wait_for(run.rounds + 2, 60) and run.error is None and run.running
    assert live(follower) == {"b": "1"}
    follower.stop()
    assert not run.running
    assert follower.promote(enable_service=True) == (True, "promoted")
    assert follower.service.info()[1] == follower.store.manifest.last_seq
