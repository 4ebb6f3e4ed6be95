"""Visibility, reads and mutations on small literals."""

import pytest

from tidemark.functions import scalars, visibility
from tidemark.operators import maintenance, mutate, reads
from tidemark.schema import CAS_OP, KV_LOG, InvalidArgument

NOW = 1000


def log(spark, *rows):
    return spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], KV_LOG)


def live(df):
    return {r.key: r.value for r in visibility.live(df, NOW).collect()}


def test_newest_version_wins_and_tombstones_hide(spark):
    assert live(log(spark, ("a", "1", 0), ("b", "1", 0), ("a", "2", 0), ("b", None, 0))) == {"a": "2"}


def test_expired_newest_version_does_not_bring_back_an_older_one(spark):
    assert live(log(spark, ("a", "old", 0), ("a", "new", NOW - 1))) == {}


def test_row_is_visible_at_its_expiry(spark):
    assert live(log(spark, ("a", "x", NOW), ("b", "y", NOW - 1), ("c", "z", NOW + 1))) == {"a": "x", "c": "z"}


def test_inclusive_expiry_for_replay(spark):
    rows = log(spark, ("a", "x", NOW))
    assert rows.where(visibility.expired(NOW, inclusive=True)).count() == 1
    assert rows.where(visibility.expired(NOW)).count() == 0


def test_empty_key_and_value_and_unicode_are_values(spark):
    assert live(log(spark, ("", "v", 0), ("k", "", 0), ("日本語キー", "値🎉", 0))) == {"": "v", "k": "", "日本語キー": "値🎉"}


def test_set_clears_time_to_live(spark):
    assert live(log(spark, ("a", "x", NOW - 5), ("a", "y", 0))) == {"a": "y"}


def test_batch_get_orders_and_duplicates(spark):
    rows = log(spark, ("a", "1", 0), ("b", "2", 0), ("c", "3", 0))
    asked = spark.createDataFrame(list(enumerate(["c", "a", "nonexistent", "b", "a"])), "pos bigint, key string")
    found = sorted((r.pos, r.key, r.value) for r in reads.batch_get(rows, asked, NOW).collect())
    assert found == [(0, "c", "3"), (1, "a", "1"), (3, "b", "2"), (4, "a", "1")]
    assert sorted(r.key for r in reads.batch_get(rows, asked, NOW, ordered=False).collect()) == ["a", "b", "c"]


def test_long_request_lists_are_joined_by_shuffle(spark, monkeypatch):
    rows = log(spark, *[(f"k{i}", str(i), 0) for i in range(20)])
    asked = spark.createDataFrame([(i, f"k{i % 30}") for i in range(40)], "pos bigint, key string")
    few = sorted(map(tuple, reads.batch_get(rows, asked, NOW).collect()))
    assert reads.is_small(asked)
    monkeypatch.setattr(reads, "BROADCAST_KEYS", 39)
    assert not reads.is_small(asked)
    many = reads.batch_get(rows, asked, NOW)
    assert sorted(map(tuple, many.collect())) == few and len(few) == 30
    monkeypatch.setattr(reads, "BROADCAST_KEYS", 100)
    monkeypatch.setattr(reads, "BROADCAST_BYTES", 10)
    assert not reads.is_small(asked)


def test_counts_hash_instead_of_sorting(spark):
    plan = reads.count_prefix(log(spark, ("a", "1", 0)), "", NOW)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_index_prefixes_cross_groups(spark):
    keys = ["a", "aaaaaaaaab", "aaaaaaaabb", "aaaaaaab", "ab", "b", "bb"]
    got = {r.key: r.shared for r in maintenance.index_prefixes(spark.createDataFrame([(k,) for k in keys], "key string"), restart=4, lead=8).collect()}
    assert got == {"a": 0, "aaaaaaaaab": 1, "aaaaaaaabb": 8, "aaaaaaab": 7, "ab": 0, "b": 0, "bb": 1}


def test_prefixes_are_literal(spark):
    rows = log(spark, ("user:1", "x", 0), ("user_1", "x", 0), ("user%", "x", 0))
    assert {r.prefix: r.n for r in reads.count_prefixes(rows, ["user_", "user%", "user", "none"], NOW).collect()} == {"user_": 1, "user%": 1, "user": 3, "none": 0}


def cas(spark, ops, base=None):
    folded = mutate.cas_fold(spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], CAS_OP), base, NOW)
    return [(r.success, r.current_value) for r in mutate.cas_results(folded).orderBy("seq").collect()]


def test_cas_truth_table(spark):
    ops = [("k", None, "a", 0), ("k", None, "b", 0), ("k", "a", "c", 0), ("k", "a", "d", 0), ("m", "x", "y", 0)]
    assert cas(spark, ops) == [(True, None), (False, "a"), (True, "a"), (False, "c"), (False, None)]


def test_cas_starts_from_the_live_state(spark):
    base = log(spark, ("a", "1", 0), ("b", "1", NOW - 1), ("c", "1", 0), ("c", None, 0))
    assert cas(spark, [("a", "1", "2", 0), ("b", None, "2", 0), ("c", None, "2", 0)], base) == [(True, "1"), (True, None), (True, None)]


def test_cas_that_writes_a_past_expiry_leaves_nothing(spark):
    assert cas(spark, [("a", None, "1", NOW - 1), ("a", None, "2", 0)]) == [(True, None), (True, None)]


def test_merge_keeps_tombstones_above_the_bottom(spark):
    rows = log(spark, ("a", "1", 0), ("b", "1", 0), ("c", "1", 0), ("b", None, 0), ("c", "2", NOW - 1))
    assert sorted(r.key for r in maintenance.merge(rows, NOW, bottom=True).collect()) == ["a"]
    assert sorted(r.key for r in maintenance.merge(rows, NOW, bottom=False).collect()) == ["a", "b", "c"]


def test_replay_is_idempotent(spark):
    rows = log(spark, ("a", "1", 0), ("a", "2", 0), ("b", "1", 0), ("b", None, 0))
    base = visibility.snapshot(rows, 1)
    once = sorted(map(tuple, maintenance.replay(base, rows, 1).collect()))
    assert sorted(map(tuple, maintenance.replay(base, rows.unionAll(rows), -1).collect())) == once == sorted(map(tuple, visibility.snapshot(rows).collect()))


def test_stream_batches_cross_ranges(spark):
    rows = log(spark, *[("k", "v", 0)] * 25)
    got = sorted(tuple(r) for r in maintenance.stream_batches(rows, 10, part_rows=4).collect())
    assert got == [(0, 10, 0, 9), (1, 10, 10, 19), (2, 5, 20, 24)]


def test_entry_bytes(spark):
    rows = log(spark, ("key1", "value1", 0), ("key1", None, 0))
    assert [r[0] for r in rows.select(scalars.entry_bytes()).collect()] == [42, 36]


def test_key_helpers(spark):
    r = spark.createDataFrame([("user:é", "user:x")], "key string, other string").select(
        scalars.hex_key().alias("hex"), scalars.checksum("key").alias("crc"), scalars.common_prefix_length("key", "other").alias("shared")
    ).withColumn("back", scalars.unhex_key("hex")).first()
    import zlib

    assert (r.hex, r.crc, r.shared, r.back) == ("user:é".encode().hex(), zlib.crc32("user:é".encode()), 5, "user:é")


@pytest.mark.parametrize(("text", "size"), [("1KiB", 1024), ("1.5KiB", 1536), ("4 MiB", 4 << 20), ("1K", 1024), ("2gb", 2 << 30), ("12", 12), ("12B", 12), ("1TiB", 1 << 40)])
def test_sizes(text, size):
    assert scalars.parse_size(text) == size


@pytest.mark.parametrize("text", ["", "abc", "1PiB", "-1", "1.2.3"])
def test_bad_sizes(text):
    with pytest.raises(InvalidArgument):
        scalars.parse_size(text)


def test_log_numbers():
    assert scalars.parse_log_number("wal_00012.log") == 12
    assert scalars.parse_log_number("wal_x.log") is None


def test_empty_log(spark):
    rows = spark.createDataFrame([], KV_LOG)
    assert live(rows) == {}
    assert reads.count_prefix(rows, "", NOW).first().n == 0
    assert maintenance.stream_batches(rows, 10).count() == 0
