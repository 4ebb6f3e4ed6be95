"""Every registered query of the library against its SQL, over the small tables."""

import duckdb
import pytest

from tidemark.plans import catalog
from tidemark.plans.fixtures import NOW, log_now
from tidemark.store import KVStore

DATA = "/root/testdata/sf0.001"
TABLES = "customer events documents lineitem orders".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(rounded(row[names.index(c)]) for c in columns) for row in cursor.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_pushdown_reaches_the_scan(spark, tmp_path):
    """A prefix count reads two columns' worth and pushes the prefix below the aggregate."""
    from tidemark.operators import reads
    from tidemark.plans.fixtures import NOW, log_now

    path = str(tmp_path / "log")
    log_now(spark, DATA).write.parquet(path)
    plan = reads.count_prefix(spark.read.parquet(path), "user:0000", NOW)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,user:0000)" in plan
    assert "ts:" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_deletions_win_over_any_seq(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (event_id + 24000000 AS event_id) FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("kv_delete_effect", "kv_batch_set_result"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(theirs, key=repr)


@pytest.fixture(scope="module")
def long_log(tmp_path_factory):
    """A log whose parts are larger than what a store flushes by itself."""
    folder, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (props || repeat('x', 40000) AS props) FROM '{DATA}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), con


def equal_to_sql(spark, long_log, name):
    folder, con = long_log
    df = catalog.QUERIES[name](spark, folder)
    theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr) == sorted(theirs, key=repr)


def test_snapshot_of_a_long_log(spark, long_log):
    assert equal_to_sql(spark, long_log, "kv_follower_snapshot")


def test_giving_up_a_long_log(spark, long_log):
    """The last part is open, so it isn't given up and its files stay."""
    assert equal_to_sql(spark, long_log, "kv_store_retained")


@pytest.mark.parametrize("name", ("kv_follower_snapshot", "kv_store_expired_segment", "kv_store_metrics", "kv_store_segments"))
def test_runs_of_several_files(spark, long_log, monkeypatch, name):
    """A flush makes several files of a large run; it's one segment all the same."""
    monkeypatch.setattr("tidemark.store.FILE_BYTES", 3_000)
    assert equal_to_sql(spark, long_log, name)


@pytest.mark.parametrize("name", ("kv_store_batch_delete", "kv_store_delete"))
def test_profiles_share_what_they_store(spark, monkeypatch, name):
    """The log is taken once for all profiles."""
    taken, ingest = [], KVStore.ingest

    def counted(self, rows, now=None):
        ingest(self, rows, now)
        taken.append(self.manifest.parts[-1].rows)

    monkeypatch.setattr(KVStore, "ingest", counted)
    catalog.QUERIES[name](spark, DATA)
    whole = log_now(spark, DATA).count()
    assert whole <= sum(taken) < 2 * whole


def test_profiles_store_the_same(spark, tmp_path):
    def stored(profile):
        store = KVStore(spark, str(tmp_path / profile), profile, memory_bytes=1000)
        store.ingest(log_now(spark, DATA), NOW)
        store.set("x", "1", now=NOW)
        return [(s.level, s.min_key, s.max_key, s.entry_count, s.max_expire_at, s.max_seq) for s in store.manifest.segments], sorted(store.rows().collect())

    assert stored("btree") == stored("log") == stored("lsm") == stored("memory")
