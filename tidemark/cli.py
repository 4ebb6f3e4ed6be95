"""Command line over a store folder: python -m tidemark.cli --path FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import workload
from tidemark.functions.scalars import parse_size
from tidemark.schema import PROFILES, KeyNotFound, StoreError
from tidemark.store import RETENTION_BYTES, RETENTION_SECONDS, KVStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--path", required=True)
    p.add_argument("--engine", choices=sorted(PROFILES), default="lsm")
    p.add_argument("--memory", type=parse_size, default=4 << 20, help="size at which open parts are flushed, as 4MiB")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("set")
    c.add_argument("key")
    c.add_argument("value")
    c.add_argument("--ttl", type=int, default=0)
    c.add_argument("--if-not-exists", action="store_true")
    c.add_argument("--if-match")
    c.add_argument("--expect", help="as --if-match, and tells the value that is there")
    for name in ("get", "get-expire-at", "delete"):
        sub.add_parser(name).add_argument("key")
    sub.add_parser("count").add_argument("prefix")
    sub.add_parser("metrics").add_argument("--json", action="store_true")
    for name in ("random-set", "random-get", "random-cas", "batch-set", "batch-get", "batch-delete"):
        c = sub.add_parser(name)
        c.add_argument("--count", type=int, default=1000)
        c.add_argument("--keys", type=int, default=100)
        c.add_argument("--value-size", type=int, default=20)
        c.add_argument("--duplicate-rate", type=float, default=0.0)
        c.add_argument("--seed", type=int, default=0)
        c.add_argument("--ttl", type=int, default=0)
        c.add_argument("--each", action="store_true", help="one call per item, with the time of each, in place of one bulk call")
    sub.add_parser("flush")
    c = sub.add_parser("compact")
    c.add_argument("--level", type=int, default=0)
    c.add_argument("--stale-only", action="store_true")
    c = sub.add_parser("retain")
    c.add_argument("--age", type=int, default=RETENTION_SECONDS)
    c.add_argument("--size", type=parse_size, default=RETENTION_BYTES)
    sub.add_parser("gc")
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> object:
    store = KVStore(spark, args.path, args.engine, memory_bytes=args.memory)
    now = int(time.time())
    store.recover(now)
    match args.command:
        case "set":
            if args.expect is not None:
                return dict(zip(("success", "current_value"), store.rpc_compare_and_set(args.key, args.expect, args.value, True, args.ttl, now), strict=True))
            return store.set(args.key, args.value, args.ttl, now, args.if_not_exists, args.if_match)
        case "get":
            return store.get(args.key, now)
        case "get-expire-at":
            return store.get_expire_at(args.key, now)
        case "delete":
            return store.delete(args.key, now)
        case "count":
            return store.rpc_count(args.prefix, now)
        case "metrics":
            return store.metrics() if args.json else store.report()
        case "random-set" | "batch-set":
            items = workload.random_sets(spark, args.count, args.keys, args.value_size, args.seed)
            until = now + args.ttl if args.ttl else 0
            if args.each:
                return workload.each(items, lambda r: store.set(r.key, r.value, args.ttl, now))
            return workload.timed(lambda: store.batch_set_frame(items.withColumn("expire_at", F.lit(until)), now), args.count)
        case "random-get" | "batch-get":
            asked = workload.random_gets(spark, args.count, args.keys, args.duplicate_rate, args.seed)
            if args.each:
                return workload.each(asked, lambda r: store.get_expire_at(r.key, now)[0])
            return workload.timed(lambda: store.batch_get_frame(asked, now).count(), args.count)
        case "random-cas":
            ops = workload.random_cas(spark, args.count, args.keys, store.manifest.last_seq + 1, args.seed)
            out = workload.timed(lambda: store.compare_and_set_batch(ops, now).where("success").count(), args.count)
            return out | {"conflicts": args.count - out["succeeded"], "conflict_rate": (args.count - out["succeeded"]) / max(1, args.count)}
        case "batch-delete":
            asked = workload.random_gets(spark, args.count, args.keys, args.duplicate_rate, args.seed)
            return workload.timed(lambda: store.batch_delete_frame(asked, now), args.count)
        case "flush":
            return store.flush()
        case "compact":
            return store.compact(args.level, now, args.stale_only)
        case "retain":
            return store.retain(now, args.age, args.size)
        case "gc":
            return store.gc(now)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        out = run(args, spark)
    except KeyNotFound as e:
        print(e, file=sys.stderr)
        return 1
    except StoreError as e:
        print(e, file=sys.stderr)
        return 2
    print(json.dumps(out, ensure_ascii=False) if not isinstance(out, str) else out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
