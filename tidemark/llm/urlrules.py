"""URL allow and block rules by a sort-merge range join.

A host is turned into its reversed canonical key (``blog.example.org`` -> ``org.example.blog.``), so that a domain and all
its subdomains are one interval of keys. Urls are sorted by that key and swept once against the sorted rules; a stack
holds the rules whose interval contains the current key. Intervals nest or are disjoint, so a pop is final. Each stack
entry carries the sorted path prefixes of one rule host; the deepest one that starts the url's path is found by probing
the prefix lengths present.

The rule that fits with the longest ``host/path`` wins. Rules that occur twice count once; of an allow and a block for
the same prefix, block wins. A url that no rule fits gets the default verdict. Null urls and urls without ``://`` have an
empty host and path and fit only a rule for the empty host. Repeated rows each get a verdict; an empty table gives none.

The urls never move: each partition sorts what it has and sweeps it. The rules go to every task in chunks of at most
``RULES_PER_PASS``; a larger rule table takes one map-only pass per chunk, each improving on the pass before.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, table

RULES_PER_PASS = 100_000
ROWS_PER_SWEEP = 200_000
DEFAULT = "allow"

# The rules of the registered query.
QUERY_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


class Rule(NamedTuple):
    key: str  # reversed host, each label with a dot behind it
    path: str
    text: str
    verdict: str


def reversed_host(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split("."))) if host else ""


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    if verdict not in ("allow", "block"):
        raise ValueError(f"unknown verdict {verdict!r}")
    return Rule(reversed_host(_lower(host)), slash + path, text, verdict)


def _lower(s: str) -> str:
    return s.translate(_AZ)


_AZ = {c: c + 32 for c in range(65, 91)}


def compile_rules(rules: Iterable[tuple[str, str]]) -> list[tuple[str, dict[str, tuple[str, str]], list[int]]]:
    """Sorted (key, {path prefix: (text, verdict)}, prefix lengths, longest first): one entry per rule host."""
    hosts: dict[str, dict[str, tuple[str, str]]] = {}
    for verdict, text in rules:
        r = parse_rule(verdict, text)
        paths = hosts.setdefault(r.key, {})
        if paths.get(r.path, ("", "allow"))[1] != "block":
            paths[r.path] = (r.text, r.verdict)
    return [(k, paths, sorted({len(p) for p in paths}, reverse=True)) for k, paths in sorted(hosts.items())]


def sweep(keys: list[str], paths: list[str], compiled: list) -> list[tuple[str, str] | None]:
    """(rule text, verdict) for each url, by one pass over the urls and the rules in key order."""
    out: list[tuple[str, str] | None] = [None] * len(keys)
    if not compiled:
        return out
    starts = [c[0] for c in compiled]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    stack: list = []
    # Start at the ancestors of the first key: a partition may begin inside open intervals.
    at, first = 0, keys[order[0]] if order else ""
    while (cut := first.find(".", at)) >= 0:
        i = bisect_left(starts, first[: cut + 1])
        if i < len(starts) and starts[i] == first[: cut + 1]:
            stack.append(compiled[i])
        at = cut + 1
    if starts and starts[0] == "":
        stack.insert(0, compiled[0])
    nxt = bisect_left(starts, first)
    if nxt < len(starts) and starts[nxt] == first:
        nxt += 1  # it is on the stack
    for u in order:
        key, path = keys[u], paths[u]
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        while nxt < len(starts) and starts[nxt] <= key:
            if key.startswith(starts[nxt]):
                stack.append(compiled[nxt])
            nxt += 1
        best = None
        for host, prefixes, lengths in reversed(stack):
            if host == "" and key:  # a rule for the empty host has no subdomains
                continue
            for n in lengths:
                if n <= len(path) and (hit := prefixes.get(path[:n])):
                    if best is None or len(hit[0]) > len(best[0]):
                        best = hit
                    break
        out[u] = best
    return out


def split_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path): the text after the first ``://``, cut at ``/``, ``?`` and ``#``; A-Z of the host lower-cased."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    bare = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(bare, r"(?s)^([^/]*)", 1)
    return (
        pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
        .select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(bare, F.lit("")).alias("bare"))
        .select(
            "page_id",
            F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
            F.expr("substring(bare, length(host) + 1)").alias("path"),
        )
    )


def _pass(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS_PER_SWEEP:
                yield swept(held)
                held, rows = [], 0
        if rows:
            yield swept(held)

    def swept(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        hosts, paths, rule, verdict = (t.column(k).to_pylist() for k in ("host", "path", "rule", "verdict"))
        found = sweep([reversed_host(h) for h in hosts], paths, sent.value)
        for i, hit in enumerate(found):
            if hit and (rule[i] is None or len(hit[0]) > len(rule[i]) or (hit[0] == rule[i] and hit[1] == "block")):
                rule[i], verdict[i] = hit
        return pa.RecordBatch.from_arrays(
            [t.column("page_id").combine_chunks(), t.column("host").combine_chunks(), t.column("path").combine_chunks(), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
            names=["page_id", "host", "path", "rule", "verdict"],
        )

    return run


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame, default: str = DEFAULT, per_pass: int = RULES_PER_PASS) -> DataFrame:
    """Every url with the longest rule that fits it, and that rule's verdict or the default. Rules may be a frame (verdict, text): they
    come to the driver a chunk at a time, and each chunk of ``per_pass`` is broadcast for a pass without a shuffle."""
    spark = ship(pages.sparkSession)
    urls = split_urls(pages).select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    if isinstance(rules, DataFrame):
        rules = ((r.verdict, r.text) for r in rules.select("verdict", "text").toLocalIterator())
    chunk: list[tuple[str, str]] = []
    for rule in rules:
        chunk.append(rule)
        if len(chunk) == per_pass:
            urls = urls.mapInArrow(_pass(spark.sparkContext.broadcast(compile_rules(chunk))), urls.schema)
            chunk = []
    if chunk:
        urls = urls.mapInArrow(_pass(spark.sparkContext.broadcast(compile_rules(chunk))), urls.schema)
    return urls.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), QUERY_RULES)


def oracle() -> str:
    rules = ", ".join(f"('{v}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}', '{t}')" for v, t in QUERY_RULES)
    return f"""
WITH r(verdict, rhost, rpath, rule) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS bare FROM u),
h AS (SELECT page_id, regexp_extract(bare, '^[^/]*') AS raw, bare FROM b),
p AS (SELECT page_id, lower(raw) AS host, substr(bare, length(raw) + 1) AS path FROM h),
j AS (SELECT p.*, r.rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM j WHERE k = 1"""
