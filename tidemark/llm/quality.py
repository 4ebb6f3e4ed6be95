"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger row holds the measurements and one bit per failed rule;
policies are versioned masks applied later, and ablations are bitwise aggregates over the ledger alone.

Defined cases: a null text has no words (it fails ``few_words``); an empty table gives an empty ledger; repeated rows
each get their own ledger row; a null doc_id is carried; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, ship, table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_bangs", "n_stutters")
LEDGER = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


# The order is the bit; bits are never reused, so that old ledgers stay readable.
RULES = tuple(
    Rule(i, name, fails)
    for i, (name, fails) in enumerate(
        (
            ("few_words", "n_words < 20"),
            ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
            ("symbols", "10 * n_symbols > n_words"),
            ("short_words", "word_chars < 2 * n_words"),
            ("long_words", "word_chars > 14 * n_words"),
            ("repeated_lines", "2 * n_dup_lines > n_lines"),
            ("shouting", "n_upper > n_lower"),
            ("bangs", "5 * n_bangs > n_words"),
            ("stutter", "2 * n_stutters > n_words"),
        )
    )
)
BASE = ("few_words", "repeated_windows")

# Versioned policies: the rules that reject a document.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "short_words", "long_words", "repeated_lines", "shouting", "bangs", "stutter"),
}
CURRENT = "v1"


def mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    known = {r.name: r.bit for r in RULES}
    return sum(1 << known[n] for n in set(names))


_ODD = np.random.default_rng(20240115).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in an 8-word window found twice or more, the first find included. Windows meet by hash, and are compared."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        rolled += mixed[j : j + n] * _ODD[j]
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    a, b = order[1:][same], order[:-1][same]
    again = np.zeros(n, bool)
    if (windows[a] == windows[b]).all():
        again[a] = again[b] = True
    else:  # different windows share a hash
        _, slot, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        again = times[slot.ravel()] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def cases(text: str) -> tuple[int, int]:
    """How many characters are capital letters (Lu), and small ones (Ll)."""
    if text.isascii():
        return len(text) - len(text.translate(_UPPER)), len(text) - len(text.translate(_LOWER))
    upper = lower = 0
    for c, n in Counter(text).items():
        kind = category(c)
        upper += n * (kind == "Lu")
        lower += n * (kind == "Ll")
    return upper, lower


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at exactly the six white-space bytes
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    upper, lower = cases(text)
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), lines, dup, repeat_words(words),
        upper, lower, text.count("!"), sum(map(bytes.__eq__, words, words[1:])),
    )


_UPPER = {c: None for c in range(65, 91)}
_LOWER = {c: None for c in range(97, 123)}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t.as_py() or "") for t in batch.column(1)]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: measurements and ``failures``, whose bit k is set when rule k fails."""
    ship(docs.sparkSession)
    measured = documents(docs).mapInArrow(_measured, LEDGER)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in RULES]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured.withColumn("failures", failures)


def apply_policy(entries: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(entries: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """For each rule of the policy: documents failing it, failing it alone, and kept if it were dropped."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask(policy)
    hits = F.col("failures").bitwiseAND(F.lit(whole))
    by = {r.name: 1 << r.bit for r in RULES}
    # Distinct masks are at most 2^rules, whatever the corpus; the rest is arithmetic on that histogram.
    masks = entries.groupBy(hits.alias("hits")).agg(F.count("*").alias("docs"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(by[n]).cast("bigint").alias("bit")) for n in names]))
    return (
        masks.select("hits", "docs", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("hits").bitwiseAND(F.col("r.bit")) != 0, F.col("docs")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("hits") == F.col("r.bit"), F.col("docs")).otherwise(0)).alias("failed_alone"),
            F.sum(F.when(F.col("hits").bitwiseAND(F.col("r.bit").bitwiseXOR(F.lit(whole))) == 0, F.col("docs")).otherwise(0)).alias("kept_without"),
        )
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the failure bits."""
    entries = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed"), "kept",
        "n_lines", "n_upper", "n_lower", "n_bangs", "n_stutters", "failures",
    )


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each version of the policy keeps, from one ledger."""
    entries = ledger(table(spark, sf_dir, "documents")).select("failures")
    kept = [F.count_if(F.col("failures").bitwiseAND(F.lit(mask(p))) == 0).alias(p) for p in POLICIES]
    whole = entries.agg(F.count("*").alias("docs"), *kept)
    return whole.select(F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("kept"), "docs") for p in POLICIES])).alias("r")).select("r.*")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(table(spark, sf_dir, "documents")))


def oracle_policies() -> str:
    each = " UNION ALL ".join(f"SELECT '{p}' AS policy, count(*) FILTER ((failures & {mask(p)}) = 0) AS kept, count(*) AS docs FROM q" for p in POLICIES)
    return f"WITH q AS ({oracle()}) {each}"


def oracle_ablation() -> str:
    whole, by = mask(CURRENT), {r.name: 1 << r.bit for r in RULES}
    each = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, CAST(count(*) FILTER ((failures & {by[n]}) <> 0) AS BIGINT) AS failed, CAST(count(*) FILTER ((failures & {whole}) = {by[n]}) AS BIGINT) AS failed_alone,"
        f" CAST(count(*) FILTER ((failures & {whole & ~by[n]}) = 0) AS BIGINT) AS kept_without FROM q"
        for n in POLICIES[CURRENT]
    )
    return f"WITH q AS ({oracle()}) {each}"


def oracle() -> str:
    space = r"[^ \t\n\x0B\f\r]+"
    fails = " | ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{space}') AS words FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') AS s
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
        FROM line WHERE regexp_matches(l, '{space}') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
             length(text) - length(regexp_replace(text, '\p{{Ll}}', '', 'g')) AS n_lower,
             length(text) - length(replace(text, '!', '')) AS n_bangs,
             len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutters
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
f AS (SELECT *, CAST({fails} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {mask(BASE)}) <> 0 AS base_failed,
       (failures & {mask(CURRENT)}) = 0 AS kept, n_lines, n_upper, n_lower, n_bangs, n_stutters, failures
FROM f"""
