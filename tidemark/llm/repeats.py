"""Removal of repeated byte strings by prefix-free parsing.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document of a smaller id; strings are judged on
the input. Sorting every suffix of the corpus would move it many times over, so the corpus is parsed first. A rolling hash
over ``GRAM`` bytes sets triggers: in every window of LENGTH bytes the gram of least hash. The windows that share a trigger
are one phrase, and neighbouring phrases overlap by all but the trigger's neighbourhood, so that equal windows always lie in
phrases with the same trigger gram, wherever they stand.

1. Triggers: each block of documents sends the distinct hashes of its trigger grams to buckets, and learns which of them
   other documents have too. In text that is not repeated, nothing else happens.
2. Dictionary: blocks send the distinct phrases around shared triggers, each with its smallest document. A bucket makes
   the dictionary of its phrases. A trigger with one phrase is settled by the phrase's first document, as all its windows
   are equal. For triggers with several, the suffixes of their phrases are sorted into a suffix array, word by word;
   suffixes equal over LENGTH bytes stand together, and the smallest document of such a run is the windows' first.
3. Parse: each block walks its parse in document order and marks, phrase by phrase, the windows whose first document is
   smaller than their own.

A phrase reaches LENGTH bytes beyond its trigger's neighbourhood, so it holds as much of the parse as a window can see, and no
order of whole parse suffixes is needed: one entry per byte of the corpus, it would take many times the input's size.

Blocks, phrases and buckets are bounded whatever is repeated how often: a block sends a phrase once for all its documents, and
beyond ``FAN`` blocks what they send is folded in groups of FAN first, level by level, and the answers come back the same
way; so a passage of millions of copies reaches a bucket at most FAN times. A group keeps no phrase of its blocks but their
numbers in the folded dictionary, and what a step sent is gone from disk before the next one begins. Where a trigger has many different phrases, as in
a form text around a number, its phrases are cut into their single windows, which go to buckets of their own by their bytes.

Defined cases: a null text is an empty one; a null doc_id counts as 2^63 - 1, the largest; rows of one doc_id are one document
for the comparison and are returned each; texts shorter than LENGTH stay; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import claim, discard, settle, shuffle_partitions, ship, table, trim, without

LENGTH = 50
GRAM = 24
BLOCK_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 20
PLACE_BITS = 28
HOT_PHRASES = 1024  # different ones of one trigger, over all blocks, by the estimate of ``_hot``
FAN = 1024  # blocks, or groups of them, that are folded into one
LAST = (1 << 63) - 1  # the id of rows without one
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    up = np.zeros(0, np.uint64)
    down = np.zeros(0, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Parse:
    """The phrases of a text buffer, in its order: windows begin..last share the trigger at ``at``."""

    begin: np.ndarray
    last: np.ndarray
    at: np.ndarray
    trigger: np.ndarray  # hash of the trigger gram
    phrase: np.ndarray  # hash of the phrase's bytes and the trigger's place in it


def parse(text: np.ndarray, ends: np.ndarray) -> Parse:
    """Phrases of the documents that lie one after another in ``text`` and stop at ``ends``."""
    parts: list[tuple[np.ndarray, ...]] = []
    windows = len(text) - LENGTH + 1
    for a in range(0, max(windows, 0), SEGMENT_BYTES):
        b = min(a + SEGMENT_BYTES, windows)
        piece = text[a : b + LENGTH - 1]
        n = len(piece)
        _Tables.reach(SEGMENT_BYTES + LENGTH + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(piece.astype(np.uint64) * _Tables.up[:n] + _Tables.up[:n], out=run[1:])
        gram = _mixed((run[GRAM:] - run[:-GRAM]) * _Tables.down[: n - GRAM + 1])
        key = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(gram), dtype=np.uint64)
        span, reach = LENGTH - GRAM + 1, 1
        least = key
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        good = np.ones(b - a, bool)
        inner = ends[(ends > a) & (ends < b + LENGTH - 1)] - a
        if len(inner):  # windows that go on into the next document
            cross = (inner[:, None] - np.arange(1, LENGTH)).ravel()
            good[cross[(cross >= 0) & (cross < b - a)]] = False
        at = np.flatnonzero(good)
        if not len(at):
            continue
        own = place[at]
        fresh = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
        begin, last, mark = at[fresh], at[np.append(fresh[1:], len(at)) - 1], own[fresh]
        body = (run[last + LENGTH] - run[begin]) * _Tables.down[begin]
        phrase = _mixed(body + (mark - begin).astype(np.uint64) * _M1 + (last - begin).astype(np.uint64) * _M2)
        # A trigger is the least of its window, so its hash is mixed anew: buckets are cut from even values.
        parts.append((begin + a, last + a, mark + a, _mixed(gram[mark] + _M1), phrase))
    if not parts:
        none = np.zeros(0, np.int64)
        return Parse(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Parse(*(np.concatenate([p[k] for p in parts]) for k in range(5)))


@dataclass(frozen=True)
class Block:
    table: pa.Table
    text: np.ndarray
    ends: np.ndarray
    ids: np.ndarray

    @classmethod
    def read(cls, blob: bytes, id_name: str, text_name: str) -> Block:
        t = pa.ipc.open_stream(blob).read_all().combine_chunks()
        column = t.column(text_name).combine_chunks()
        column = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
        ids = t.column(id_name).fill_null(LAST).to_numpy()
        return cls(t, whole[offsets[0] : offsets[-1]], offsets[1:] - offsets[0], ids)

    def documents_of(self, p: Parse) -> np.ndarray:
        """The id of the document that each phrase lies in."""
        return self.ids[np.searchsorted(self.ends, p.begin, side="right")]


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _triggers(block: Block, p: Parse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigger hashes in order, whether two documents of the block have them, and each phrase's place in them."""
    names, slot = np.unique(p.trigger, return_inverse=True)
    docs = block.documents_of(p)
    low, high = np.full(len(names), LAST), np.full(len(names), -LAST)
    np.minimum.at(low, slot, docs)
    np.maximum.at(high, slot, docs)
    return names, low != high, slot


def _or_by(slot: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The values of each of n slots, of which each has some, joined bit by bit."""
    order = np.argsort(slot, kind="stable")
    counts = np.bincount(slot, minlength=n)
    return np.bitwise_or.reduceat(values[order], np.cumsum(counts) - counts) if n else np.zeros(0, np.uint16)


def _phrases_of(p: Parse, slot: np.ndarray, n: int) -> np.ndarray:
    """A sketch of how many different phrases each of n triggers has: each phrase sets the bit of its hash's lowest one, so that a
    phrase that many blocks have counts once when their sketches are joined (Flajolet and Martin)."""
    low = np.minimum((p.phrase & (~p.phrase + np.uint64(1))) - np.uint64(1), np.uint64((1 << 15) - 1)) + np.uint64(1)
    return _or_by(slot, low.astype(np.uint16), n)


def _hot(sketches: np.ndarray) -> np.ndarray:
    """Whether about HOT_PHRASES different phrases are in a sketch: its lowest bits are set."""
    least = np.uint16((1 << min(15, int(np.ceil(np.log2(0.77351 * HOT_PHRASES))))) - 1)
    return sketches & least == least


def _split_hot(block: Block, p: Parse, shared: np.ndarray, hot: np.ndarray) -> tuple[Parse, np.ndarray]:
    """The parse with the phrases of hot triggers cut into their windows, each its own trigger; and what is shared."""
    if not hot.any():
        return p, shared
    cold, own = np.flatnonzero(~hot), np.flatnonzero(hot)
    n = p.last[own] - p.begin[own] + 1
    begin = np.repeat(p.begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    names = np.empty(len(begin), np.uint64)
    weights = _powers(_BASE, LENGTH)
    for a in range(0, len(begin), 1 << 16):
        part = begin[a : a + (1 << 16), None] + np.arange(LENGTH)
        names[a : a + (1 << 16)] = _mixed(((block.text[part].astype(np.uint64) + np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64))
    both = lambda x, y: np.concatenate([x[cold], y])
    cut_ = Parse(both(p.begin, begin), both(p.last, begin), both(p.at, begin), both(p.trigger, names), both(p.phrase, names))
    return cut_, np.concatenate([shared[cold], np.ones(len(begin), bool)])


@dataclass(frozen=True)
class Entries:
    """The distinct phrases of a block around shared triggers, by bucket and hash."""

    bucket: np.ndarray
    first: np.ndarray  # the smallest document
    sample: np.ndarray  # a phrase of the parse
    of: np.ndarray  # each phrase's entry, or -1


def _entries(block: Block, p: Parse, shared: np.ndarray, n: int) -> Entries:
    used = np.flatnonzero(shared)
    order = used[np.lexsort((p.phrase[used], p.trigger[used]))]
    t, h = p.trigger[order], p.phrase[order]
    fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(order) else np.zeros(0, bool)
    number = np.cumsum(fresh) - 1
    of = np.full(len(p.begin), -1)
    of[order] = number
    first = np.full(int(fresh.sum()), LAST)
    np.minimum.at(first, number, block.documents_of(p)[order])
    sample = order[fresh]
    return Entries(_buckets(p.trigger[sample], n), first, sample, of)


def _runs(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, rows) of an ascending column."""
    if len(buckets):
        at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        for a, b in zip(at, np.append(at[1:], len(buckets)), strict=True):
            yield int(buckets[a]), slice(int(a), int(b))


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns as one blob; the bytes of a column's numbers stand apart, which compresses them better."""
    out = []
    for c in columns:
        raw = np.ascontiguousarray(c)
        planes = raw.view(np.uint8).reshape(len(raw), -1).T if len(raw) else np.zeros(0, np.uint8)
        out.append(len(raw).to_bytes(4, "little") + np.ascontiguousarray(planes).tobytes())
    return zstandard.compress(b"".join(out), 1)


def _unsqueeze(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        n, size = int.from_bytes(raw[at : at + 4], "little"), np.dtype(kind).itemsize
        at += 4
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n) if n else np.zeros((size, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def blocks(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """(block, bytes, rows): runs of whole rows with at most ``size`` bytes of text, or one longer row, in Arrow's format."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, amount = TaskContext.get().partitionId() << 32, 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal made, held, amount
            t = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            row = pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([amount]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "bytes", "rows"])
            made, held, amount = made + 1, [], 0
            return row

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_name))
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64, len(texts) + 1 + texts.offset)[texts.offset :]) if len(texts) else []
            at = 0
            for i, n in enumerate(sizes):
                if amount and amount + n > size:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    at = i
                    yield out()
                amount += int(n)
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield out()

    plain = docs.withColumns({id_name: F.col(id_name).cast("bigint"), text_name: F.col(text_name).cast("string")})
    return plain.mapInArrow(run, "block bigint, bytes bigint, rows binary")


def bucket_count(total: int) -> int:
    """Buckets of about 1 MB of text each while that makes few, of 16 MB beyond: what a bucket is sent fits a task."""
    return max(1, -(-total // (16 << 20)), min(1024, -(-total // (1 << 20))))


def _ask(id_name: str, text_name: str, n: int):
    """Step 1, in blocks: distinct trigger hashes to their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a batch holds many blocks; one at a time is taken out
                number, blob = (batch.column(c)[row].as_py() for c in range(2))
                block = Block.read(blob, id_name, text_name)
                p = parse(block.text, block.ends)
                names, several, slot = _triggers(block, p)
                kinds = _phrases_of(p, slot, len(names))
                claim("repeats", {})
                parts = [(k, _squeeze(np.diff(names[rows], prepend=np.uint64(0)), np.packbits(several[rows]), kinds[rows])) for k, rows in _runs(_buckets(names, n))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["bucket", "block", "blob"])
                del block, p, names, several, slot, kinds, parts
                trim()

    return run


@dataclass(frozen=True)
class _Asked:
    """Trigger hashes that several senders have sent: the distinct ones, and what is known of each."""

    sizes: list[int]  # hashes of each sender
    slot: np.ndarray  # the place of each sender's hashes among the distinct ones
    names: np.ndarray
    shared: np.ndarray  # whether two documents have it
    kinds: np.ndarray  # sketches of their phrases

    @classmethod
    def read(cls, t: pa.Table) -> _Asked:
        columns = [_unsqueeze(b, np.uint64, np.uint8, np.uint16) for b in t.column("blob").to_pylist()]
        sent = [np.cumsum(c[0], dtype=np.uint64) for c in columns]
        sizes = list(map(len, sent))
        several = np.concatenate([np.unpackbits(c[1], count=k).astype(bool) for c, k in zip(columns, sizes, strict=True)])
        names, slot, times = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[slot[several]] = True
        return cls(sizes, slot, names, shared, _or_by(slot, np.concatenate([c[2] for c in columns]), len(names)))

    def slots(self) -> list[np.ndarray]:
        return np.split(self.slot, np.cumsum(self.sizes)[:-1])


def _told_asked(slot: np.ndarray, shared: np.ndarray, hot: np.ndarray) -> bytes:
    """A bit per hash of a sender, set if another document has it, and one set if it is hot."""
    return _squeeze(np.packbits(shared[slot]), np.packbits(hot[slot]))


def _replies(t: pa.Table, blobs: list[bytes]) -> pa.Table:
    return pa.table([t.column("bucket"), t.column("block"), pa.array(blobs, pa.binary())], names=["bucket", "block", "blob"])


def _folded(t: pa.Table, blob: bytes) -> pa.Table:
    """What the senders of a group send as one."""
    return pa.table([t.column("bucket").slice(0, 1), t.column("above").slice(0, 1), pa.array([blob], pa.binary())], names=["bucket", "block", "blob"])


def _answer(t: pa.Table) -> pa.Table:
    """Step 1, in a bucket."""
    a = _Asked.read(t)
    hot = a.shared & _hot(a.kinds)
    return _replies(t, [_told_asked(slot, a.shared, hot) for slot in a.slots()])


def _fold_asked(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The group's hashes, and for each sender the places of its own among them, which ascend."""
    a = _Asked.read(t)
    folded = _folded(t, _squeeze(np.diff(a.names, prepend=np.uint64(0)), np.packbits(a.shared), a.kinds))
    return folded, _replies(t, [_squeeze(np.diff(slot, prepend=0).astype(np.uint32)) for slot in a.slots()])


def _hand_down_asked(t: pa.Table, from_above: pa.Table) -> pa.Table:
    slots = [np.cumsum(_unsqueeze(b, np.uint32)[0], dtype=np.int64) for b in t.column("blob").to_pylist()]
    n = 1 + max((int(slot[-1]) for slot in slots if len(slot)), default=-1)
    shared, hot = (np.unpackbits(x, count=n).astype(bool) for x in _unsqueeze(from_above.column("blob")[0].as_py(), np.uint8, np.uint8))
    return _replies(t, [_told_asked(slot, shared, hot) for slot in slots])


REPLY = "bucket bigint, block bigint, blob binary"


def exchange(sent: DataFrame, n: int, answer, fold, hand_down, held: list[DataFrame] | None = None) -> DataFrame:
    """(bucket, block, blob): the answer of each bucket to each of n senders. Beyond FAN senders, groups of them are folded
    into one sender, who gets the bucket's answer and hands it down. A fold gives the folded row, and may give rows to
    hand down by in place of those that were sent: a second shuffle gives no promise of the first one's order, and these are small. What is on disk until the answers have been
    read is added to ``held``."""
    if n <= FAN:
        return sent.groupBy("bucket").applyInArrow(answer, REPLY)
    groups = -(-n // FAN)

    def folded_and_noted(t: pa.Table) -> pa.Table:
        out = fold(t)
        folded, noted = out if isinstance(out, tuple) else (out, t)
        rows = [(folded, pa.nulls(1, pa.int64()), folded.column("block")), (noted, noted.column("block"), t.column("above"))]
        return pa.concat_tables(pa.table([x.column("bucket"), block, above, x.column("blob").cast(pa.binary())], names=["bucket", "block", "above", "blob"]) for x, block, above in rows)

    # Even groups by hash; a group of twice the mean size is beyond chance.
    grouped = sent.withColumn("above", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("bucket", "above")
    both = settle(grouped.applyInArrow(folded_and_noted, "bucket bigint, block bigint, above bigint, blob binary"))
    if held is not None:
        held.append(both)
    folded = both.where("block IS NULL").select("bucket", F.col("above").alias("block"), "blob")
    replies = exchange(folded, groups, answer, fold, hand_down, held).withColumnRenamed("block", "above")
    return both.where("block IS NOT NULL").groupBy("bucket", "above").cogroup(replies.groupBy("bucket", "above")).applyInArrow(hand_down, REPLY)


def _told_of(block: Block, n: int, answers: dict[int, bytes]) -> tuple[Parse, Entries]:
    """The block's parse, with hot phrases cut, and its entries, from the answers of step 1."""
    p = parse(block.text, block.ends)
    names, _, slot = _triggers(block, p)
    shared, hot = np.zeros(len(names), bool), np.zeros(len(names), bool)
    for k, rows in _runs(_buckets(names, n)):
        for out, bits in zip((shared, hot), _unsqueeze(answers[k], np.uint8, np.uint8), strict=True):
            out[rows] = np.unpackbits(bits, count=rows.stop - rows.start).astype(bool)
    p, used = _split_hot(block, p, shared[slot], hot[slot])
    return p, _entries(block, p, used, n)


def _tell(id_name: str, text_name: str, n: int):
    """Step 2, in blocks: distinct phrases around shared triggers to their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, blob, replies = (batch.column(c)[row].as_py() for c in range(3))
                block = Block.read(blob, id_name, text_name)
                p, e = _told_of(block, n, {r["bucket"]: r["blob"] for r in replies or []})
                parts = []
                for k, rows in _runs(e.bucket):
                    own = e.sample[rows]
                    begin, size = p.begin[own], p.last[own] - p.begin[own] + LENGTH
                    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    parts.append((k, _squeeze(block.text[at], size.astype(np.uint16), (p.at[own] - begin).astype(np.uint16), e.first[rows])))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["bucket", "block", "blob"])
                del block, p, e, parts
                trim()

    return run


def suffix_runs(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): the suffixes of text at ``starts`` sorted by their first LENGTH bytes, and the number of each
    sorted suffix's run of equal ones. Words of 8 bytes are compared at a time; settled suffixes are left alone."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    order = np.arange(len(starts))
    rank = np.zeros(len(starts), np.int64)  # first sorted place of the suffix's class
    for at in range(0, LENGTH, 8):
        size = np.bincount(rank, minlength=len(starts))
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        word = np.zeros(len(open_), np.uint64)
        for j in range(min(8, LENGTH - at)):
            word = word << np.uint64(8) | padded[starts[open_] + at + j]
        ranked = open_[np.lexsort((word, rank[open_]))]
        value = np.empty(len(starts), np.uint64)
        value[open_] = word
        group, w = rank[ranked], value[ranked]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (w[1:] != w[:-1])])
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        inside = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(ranked)), 0))
        rank[ranked] = group + inside[begin]
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    return order, np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) if len(ranked) else ranked


@dataclass(frozen=True)
class _Told:
    """The phrases that several senders have sent, and the dictionary of the distinct ones."""

    counts: list[int]  # phrases of each sender
    of: np.ndarray  # each sent phrase's place in the dictionary
    doc: np.ndarray  # and its smallest document
    text: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    mark: np.ndarray  # the trigger's place in the phrase
    sample: np.ndarray  # a sent phrase for each of the dictionary
    first: np.ndarray  # the smallest document of each of the dictionary

    @classmethod
    def read(cls, t: pa.Table) -> _Told:
        columns = [_unsqueeze(b, np.uint8, np.uint16, np.uint16, np.int64) for b in t.column("blob").to_pylist()]
        text = np.concatenate([c[0] for c in columns])
        size, mark, doc = (np.concatenate([c[k] for c in columns]).astype(np.int64) for k in (1, 2, 3))
        begin = np.cumsum(size) - size
        raw = text.tobytes()
        # Equal phrases with their triggers in one place are one, of the smallest document.
        number: dict[tuple[bytes, int], int] = {}
        of = np.fromiter((number.setdefault((raw[a : a + n], m), len(number)) for a, n, m in zip(begin.tolist(), size.tolist(), mark.tolist(), strict=True)), np.int64, len(begin))
        first = np.full(len(number), LAST)
        np.minimum.at(first, of, doc)
        sample = np.zeros(len(number), np.int64)
        sample[of] = np.arange(len(of))
        return cls([len(c[1]) for c in columns], of, doc, text, begin, size, mark, sample, first)

    def gram(self, i: int) -> bytes:
        a = int(self.begin[i] + self.mark[i])
        return self.text[a : a + GRAM].tobytes()

    def numbers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each sender, its phrases' places in the dictionary, and whether a smaller document than its own has them."""
        later = self.first[self.of] < self.doc
        at = np.cumsum(self.counts)[:-1]
        return list(zip(np.split(self.of, at), np.split(later, at), strict=True))


def _told_phrases(of: np.ndarray, later: np.ndarray, state: np.ndarray, masks: np.ndarray) -> bytes:
    """For each phrase of a sender 0 (no window is in a smaller document), 1 (all) or 2 (some), and a mask for each of the
    last kind; ``state`` and ``masks`` are those of the dictionary's phrases against documents below their first."""
    own = np.where(later, 1, state[of]).astype(np.uint8)
    return _squeeze(own, masks[of[own == 2]])


def _dictionary(t: pa.Table) -> pa.Table:
    """Step 2, in a bucket: the suffix array of the dictionary's phrases, by trigger, tells each window's first document."""
    d = _Told.read(t)
    grams: dict[bytes, int] = {}
    trigger = np.fromiter((grams.setdefault(d.gram(i), len(grams)) for i in d.sample.tolist()), np.int64, len(d.sample))
    state, masks = np.zeros(len(d.sample), np.uint8), np.zeros(len(d.sample), np.uint32)
    # Of a trigger with one phrase, no other phrase has a window, so the phrase's first document is that of all its windows.
    several = np.flatnonzero(np.bincount(trigger, minlength=len(grams))[trigger] > 1)
    if len(several):
        windows = d.size[d.sample[several]] - LENGTH + 1
        starts = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(several)), windows)
        place = np.arange(len(owner)) - np.repeat(starts, windows)
        order, run = suffix_runs(d.text, d.begin[d.sample[several]][owner] + place)
        least = np.full(int(run[-1]) + 1, LAST)
        np.minimum.at(least, run, d.first[several][owner[order]])
        earliest = np.empty(len(owner), np.int64)
        earliest[order] = least[run]
        again = earliest < d.first[several][owner]
        masks[several] = np.bitwise_or.reduceat(again.astype(np.uint32) << place.astype(np.uint32), starts)
        full = masks[several] == (np.uint32(1) << windows.astype(np.uint32)) - np.uint32(1)
        state[several] = np.where(full, 1, np.where(masks[several] > 0, 2, 0))
    return _replies(t, [_told_phrases(of, later, state, masks) for of, later in d.numbers()])


def _fold_told(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The group's dictionary, and for each sender its phrases' numbers in it."""
    d = _Told.read(t)
    begin, size = d.begin[d.sample], d.size[d.sample]
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    folded = _folded(t, _squeeze(d.text[at], size.astype(np.uint16), d.mark[d.sample].astype(np.uint16), d.first))
    return folded, _replies(t, [_squeeze(of.astype(np.uint32), np.packbits(later)) for of, later in d.numbers()])


def _hand_down_told(t: pa.Table, from_above: pa.Table) -> pa.Table:
    state, some = _unsqueeze(from_above.column("blob")[0].as_py(), np.uint8, np.uint32)
    masks = np.zeros(len(state), np.uint32)
    masks[state == 2] = some
    out = []
    for blob in t.column("blob").to_pylist():
        of, later = _unsqueeze(blob, np.uint32, np.uint8)
        out.append(_told_phrases(of, np.unpackbits(later, count=len(of)).astype(bool), state, masks))
    return _replies(t, out)


def removed(block: Block, p: Parse, e: Entries, replies: dict[int, bytes]) -> np.ndarray:
    """Step 3: for each byte of the block, whether it goes."""
    state, masks = np.zeros(len(e.bucket), np.uint8), np.zeros(len(e.bucket), np.uint32)
    for k, rows in _runs(e.bucket):
        own, some = _unsqueeze(replies[k], np.uint8, np.uint32)
        state[rows] = own
        part = np.zeros(len(own), np.uint32)
        part[own == 2] = some
        masks[rows] = part
    change = np.zeros(len(block.text) + 1, np.int16)  # windows over a byte: at most LENGTH
    used = np.flatnonzero(e.of >= 0)
    entry = e.of[used]
    later = block.documents_of(p)[used] > e.first[entry]
    all_ = used[later | (state[entry] == 1)]
    np.add.at(change, p.begin[all_], 1)
    np.add.at(change, p.last[all_] + LENGTH, -1)
    some = np.flatnonzero(~later & (state[entry] == 2))
    for j in range(LENGTH - GRAM + 1):
        at = p.begin[used[some[masks[entry[some]] >> np.uint32(j) & np.uint32(1) > 0]]] + j
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[:-1], dtype=np.int16) > 0


RESULT = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())]


def _mark(id_name: str, text_name: str, n: int, with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                blob, shared, told = (batch.column(c)[row].as_py() for c in range(3))
                block = Block.read(blob, id_name, text_name)
                p, e = _told_of(block, n, {r["bucket"]: r["blob"] for r in shared or []})
                gone = removed(block, p, e, {r["bucket"]: r["blob"] for r in told or []})
                rows: list[tuple] = []
                a = 0
                for b in block.ends.tolist():
                    out, own = gone[a:b], block.text[a:b]
                    k = int(out.sum())
                    kept = (own[~out] if k else own).tobytes()
                    spans = int(out[:1].sum()) + int((out[1:] & ~out[:-1]).sum()) if k else 0
                    rows.append((b - a, k, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_kept else None))
                    a = b
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                columns = [pa.array([r[c] for r in rows], kinds[c]) for c in range(4 + with_kept)]
                whole = [c.combine_chunks() for c in block.table.columns]
                names = [*block.table.column_names, *[name for name, _ in RESULT[: 4 + with_kept]]]
                del block, p, e, gone, rows
                yield pa.RecordBatch.from_arrays([*whole, *columns], names=names)
                del whole, columns
                trim()


    return run


def mark_repeats(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", with_kept: bool = False, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """The rows of docs with n_bytes, n_removed, n_spans and kept_sha256, and if asked for ``kept_text``;
    columns of these names are replaced.

    kept_text is the bytes that stay, as text; characters of which a removal left only a part are left out.
    """
    docs = without(docs, *[name for name, _ in RESULT[: 4 + with_kept]])
    own = settle(blocks(docs, id_name, text_name, block_bytes).repartition(shuffle_partitions(docs.sparkSession), "block"), True)
    n_blocks, total = own.agg(F.count("*"), F.sum("bytes")).first()
    n = buckets or bucket_count(total or 0)
    rows = own.select("block", "rows")

    def answered(sent: DataFrame, name: str, *how) -> DataFrame:
        """(block, name): all that buckets answer to each block."""
        held: list[DataFrame] = []
        out = settle(exchange(sent, n_blocks, *how, held).groupBy("block").agg(F.collect_list(F.struct("bucket", "blob")).alias(name)))
        for frame in held:
            discard(frame)
        return out

    shared = answered(rows.mapInArrow(_ask(id_name, text_name, n), REPLY), "shared", _answer, _fold_asked, _hand_down_asked)
    known = rows.join(shared, "block", "left")
    sent = known.select("block", "rows", "shared").mapInArrow(_tell(id_name, text_name, n), REPLY)
    told = answered(sent, "told", _dictionary, _fold_told, _hand_down_told)
    schema = T.StructType([*docs.withColumns({id_name: F.col(id_name).cast("bigint"), text_name: F.col(text_name).cast("string")}).schema.fields, *[T.StructField(a, b) for a, b in RESULT[: 4 + with_kept]]])
    return known.join(told, "block", "left").select("rows", "shared", "told").mapInArrow(_mark(id_name, text_name, n, with_kept), schema)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_repeats(docs).drop("text")


def oracle() -> str:
    n = LENGTH
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
w AS (SELECT doc_id, p, hash(t[p + 1 : p + {n}]) AS s FROM (SELECT doc_id, t, unnest(range(0, n_bytes - {n - 1})) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
dup AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER o + {n} THEN 1 ELSE 0 END AS gap FROM w JOIN f USING (s) WHERE first < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
span AS (SELECT doc_id, min(p) AS a, max(p) + {n} AS b FROM (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM dup) GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span),
gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS upto, string_agg(hex(t[since + 1 : a]), '' ORDER BY a) AS kept
         FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(t[coalesce(upto, 0) + 1 : n_bytes]))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""
