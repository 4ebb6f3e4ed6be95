"""Hierarchical multi-length packing of tokenised documents.

Documents are tokenised, closed by an end id, and packed in blocks of at most ``BLOCK_TOKENS`` ids (a longer document is
a block of its own until it is cut). In a block, whole windows of the largest context size are cut off long documents,
and each remainder is routed to the smallest tier that holds it. Tiers are packed from the longest to the shortest: a
remainder opens a window of its tier, and the gap behind it is filled with the longest whole pieces of the same or shorter
tiers that fit; what gap is left then is closed by cutting the longest piece there is. So every window is full, except that
the ids left at the end of a block form windows of their binary digits, which are full as well. Windows of one tier are
dealt in snake order of their attention cost to step groups of equal token count, so that the steps of a group balance.

Blocks are made inside the input's partitions: no row is shuffled, a task holds one block, and a lost task is simply
done again with the same result. ``sequence_id`` is the partition number and a counter in it.

Defined cases: a null text is an empty one, whose only id is the end id; a null doc_id is carried; repeated rows are packed
as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import claim, documents, ship, slices, table, trim

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 65_536
BLOCK_TOKENS = 1 << 21
END_ID = 2
CACHE_CHUNKS = 300_000
ENCODE_CHARS = 6_000_000
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "window bigint, step_group bigint"
)


# How a tokenizer file must prepare texts for the way by chunks.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def goes_by_chunks(spec: str) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and closes words as the way by chunks takes for granted."""
    file = json.loads(spec)
    return (
        file.get("normalizer") == _NORMALIZER and file.get("pre_tokenizer") == _PRE_TOKENIZER and file.get("post_processor") is None and file["model"]["type"] == "BPE"
        and file["model"].get("end_of_word_suffix") == "</w>" and not file["model"].get("dropout") and all(t["content"].startswith("<|") and not t["normalized"] for t in file.get("added_tokens", ()))
    )


class WordTokenizer:
    """The ids that a ``tokenizers`` file gives, with the ids of chunks between blanks kept for the next time.

    The file's pre-tokeniser drops white space and never joins text across it, so a text's ids are those of its chunks.
    Files that do otherwise (``goes_by_chunks``) are left to the library, text by text.
    Chunks of plain letters, with or without marks behind them, are sent many at a time to the file's model; all
    others go through its whole pipeline. Texts that could hold special tokens are encoded whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(spec)
        self.by_chunks = goes_by_chunks(spec)
        self.letters = Tokenizer.from_str(spec)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        ends = [i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]
        self.closes = np.zeros(self.whole.get_vocab_size(), bool)  # ids that end a word
        self.closes[ends] = True
        self.known: dict[str, bytes] = {"": b""}

    _PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        if len(self.known) > CACHE_CHUNKS:
            self.known = {"": b""}
        known, plain, other = self.known, {}, []
        for c in chunks:
            if m := self._PLAIN.fullmatch(c):
                plain[c] = m.groups()
            else:
                other.append(c)
        other += [m for m in {m for _, m in plain.values()} if m and m not in known]
        cores = [c for c in {c for c, _ in plain.values()} if c not in known]
        for i in range(0, len(cores), 1000):
            part = cores[i : i + 1000]
            e = self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.asarray(e.ids, self.kind)
            edge = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])
            for w, a, b in zip(part, edge[:-1], edge[1:], strict=True):
                known[w] = ids[a:b].tobytes()
        for i in range(0, len(other), 1000):
            part = other[i : i + 1000]
            for c, e in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[c] = self._bytes(e.ids)
        for c, (core, mark) in plain.items():
            known[c] = known[core] + known[mark]

    @staticmethod
    def _lowered(text: str) -> str:
        low = text.lower()
        if len(low) != len(text) or "Σ" in text:  # where lower-casing looks at more than one character
            low = text
        return low.replace("\n", " ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_chunks:
            return [np.asarray(e.ids, self.kind) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        special = {i for i, t in enumerate(texts) if "<|" in t}
        chunks = pc.split_pattern(pa.array(["" if i in special else self._lowered(t) for i, t in enumerate(texts)], pa.large_string()), " ")
        coded = chunks.values.dictionary_encode()
        names, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if new := {c for c in names if c not in self.known}:
            self._learn(set(names) if len(self.known) > CACHE_CHUNKS else new)
        parts = [self.known[c] for c in names]
        width = np.dtype(self.kind).itemsize
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
        ids = np.frombuffer(b"".join(parts), self.kind)
        # Every chunk's ids, gathered in text order.
        word_sizes = sizes[at]
        ends = np.cumsum(word_sizes)
        first = (np.cumsum(sizes) - sizes)[at] - (ends - word_sizes)
        flat = ids[np.repeat(first, word_sizes) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[chunks.offsets.to_numpy()]
        out = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i in special:
            out[i] = np.asarray(self.whole.encode(texts[i], add_special_tokens=False).ids, self.kind)
        return out


_TOKENIZERS: dict[int, WordTokenizer] = {}


def tokenizer(spec: str) -> WordTokenizer:
    claim("packing", _TOKENIZERS)
    key = hash(spec)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(spec)
    return _TOKENIZERS[key]


Piece = tuple[int, int, int]  # document in the block, start, length


class _Pool:
    """Remainders by length; the longest that fits is found by bisection."""

    def __init__(self, pieces: list[Piece]):
        self.items = sorted((n, d, s) for d, s, n in pieces)

    def __bool__(self) -> bool:
        return bool(self.items)

    def longest_within(self, room: int) -> Piece | None:
        i = bisect_right(self.items, (room, float("inf"), 0))
        if not i:
            return None
        n, d, s = self.items.pop(i - 1)
        return d, s, n

    def shortest(self) -> Piece:
        n, d, s = self.items.pop(0)
        return d, s, n

    def add(self, piece: Piece) -> None:
        d, s, n = piece
        insort(self.items, (n, d, s))


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """(window, pieces) of one block; every window is filled exactly."""
    top = max(tiers)
    windows: list[tuple[int, list[Piece]]] = []
    rest: list[Piece] = []
    for d, n in enumerate(lengths):
        whole = n // top
        windows += [(top, [(d, k * top, top)]) for k in range(whole)]
        if n % top:
            rest.append((d, whole * top, n % top))
    pool, left = _Pool(rest), sum(n for _, _, n in rest)

    def fill(size: int) -> list[Piece]:
        window, room = [], size
        while room:
            piece = pool.longest_within(room)
            if piece is None:  # only longer ones are left: cut the shortest of them
                d, s, n = pool.shortest()
                piece = (d, s, room)
                pool.add((d, s + room, n - room))
            window.append(piece)
            room -= piece[2]
        return window

    for tier in sorted(tiers, reverse=True):
        # A tier opens windows for the remainders that no shorter tier holds.
        below = max((t for t in tiers if t < tier), default=0)
        while left >= tier and pool.items[-1][0] > below:
            windows.append((tier, fill(tier)))
            left -= tier
    while left:
        size = 1 << (left.bit_length() - 1)
        windows.append((size, fill(size)))
        left -= size
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], first: int = 0, step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step group of each window: one tier and one token budget per group, attention cost dealt in snake order."""
    groups, number = [0] * len(windows), first
    by_tier: dict[int, list[int]] = {}
    for i, (tier, _) in enumerate(windows):
        by_tier.setdefault(tier, []).append(i)
    for tier, members in sorted(by_tier.items(), reverse=True):
        n = max(1, -(-len(members) * tier // step_tokens))
        members.sort(key=lambda i: (-sum(p[2] * p[2] for p in windows[i][1]), i))
        for rank, i in enumerate(members):
            lap, at = divmod(rank, n)
            groups[i] = number + (at if lap % 2 == 0 else n - 1 - at)
        number += n
    return groups


def _packed(spec, tiers: tuple[int, ...], with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(spec.value).encode
        base = TaskContext.get().partitionId() << 32
        sequence = group = held = 0
        docs: list = []
        ids: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal sequence, group
            windows = pack([len(x) for x in ids], tiers)
            groups = step_groups(windows, group)
            rows: list[list] = [[] for _ in names]
            for (size, pieces), g in zip(windows, groups, strict=True):
                offset = 0
                for d, s, n in pieces:
                    part = ids[d][s : s + n]
                    row = (docs[d], s, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids[d]), base + sequence, offset, size, base + g)
                    for column, x in zip(rows, (*row, part.astype(np.int32)) if with_ids else row, strict=True):
                        column.append(x)
                    offset += n
                sequence += 1
            group = max(groups, default=group - 1) + 1
            kinds = [pa.int64()] * 9 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

        for batch in batches:
            for keys, texts in slices(batch.column(0), batch.column(1), ENCODE_CHARS):
                for doc, x in zip(keys, encode(texts), strict=True):
                    docs.append(doc)
                    ids.append(np.append(x, x.dtype.type(END_ID)))  # a copy, so that the batch's ids can go
                    held += len(x) + 1
                if held >= BLOCK_TOKENS:
                    yield block()
                    docs, ids, held = [], [], 0
                    trim()
        if docs:
            yield block()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves. Each tier must be a power of two."""
    if not tiers or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    spark = ship(docs.sparkSession)
    # A vocabulary file: its size does not depend on the data.
    spec = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    return documents(docs).mapInArrow(_packed(spec, tuple(tiers), with_ids), PIECES + ", ids array<int>" * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
