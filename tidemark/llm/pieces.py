"""SentencePiece encoding and decoding by batched Viterbi in numpy.

No piece of the models read here goes on across a blank behind other characters, so a text falls into words that are
segmented one by one; this is checked when a model is read. The distinct words of a batch are grouped by length, and all
words of one length advance together: for each end, the hashes of all substrings that end there are probed in the sorted
table of piece hashes, and the best of the pieces found is taken, with its backpointer, for all words at once. Hash hits
are compared with the pieces themselves. Characters without a piece are written as byte pieces.

What is best depends on the model. For a unigram model it is the highest sum of scores; of equals, the shortest last
piece. For a BPE model (the public one installed here) sums of scores don't give the merge order's result. But merging
has a last piece for every prefix of a word, and exactly one piece that ends there goes with the last piece before it:
the one for which merging the two alone leaves both as they are. So the recurrence takes, at every end, the piece that
goes with its predecessor's best, and its result is the library's. Whether two pieces go together is worked out by merging
once per pair and kept in a sorted table that the batches probe.

Words are kept with their ids for later batches, in caches of bounded size.

Defined cases: a null text is an empty one, without ids; repeated rows are encoded alike; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import claim, documents, ship, slices, table

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 600_000
CACHE_PAIRS = 1_000_000
BATCH_CHARS = 4_000_000
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+$")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_SHIFT = np.uint64(42)
_NEAR_SHIFT = np.uint64(44)


class Pieces:
    """The pieces of a model: lookup by hash, byte pieces, and the bytes of each id."""

    def __init__(self, proto: bytes, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor

        if kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind of model {kind!r}")
        self.kind = kind
        sp = SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.unknown = sp.unk_id()
        self.byte: dict[int, int] = {}
        self.bytes_of: list[bytes] = []
        normal = []
        for i, t in enumerate(self.text):
            if sp.is_byte(i):
                self.byte[int(t[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(t[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(t.replace(BLANK, " ").encode())
                normal.append(i)
        if any(re.search(f"[^{BLANK}]{BLANK}", self.text[i]) for i in normal):
            raise ValueError("a piece goes on behind a blank: words can't be cut apart")
        self.score_of = {self.text[i]: sp.get_score(i) for i in normal}
        if kind == "bpe":  # pieces that merging never makes can't be in a result
            self.steps = {i: self._steps(self.text[i]) for i in normal}
            normal = [i for i in normal if self.steps[i][-1][1] == self.text[i]]
        scores = np.array([sp.get_score(i) for i in normal])
        self.unknown_score = float(scores.min(initial=0)) - UNKNOWN_PENALTY
        points = [self._points(self.text[i]) for i in normal]
        self.longest = max(map(len, points), default=1)
        hashes = np.array([self._hash(p) for p in points], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids, self.scores = hashes[order], np.array(normal, np.int64)[order], scores[order]
        if len(np.unique(self.hashes)) != len(self.hashes):
            raise ValueError("two pieces share a hash")
        self.sizes = np.array(list(map(len, points)), np.int64)[order]
        self.filter = np.zeros(1 << (64 - int(_FILTER_SHIFT)), bool)
        self.filter[self.hashes >> _FILTER_SHIFT] = True
        self.points = np.zeros((len(normal), self.longest), np.uint32)
        for row, i in enumerate(order):
            self.points[row, : len(points[i])] = points[i]
        self.cut_lines = not any("\n" in self.text[i] for i in normal)
        self.known: dict[str, bytes] = {}
        self.pairs, self.together = np.zeros(0, np.int64), np.zeros(0, bool)
        near = 1 << (64 - int(_NEAR_SHIFT))
        self.near_key, self.near = np.full(near, -1), np.zeros(near, bool)
        sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.raw, self.raw_size, self.raw_at = np.frombuffer(b"".join(self.bytes_of), np.uint8), sizes, np.cumsum(sizes) - sizes

    def _steps(self, t: str) -> list[tuple[float, str, str]]:
        """Merging t, best score first and leftmost of equals: (score, first part, last part) after each step."""
        parts, score = list(t), self.score_of
        steps = [(np.inf, parts[0], parts[-1])]
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: score.get(parts[i] + parts[i + 1], -np.inf))
            if (whole := parts[best] + parts[best + 1]) not in score:
                break
            parts[best : best + 2] = [whole]
            steps.append((score[whole], parts[0], parts[-1]))
        return steps

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging two pieces' text ends in the two: no merge over their border is ever the best one open."""
        left, right, score = self.steps[a], self.steps[b], self.score_of
        i = j = 0
        while True:
            over = score.get(left[i][2] + right[j][1])
            in_left = left[i + 1][0] if i + 1 < len(left) else None
            in_right = right[j + 1][0] if j + 1 < len(right) else None
            if over is not None and (in_left is None or over > in_left) and (in_right is None or over >= in_right):
                return False
            if in_left is None and in_right is None:
                return True
            if in_right is None or (in_left is not None and in_left >= in_right):
                i += 1
            else:
                j += 1

    def _go_together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging left + right leaves both; an unknown character (-1) goes with everything."""
        out = (left < 0) | (right < 0)
        todo = np.flatnonzero(~out)
        keys = (left * len(self.text) + right)[todo]
        # A direct-mapped table answers what was asked before; the sorted one has all that was ever worked out.
        spot = (keys.view(np.uint64) * _BASE >> _NEAR_SHIFT).view(np.int64)
        near = self.near_key[spot] == keys
        out[todo[near]] = self.near[spot[near]]
        todo, keys, spot = todo[~near], keys[~near], spot[~near]
        slot, told = self._told(keys)
        if not told.all():
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs, self.together, told = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(keys), bool)
            new = np.unique(keys[~told])
            found = list(map(self._stay_apart, (new // len(self.text)).tolist(), (new % len(self.text)).tolist()))
            at = np.searchsorted(self.pairs, new)  # both are sorted: the new ones go between, and the table isn't sorted again
            self.pairs, self.together = np.insert(self.pairs, at, new), np.insert(self.together, at, found)
            slot, told = self._told(keys)
        if len(keys):
            out[todo] = self.together[slot]
            self.near_key[spot] = keys
            won = self.near_key[spot] == keys  # of the keys with one spot, one stays
            self.near[spot[won]] = self.together[slot[won]]
        return out

    def _told(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.pairs):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        slot = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return slot, self.pairs[slot] == keys

    @staticmethod
    def _points(t: str) -> np.ndarray:
        return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)

    @staticmethod
    def _hash(points: np.ndarray) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for p in points:
                h = (h + np.uint64(p) + np.uint64(1)) * _BASE
        return h

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length: best[e] = max over starts s of best[s] + score(word[s:e])."""
        n, length = len(words), len(words[0])
        text = self._points("".join(words)).reshape(n, length)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        start = np.zeros((n, length + 1), np.int32)
        piece = np.full((n, length + 1), -1, np.int64)
        # rolled[:, s] is the hash of text[:, s:e]; it grows by one character as the end moves on.
        rolled = np.zeros((n, length), np.uint64)
        rows = np.arange(n)
        for e in range(1, length + 1):
            low = max(0, e - self.longest)
            rolled[:, low:e] = (rolled[:, low:e] + text[:, e - 1 : e] + np.uint64(1)) * _BASE
            # Most substrings are no piece: a table of hash bits tells before the sorted hashes are searched.
            w, at = np.nonzero(self.filter[rolled[:, low:e] >> _FILTER_SHIFT])
            found = rolled[w, low + at]
            slot = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            size = e - low - at
            # A hash hit counts only if the characters agree.
            hit = (self.hashes[slot] == found) & (self.sizes[slot] == size)
            w, at, slot, size = w[hit], at[hit], slot[hit], size[hit]
            for k in range(int(size.max(initial=0))):
                inside = size > k
                hit = ~inside
                hit[inside] = self.points[slot[inside], k] == text[w[inside], low + at[inside] + k]
                if not hit.all():
                    w, at, slot, size = w[hit], at[hit], slot[hit], size[hit]
            gain = np.full((n, e - low), -np.inf)
            gain[:, -1] = best[:, e - 1] + self.unknown_score
            if self.kind == "bpe":
                fits = (low + at == 0) | self._go_together(piece[w, low + at], self.ids[slot])
                w, at, slot = w[fits], at[fits], slot[fits]
                gain[w, at] = 1
            else:
                gain[w, at] = best[w, low + at] + self.scores[slot]
            name = np.full((n, e - low), -1, np.int32)
            name[w, at] = self.ids[slot]
            pick = e - low - 1 - np.argmax(gain[:, ::-1], axis=1)  # of equals, the shortest piece
            best[:, e] = gain[rows, pick] if self.kind == "unigram" else 0
            start[:, e] = low + pick
            piece[:, e] = name[rows, pick]
        # Walk all words back at once; column k from the right holds the k-th piece from the end.
        ids, count = np.full((n, length), -1, np.int32), np.zeros(n, np.int64)
        odd = np.zeros(n, bool)
        at, left = np.full(n, length), rows
        for k in range(length - 1, -1, -1):
            if not len(left):
                break
            ids[left, k] = piece[left, at[left]]
            odd[left] |= ids[left, k] < 0
            count[left] += 1
            at[left] = start[left, at[left]]
            left = left[at[left] > 0]
        out = [ids[r, length - c :].tobytes() for r, c in enumerate(count.tolist())]
        for r in np.flatnonzero(odd).tolist():  # unknown characters become byte pieces
            e, back = length, []
            while e:
                s, p = int(start[r, e]), int(piece[r, e])
                back.append([p] if p >= 0 else [self.byte.get(b, self.unknown) for b in words[r][s:e].encode("utf-8", "replace")] if self.byte else [self.unknown])
                e = s
            out[r] = np.array([p for part in reversed(back) for p in part], np.int32).tobytes()
        return out

    def learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, 1_000_000 // (length * max(1, min(length, self.longest))))
            for i in range(0, len(group), step):
                for w, ids in zip(group[i : i + step], self._viterbi(group[i : i + step]), strict=True):
                    self.known[w] = ids

    def _parts(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if new and len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = words
        self.learn(new)
        return [self.known[w] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if not t or "  " in t or " \n" in t or t[0] == " " or t[-1] == " " or BLANK in t}
        # A line end without a piece parts words as well; it then begins a chunk.
        plain = ["" if i in odd else t.replace("\n", " \n") if self.cut_lines else t for i, t in enumerate(texts)]
        chunks = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = chunks.values.dictionary_encode()
        names, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        parts = self._parts([c if self.cut_lines and c[:1] == "\n" else BLANK + c for c in names])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = np.frombuffer(b"".join(parts), np.int32)
        word_sizes = sizes[at]
        ends = np.cumsum(word_sizes)
        first = (np.cumsum(sizes) - sizes)[at] - (ends - word_sizes)
        flat = ids[np.repeat(first, word_sizes) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[chunks.offsets.to_numpy()]
        out = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i in odd:  # blanks that don't stand alone
            words = _WORD.findall(BLANK + texts[i].replace(" ", BLANK)) if texts[i] else []
            out[i] = np.frombuffer(b"".join(self._parts(words)), np.int32)
        return out

    def decode(self, encoded: list) -> list[str]:
        """The texts of lists of ids; the blank that stands before every text goes."""
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.concatenate([np.asarray(x, np.int64) for x in encoded]) if sizes.sum() else np.zeros(0, np.int64)
        size = self.raw_size[flat]
        ends = np.cumsum(size)
        whole = self.raw[np.repeat(self.raw_at[flat] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [whole[a + (a < b and whole[a] == 32) : b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]


_MODELS: dict[tuple[int, str], Pieces] = {}


def pieces(proto: bytes, kind: str = "bpe") -> Pieces:
    claim("pieces", _MODELS)
    key = (zlib.crc32(proto), kind)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Pieces(proto, kind)
    return _MODELS[key]


def _sent(spark: SparkSession, model_path: str):
    return spark.sparkContext.broadcast(Path(model_path).read_bytes())  # a vocabulary: its size doesn't follow the data


def encode(docs: DataFrame, model_path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids) of each document."""
    spark = ship(docs.sparkSession)
    proto = _sent(spark, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(proto.value, kind)
        for batch in batches:
            for keys, texts in slices(batch.column(0), batch.column(1), BATCH_CHARS):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(model.encode(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    spark = ship(encoded.sparkSession)
    proto = _sent(spark, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(proto.value)
        for batch in batches:
            texts = model.decode([ids or [] for ids in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def digest(docs: DataFrame, model_path: str, kind: str = "bpe") -> DataFrame:
    """Per document: ids, byte pieces among them, their CRC-32 (little-endian 32-bit ids), and whether decoding restores the text."""
    spark = ship(docs.sparkSession)
    proto = _sent(spark, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(proto.value, kind)
        bytes_ = np.zeros(len(model.text), bool)
        bytes_[list(model.byte.values())] = True
        for batch in batches:
            for keys, texts in slices(batch.column(0), batch.column(1), BATCH_CHARS):
                ids = model.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([int(bytes_[x].sum()) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([a == b for a, b in zip(model.decode(ids), texts, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "restored"],
                )

    return documents(docs).mapInArrow(run, "doc_id bigint, n_ids bigint, n_byte_ids bigint, ids_crc32 bigint, restored boolean")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), default_model())
