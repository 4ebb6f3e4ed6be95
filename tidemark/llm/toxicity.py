"""Toxicity by two class-conditional Kneser-Ney models over one shared backoff.

Each class model spells a document's words byte by byte, up to ``ORDER`` bytes back. A word counts in a class by the number
of different texts that have it (so that neither copies nor a text's own repeats add anything), shorter contexts count by
continuations, and every count is discounted by one, so that what was seen once is left to the shorter context. From
``SHARED`` bytes down both classes back off to the same counts: of how many different words of all documents each run of
bytes is a part. The difference of a word's log-likelihoods under the two models is its log-likelihood ratio.

Not every word of a toxic text is toxic: the toxic class spells a share ``SHARE`` of its words by the toxic model and the others
like the ordinary class, so a word adds log(1 - SHARE + SHARE * ratio). A document's log-likelihood ratio is the sum over its
different expressions (a word behind another), and is normalised by its length, their number: once per expression and
once per the root of the number, which is how chance sums grow. A logistic curve over the two, with no negative weight and classes
of equal weight, fitted on ratios from models that hadn't counted the document, turns them into a score.

What is fitted: at most ``SAMPLE_ROWS`` labelled rows and ``SAMPLE_CHARS`` characters of each class, the first by hash (at
least one row). What is counted: the shared counts come from the distinct words of every document, in tables that grow with
the corpus, are cut by checkpoints, and are joined with what the fitted rows need; runs of bytes that neither class has
counted are spelled alike by both models and cancel out. What is scored: every document, whole.

Defined cases: a text without a word has no evidence and a score at most half the threshold; without labels of both
classes every score is 0; a null label is no label, and the larger of several labels of one id counts; rows of a null
doc_id are scored and not held out; repeated rows are scored each.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import claim, cut, documents, ship, slices, table, trim, without

SAMPLE_ROWS = 2500
SAMPLE_CHARS = 8_000_000
ORDER, SHARED = 8, 5
SHARE = 0.01
LEAST, MOST = -5.0, 8.0  # bounds of a word's log-likelihood ratio
PER_WORDS = 20
THRESHOLD = 0.7
BATCH_CHARS = 2_000_000
CACHE_WORDS = 200_000
WORDS_AT_ONCE = 50_000
WORDS_SENT = 200_000
PARTS, MEASURES = 3, 2
_BYTE = np.uint64(8)
_MASK = [np.uint64((1 << (8 * n)) - 1) for n in range(9)]
# Letters of A-Z are lower-cased; other ASCII characters that aren't letters or digits part words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(word number of each word, the distinct words, first word of each text and the end)."""
    plain = pa.array([t.lower().encode("utf-8", "replace").translate(_WORDS) for t in texts], pa.large_binary())
    parts = pc.split_pattern(plain, b" ")
    coded = parts.values.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    at = coded.indices.to_numpy()
    real = np.ones(len(at), bool) if b"" not in names else at != names.index(b"")
    edges = np.concatenate([[0], np.cumsum(real)])[parts.offsets.to_numpy()]
    return at[real], names, edges


@dataclass(frozen=True)
class Order:
    """Log-likelihood differences of the n-grams of one length, and of the backoff weights of their contexts."""

    n: int
    grams: np.ndarray
    gain: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


@dataclass(frozen=True)
class Model:
    orders: list[Order]  # longest first
    curve: np.ndarray  # weights of the measures, and the constant


def chance(n, total):
    """The shared probability of a byte that ``n`` words have behind a context which ``total`` have."""
    return (n + 0.5) / (total + 128)


def positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its end: the last ORDER bytes as a number, and the word's index."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.frombuffer(b"".join(b"\x02%b\x03" % w for w in words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = text.astype(np.uint64)
    for j in range(1, ORDER):
        back = np.zeros(len(text), np.uint64)
        back[j:] = text[:-j]
        back[place < j] = 0
        key |= back << np.uint64(8 * j)
    real = place > 0
    return key[real], np.repeat(np.arange(len(words)), sizes)[real]


def _train(by_class: list[tuple[list[bytes], np.ndarray]], shared: tuple[np.ndarray, np.ndarray]) -> list[Order]:
    """The orders from (words, weights) of each class and the (grams, chances) of the shared order, ascending."""
    counts: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
    for words, weights in by_class:
        grams, times = np.zeros(0, np.uint64), np.zeros(0)
        for i in range(0, len(words), WORDS_AT_ONCE):
            key, owner = positions(words[i : i + WORDS_AT_ONCE])
            whole, more = np.concatenate([grams, key]), np.concatenate([times, weights[i : i + WORDS_AT_ONCE][owner]])
            del key, owner
            grams, at = np.unique(whole, return_inverse=True)
            times = np.bincount(at, weights=more)
        own = {ORDER: (grams, times)}
        for n in range(ORDER - 1, SHARED, -1):
            grams, kinds = np.unique(own[n + 1][0] & _MASK[n], return_counts=True)
            own[n] = (grams, kinds.astype(np.float64))
        counts.append(own)
    s_gram, s_share = shared

    def base(grams: np.ndarray) -> np.ndarray:
        if not len(s_gram):
            return np.full(len(grams), 1 / 256)
        slot = np.minimum(np.searchsorted(s_gram, grams), len(s_gram) - 1)
        return np.where(s_gram[slot] == grams, s_share[slot], chance(0, 0))

    orders: list[Order] = []
    below: tuple[np.ndarray, list[np.ndarray]] | None = None
    for n in range(SHARED + 1, ORDER + 1):
        grams = np.union1d(counts[0][n][0], counts[1][n][0])
        contexts, of = np.unique(grams >> _BYTE, return_inverse=True)
        chances, backs = [], []
        for c in (0, 1):
            own = np.zeros(len(grams))
            own[np.searchsorted(grams, counts[c][n][0])] = counts[c][n][1]
            total = np.bincount(of, weights=own, minlength=len(contexts))
            kinds = np.bincount(of, weights=own > 0, minlength=len(contexts))
            back = np.where(total > 0, kinds / np.maximum(total, 1), 1.0)  # the discount is 1
            lower = base(grams & _MASK[n - 1]) if below is None else below[1][c][np.searchsorted(below[0], grams & _MASK[n - 1])]
            chances.append(np.maximum(own - 1, 0) / np.maximum(total, 1)[of] + back[of] * lower)
            backs.append(back)
        below = (grams, chances)
        gain, back = np.log(chances[1] / chances[0]), np.log(backs[1] / backs[0])
        orders.append(Order(n, grams, gain.astype(np.float32), contexts, back.astype(np.float32)))
    return orders[::-1]


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return slot, (table[slot] == keys if len(table) else np.zeros(len(keys), bool))


def word_gains(words: list[bytes], orders: list[Order]) -> np.ndarray:
    """The log-likelihood difference of each word."""
    if len(words) > WORDS_AT_ONCE:
        return np.concatenate([word_gains(words[i : i + WORDS_AT_ONCE], orders) for i in range(0, len(words), WORDS_AT_ONCE)])
    key, owner = positions(words)
    gain, todo = np.zeros(len(key)), np.arange(len(key))
    for o in orders:
        grams = key[todo] & _MASK[o.n]
        slot, hit = _at(o.grams, grams)
        gain[todo[hit]] += o.gain[slot[hit]]
        todo = todo[~hit]
        slot, hit = _at(o.contexts, grams[~hit] >> _BYTE)
        gain[todo[hit]] += o.back[slot[hit]]
    return np.bincount(owner, weights=gain, minlength=len(words))


def evidence(texts: list[str], orders: list[Order], cache: dict[bytes, float] | None = None) -> np.ndarray:
    """The two length-normalised log-likelihood ratios of each text; 0 for a text without a word."""
    at, names, edges = words_of(texts)
    cache = {} if cache is None else cache
    if len(cache) > CACHE_WORDS:
        cache.clear()
    new = [w for w in names if w not in cache]
    if new:
        cache.update(zip(new, word_gains(new, orders).tolist(), strict=True))
    ratio = np.exp(np.clip(np.fromiter((cache[w] for w in names), np.float64, len(names)), LEAST, MOST))
    adds = np.log(1 - SHARE + SHARE * ratio)
    before = np.empty(len(at), np.int64)
    before[1:] = at[:-1]
    before[edges[:-1][edges[:-1] < edges[1:]]] = len(names)  # a text's first word
    kinds = len(names) + 1
    expressions = np.unique((np.repeat(np.arange(len(texts)), np.diff(edges)) * kinds + before) * kinds + at)
    owner, word = expressions // kinds**2, expressions % kinds
    total = np.bincount(owner, weights=adds[word], minlength=len(texts))
    n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    return np.column_stack([PER_WORDS * total / n, total / np.sqrt(n)])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and constant; measures that would get a negative weight are left out, one after another."""
    used = list(range(x.shape[1]))
    while True:
        w = _newton(x[:, used], y)
        if not used or w[:-1].min() >= 0:
            break
        used.pop(int(np.argmin(w[:-1])))
    out = np.zeros(x.shape[1] + 1)
    out[[*used, -1]] = w
    return out


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    weight = np.where(y == 1, 1.0, y.sum() / max(1.0, len(y) - y.sum()))  # classes weigh alike
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out() -> F.Column:
    """The rows whose labels are never learned from: crc32 of the doc_id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(turn, text, toxic) of at most ``rows`` labelled rows of each class, the first by hash."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    turn = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    parts = [own.where(F.col("toxic") == c).orderBy(turn, "doc_id").limit(rows) for c in (0, 1)]
    # At most 2 * rows ids: small enough to go to every task.
    joined = documents(docs).join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")
    return joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select(turn.alias("turn"), "text", "toxic")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: set[bytes] = set()

    def out() -> pa.RecordBatch:
        row = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary())], names=["word"])
        held.clear()
        return row

    for batch in batches:
        for _, texts in slices(batch.column(0), batch.column(0), BATCH_CHARS):
            held.update(words_of(texts)[1])
            if len(held) > WORDS_SENT:
                yield out()
    held.discard(b"")
    yield out()
    trim()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word): the distinct words of all documents; tasks send each of theirs once."""
    ship(docs.sparkSession)
    return documents(docs).select("text").mapInArrow(_words, "word binary").where(F.octet_length("word") > 0).distinct()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, _ = positions(batch.column(0).to_pylist())
        grams, n = np.unique(key & _MASK[SHARED], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])


def shared_counts(words: DataFrame) -> DataFrame:
    """(gram, n): of how many places in the distinct words each run of SHARED bytes is the end. It grows with the vocabulary."""
    return cut(words.mapInArrow(_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in slices(batch.column(0), batch.column(0), BATCH_CHARS):
            key, _ = positions([w for w in words_of(texts)[1] if w])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(key & _MASK[SHARED]).astype(np.int64))], names=["gram"])


def shared_chances(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(gram, chance) of the shared order, for the grams of the chosen rows: at most one row per byte of the bounded sample."""
    context = F.shiftright("gram", 8).alias("context")
    totals = counts.groupBy(context).agg(F.sum("n").alias("total"))
    needed = chosen.select("text").mapInArrow(_needed, "gram bigint").distinct()
    found = counts.join(needed, "gram", "left_semi").withColumn("context", context).join(totals, "context")
    return found.select("gram", chance(F.col("n"), F.col("total")).cast("double").alias("chance"))


def class_words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of the distinct texts, each with the number of texts that have it."""
    at, names, edges = words_of(list(dict.fromkeys(texts)))
    kinds = len(names) + 1
    pair = np.unique(np.repeat(np.arange(len(edges) - 1), np.diff(edges)) * np.int64(kinds) + at)
    times = np.bincount(pair % kinds, minlength=len(names))[: len(names)]
    used = np.flatnonzero(times)
    return [names[i] for i in used], times[used].astype(np.float64)


def within(rows: list[tuple[str, int]], chars: int) -> list[tuple[str, int]]:
    """The first rows of each class up to the one that would make more than ``chars`` characters; one at least."""
    out, held, full = [], {}, set()
    for text, label in rows:
        if label in held and held[label] + len(text) > chars:
            full.add(label)
        if label not in full:
            out.append((text, label))
            held[label] = held.get(label, 0) + len(text)
    return out


def _trained(chars: int):
    def run(rows: pa.Table, chances: pa.Table) -> pa.Table:
        rows = rows.sort_by([("turn", "ascending"), ("text", "ascending")])
        known = within(list(zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True)), chars)
        chances = chances.sort_by("gram")
        model = train(known, (chances.column("gram").to_numpy().astype(np.uint64), chances.column("chance").to_numpy()))
        out = pa.table([pa.array([] if model is None else [pickle.dumps(model)], pa.binary())], names=["model"])
        trim()
        return out

    return run


@dataclass(frozen=True)
class Fitted:
    """A model as bytes: the driver only hands it on."""

    blob: bytes

    def load(self) -> Model:
        return pickle.loads(self.blob)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Fitted | None:
    """None if a class has no example. The bounded sample and its chances are one task's; the driver gets the model only."""
    ship(docs.sparkSession)
    chosen = cut(sample(docs, labels, rows))
    if chosen.select("toxic").distinct().count() < 2:
        return None
    chances = shared_chances(shared_counts(cut(vocabulary(docs))), chosen)
    one = F.lit(0).alias("one")
    found = chosen.select("turn", "text", "toxic", one).groupBy("one").cogroup(chances.select("gram", "chance", one).groupBy("one")).applyInArrow(_trained(chars), "model binary").collect()
    return Fitted(bytes(found[0].model)) if found else None


def train(known: list[tuple[str, int]], counts: tuple[np.ndarray, np.ndarray]) -> Model | None:
    """The model of labelled texts; ``counts`` are the shared (grams, chances). Each part's evidence for the curve comes
    from models that were counted on the other parts."""
    both = lambda rows: {y for _, y in rows} == {0, 1}
    if not both(known):
        return None
    orders_of = lambda rows: _train([class_words([t for t, y in rows if y == c]) for c in (0, 1)], counts)
    # Copies of a text stay in one part.
    part = np.array([zlib.crc32(t.encode("utf-8", "replace")) % PARTS for t, _ in known])
    x = np.zeros((len(known), MEASURES))
    for k in range(PARTS):
        rest = [r for r, p in zip(known, part, strict=True) if p != k]
        own = np.flatnonzero(part == k)
        if len(own):
            x[own] = evidence([known[i][0] for i in own], orders_of(rest if both(rest) else known))
            trim()
    return Model(orders_of(known), _logistic(x, np.array([y for _, y in known], float)))


_KEPT: dict[int, tuple[Model, dict[bytes, float]]] = {}


def _scored(sent, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", _KEPT)
        if sent.id not in _KEPT:
            _KEPT.clear()
            _KEPT[sent.id] = (pickle.loads(sent.value), {})
        model, gains = _KEPT[sent.id]
        for batch in batches:
            texts = batch.column(text_at).fill_null("")
            found = [score(evidence(part, model.orders, gains), model) for _, part in slices(texts, texts, BATCH_CHARS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*names, "score"])

    return run


def score(x: np.ndarray, model: Model) -> np.ndarray:
    out = 1 / (1 + np.exp(-np.clip(x @ model.curve[:-1] + model.curve[-1], -30, 30)))
    return np.where((x == 0).all(axis=1), np.minimum(out, THRESHOLD / 2), out)


class _Sent:
    """A broadcast and a number that names it in the workers' caches."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def score_documents(docs: DataFrame, model: Fitted | None) -> DataFrame:
    """The rows of docs with ``score``, which replaces a column of that name; the others keep their values."""
    docs = without(docs, "score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    spark = ship(docs.sparkSession)
    sent = _Sent(spark.sparkContext.broadcast(model.blob))
    plain = docs.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(_scored(sent, plain.columns.index("text"), plain.columns), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
