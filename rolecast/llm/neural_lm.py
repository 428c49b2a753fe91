"""Scores texts with a log-bilinear neural language model, beside a unigram baseline.

The network predicts the class of the next token from the classes of the CONTEXT tokens
before it: the most frequent words are classes of their own, all others share buckets by
their endings. The context's vectors add up to a prediction, which a class's vector and
bias rate; batched matrix products over all classes give normalised log-probabilities. It
is trained in numpy with noise-contrastive estimation: every partition of the training
documents continues from the same parameters, and the results are averaged, weighted by
the positions seen. Within a bucket a word has its smoothed share of the bucket's training
tokens, one share being left for all unseen words, so that the probabilities of all texts
add up to one.

Counts come from all training documents. Words of at least 1 / HEAD of all tokens, at most
HEAD of them, are looked up where the text is; the rest of a text's words meet their counts
in a join, which no word can skew since none of them is frequent.
"""

import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecast.llm.common import cut, prepare

SEED = 42
SMOOTH = 0.1
#: Bound on the words with counts at hand, and the entries of a worker's word cache.
HEAD, CACHE = 200_000, 300_000
FLUSH_WORDS = 200_000
END = b""
MARKS = b".,;:!?*$%&#|<>\"')("


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    words: int = 160
    buckets: int = 64
    context: int = 4
    width: int = 24
    noise: int = 48
    batch: int = 512
    rate: float = 0.08
    #: The first round sees every position of one training document in `pilot`, the second one position in `stride` of all: each.
    pilot: int = 24
    stride: int = 1


def key_of(word: bytes) -> int:
    """A word's key; that of the end is the key of no bytes."""
    return xxhash.xxh64_intdigest(word, SEED) - (1 << 63)


def bucket_of(word: bytes, buckets: int) -> int:
    bare = word.rstrip(MARKS)
    end = len(bare)
    return zlib.crc32(bare[-3:] + b"\0" + word[end : end + 1]) % buckets


def tokens(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case, and the end."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END)
    return found


def _count(buckets: int):
    def out(held: Counter) -> pa.RecordBatch:
        keys = pa.array([key_of(w) for w in held], pa.int64())
        groups = pa.array([bucket_of(w, buckets) for w in held], pa.int32())
        return pa.RecordBatch.from_arrays([keys, groups, pa.array(list(held.values()), pa.int64())], names=["key", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
            if len(held) > FLUSH_WORDS:
                yield out(held)
                held = Counter()
        if held:
            yield out(held)

    return run


@dataclass
class Vocabulary:
    """The frequent words' keys (sorted) and counts, the class of each (or -1), and each class's totals."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    types: int
    class_tokens: np.ndarray
    class_types: np.ndarray
    settings: Settings
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def size(self) -> int:
        return self.settings.words + self.settings.buckets


class Lookup:
    """Numbers words as they come and keeps, by number, their class, key and count (-1: not at hand)."""

    def __init__(self, known: Vocabulary):
        self.known = known
        self.reset()

    def reset(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.classes = self.keys = self.counts = np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        known, s = self.known, self.known.settings
        keys = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
        keys = (keys ^ np.uint64(1 << 63)).view(np.int64)  # as key_of
        classes = np.fromiter((s.words + bucket_of(w, s.buckets) for w in words), np.int64, len(words))
        at = np.minimum(np.searchsorted(known.keys, keys), max(0, len(known.keys) - 1))
        there = known.keys[at] == keys if len(known.keys) else np.zeros(len(keys), bool)
        own = there.copy()
        own[there] = known.classes[at[there]] >= 0
        classes[own] = known.classes[at[own]]
        counts = np.full(len(keys), -1, np.int64)
        counts[there] = known.counts[at[there]]
        self.classes = np.concatenate([self.classes, classes])
        self.keys, self.counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts, one after the other, and each text's number of tokens."""
        if len(self.number) > CACHE:
            self.reset()
        words, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = tokens(text)
            sizes[i] = len(found)
            words += found
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = len(self.number) - len(self.keys)
        if new:
            self._learn(list(islice(reversed(self.number), new))[::-1])
        return out, sizes


_LOOKUPS: dict[str, Lookup] = {}


def lookup(known: Vocabulary) -> Lookup:
    """The worker process's lookup for a vocabulary: it outlives the task, and the last one is kept."""
    if known.name not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[known.name] = Lookup(known)
    return _LOOKUPS[known.name]


def vocabulary(train: DataFrame, settings: Settings) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of train (text), and the counts (key, bucket, n) of all its words."""
    counts = cut(train.mapInArrow(_count(settings.buckets), "key long, bucket int, n long").groupBy("key").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n")))
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = sorted((r.n, r.key, r.bucket) for r in counts.where(F.col("n") * HEAD >= total).collect())[::-1]
    own = {key: i for i, (_, key, _) in enumerate(head[: settings.words])}
    size = settings.words + settings.buckets
    class_tokens, class_types = np.zeros(size), np.zeros(size)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_tokens[settings.words + r.bucket], class_types[settings.words + r.bucket] = r.n, r.v
    for n, key, bucket in head[: settings.words]:
        class_tokens[own[key]], class_types[own[key]] = n, 1
        class_tokens[settings.words + bucket] -= n
        class_types[settings.words + bucket] -= 1
    by_key = sorted((key, n) for n, key, _ in head)
    keys = np.array([k for k, _ in by_key], np.int64)
    found = Vocabulary(keys, np.array([n for _, n in by_key], np.int64), np.array([own.get(k, -1) for k, _ in by_key], np.int64), int(total), int(types), class_tokens, class_types, settings)
    return found, counts


class Network:
    """Context vectors by place, class vectors and class biases, in one flat array."""

    def __init__(self, flat: np.ndarray, size: int, settings: Settings):
        self.flat, self.size, self.settings = flat, size, settings
        c, d = settings.context, settings.width
        cuts = np.cumsum([c * (size + 1) * d, size * d, size])
        self.context = flat[: cuts[0]].reshape(c, size + 1, d)
        self.vectors = flat[cuts[0] : cuts[1]].reshape(size, d)
        self.bias = flat[cuts[1] : cuts[2]]

    @staticmethod
    def initial(known: Vocabulary) -> np.ndarray:
        s, size = known.settings, known.size
        draw = np.random.default_rng(SEED)
        n = s.context * (size + 1) * s.width + size * s.width
        share = (known.class_tokens + SMOOTH) / (known.class_tokens + SMOOTH).sum()
        return np.concatenate([draw.normal(0, 0.1, n), np.log(share)]).astype(np.float32)

    def windows(self, classes: np.ndarray, sizes: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """For each token of texts, one after the other, the classes before it, the nearest first; `size` stands before a start."""
        c = self.settings.context
        places = np.arange(len(classes)) + c * np.repeat(np.arange(1, len(sizes) + 1), sizes)
        padded = np.full(len(classes) + c * len(sizes), self.size)
        padded[places] = classes
        places = places[at]
        return np.stack([padded[places - 1 - i] for i in range(c)])

    def predictions(self, windows: np.ndarray) -> np.ndarray:
        out = self.context[0].take(windows[0], 0)
        for i, w in enumerate(windows[1:], 1):
            out += self.context[i].take(w, 0)
        return out

    def log10(self, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Normalised log-probabilities of the targets, by products of a block of tokens with all classes."""
        out, ones = np.empty(len(targets)), np.ones(self.size, np.float32)
        for a in range(0, len(targets), 512):  # a block's ratings stay in the cache
            b = min(len(targets), a + 512)
            rated = self.predictions(windows[:, a:b]) @ self.vectors.T
            rated += self.bias
            if rated.max() > 60:
                np.minimum(rated, 60, out=rated)
            mine = rated[np.arange(b - a), targets[a:b]]
            np.exp(rated, out=rated)
            out[a:b] = mine - np.log(rated @ ones)
        return out / np.log(10)

    def train(self, windows: np.ndarray, targets: np.ndarray, squares: np.ndarray, share: np.ndarray, draw: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation with Adagrad, a block of positions at a time."""
        s, size, d = self.settings, self.size, self.settings.width
        order = draw.permutation(len(targets))
        odds = (np.log(share) + np.log(s.noise)).astype(np.float32)
        step = Network(np.zeros_like(self.flat), size, s)
        cells, edges = np.arange((size + 1) * d).reshape(size + 1, d), np.r_[0, np.cumsum(share)[:-1]]

        def added(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
            """The sums of the rows by their place."""
            return np.bincount(cells.take(at, 0).ravel(), rows.ravel(), n * d).reshape(n, d)

        for a in range(0, len(order), s.batch):
            at = order[a : a + s.batch]
            n, w, t = len(at), windows.take(at, 1), targets.take(at)
            noise = np.searchsorted(edges, draw.random(s.noise), side="right") - 1
            r = self.predictions(w)
            v, q = self.vectors.take(t, 0), self.vectors.take(noise, 0)
            hit = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", r, v) + (self.bias - odds).take(t), -30, 30)))  # 1 - sigma
            miss = r @ q.T
            miss += (self.bias - odds).take(noise)
            np.clip(miss, -30, 30, out=miss)
            np.exp(np.negative(miss, out=miss), out=miss)
            miss += 1
            np.divide(-1, miss, out=miss)  # - sigma
            step.vectors[:] = added(hit[:, None] * r, t, size)
            step.vectors += added(miss.T @ r, noise, size)
            step.bias[:] = np.bincount(t, hit, size) + np.bincount(noise, miss.sum(0), size)
            back = (hit[:, None] * v + miss @ q).astype(np.float64)
            for i in range(s.context):
                step.context[i] = added(back, w[i], size + 1)
            g = step.flat
            g /= n
            squares += g * g
            g *= s.rate
            g /= np.sqrt(squares + np.float32(1e-6))
            self.flat += g


def _learn(known, stride: int, settings: Settings):
    """Emits a partition's parameters, weighted by the positions it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = known.value
        net, look = Network(start.copy(), words.size, settings), lookup(words)
        squares = np.full(len(start), 1e-4, np.float32)
        share = words.class_tokens + SMOOTH
        share = share / share.sum()
        draw, seen = np.random.default_rng(SEED), 0
        for batch in batches:
            numbers, sizes = look.numbers(batch.column(0).to_pylist())
            classes = look.classes[numbers]
            at = np.arange(int(sizes[0] % stride) if len(sizes) else 0, len(classes), stride)
            if len(at):
                net.train(net.windows(classes, sizes, at), classes[at], squares, share, draw)
                seen += len(at)
        if seen:
            yield pa.record_batch([pa.array(np.arange(len(start), dtype=np.int32)), pa.array(net.flat.astype(np.float64) * seen), pa.array(np.full(len(start), seen, np.int64))], names=["i", "value", "seen"])

    return run


def fit(docs: DataFrame, settings: Settings = Settings()) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """docs (doc_id, text, held_out): the vocabulary, the network's parameters, and all counts."""
    spark = docs.sparkSession
    train = docs.where("not held_out")
    known, counts = vocabulary(train.select("text"), settings)
    flat = Network.initial(known)
    if known.tokens:
        rounds = ((train.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(settings.pilot)) == 0), 1), (train, settings.stride))
        for part, stride in rounds:
            shared = spark.sparkContext.broadcast((known, flat))
            learned = part.select("text").mapInArrow(_learn(shared, stride, settings), "i int, value double, seen long")
            means = learned.groupBy("i").agg((F.sum("value") / F.sum("seen")).alias("v")).collect()
            if means:
                flat = np.zeros_like(flat)
                flat[[r.i for r in means]] = [r.v for r in means]
    return known, flat, counts


PARTS = "row long, key long, n long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score(shared, key_field: T.StructField, settings: Settings):
    """A row for each text with what is known here, and one for each of its rarer words."""
    names = [key_field.name, *(x.split()[0] for x in PARTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, flat = shared.value
        net, look = Network(flat, known.size, settings), lookup(known)
        totals = np.log10(known.class_tokens + SMOOTH * (known.class_types + 1))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            number, sizes = look.numbers(batch.column(1).to_pylist())
            classes, counts = look.classes[number], look.counts[number]
            text = np.repeat(np.arange(len(sizes)), sizes)
            here, inner = counts >= 0, classes >= settings.words
            logs = np.where(here, np.log10(np.maximum(counts, 0) + SMOOTH), 0.0)
            own = np.where(inner, logs - totals[classes], 0.0)
            if known.tokens:
                own += net.log10(net.windows(classes, sizes), classes)
            sums = lambda values: np.bincount(text, weights=values, minlength=len(sizes))
            rows = row + np.arange(len(sizes))
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows), pa.array([key_of(str(r).encode()) for r in rows.tolist()], pa.int64()), pa.array(np.zeros(len(sizes), np.int64)),
                 batch.column(2), pa.array(sizes), pa.array(sums(here).astype(np.int64)), pa.array(sums(logs)), pa.array(sums(own))],
                names=names,
            )
            rare, times = np.unique((text * len(look.keys) + number)[~here], return_counts=True)
            if len(rare):
                none = [pa.nulls(len(rare), t) for t in (batch.schema.field(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                owner, word = np.divmod(rare, len(look.keys))
                yield pa.RecordBatch.from_arrays([none[0], pa.array(rows[owner]), pa.array(look.keys[word]), pa.array(times.astype(np.int64)), *none[1:]], names=names)

    return run


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Held out are the rows whose crc32 of the key as text is a multiple of 10 (a null key: as
    the empty text); all others train. Null and blank texts are their end alone. Repeated
    rows are scored alike and count as often as they occur. Without training text every
    score is the baseline's. Other columns are not read. Rows are numbered as they are read,
    so docs is to be a stored table, which a repeated task reads in the same order.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 10 == 0
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))
    known, flat, counts = fit(rows, settings)
    shared = spark.sparkContext.broadcast((known, flat))
    field = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    parts = rows.mapInArrow(_score(shared, field, settings), T.StructType([field, *T._parse_datatype_string(PARTS).fields]))
    rare = counts.where(F.col("n") * HEAD < known.tokens).select("key", F.col("n").alias("c"))
    met = parts.join(rare, "key", "left")
    worth = F.when(F.col("n") > 0, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).otherwise(F.lit(0.0))
    told = F.when(F.col("c").isNotNull(), F.col("n")).otherwise(F.lit(0))
    whole = met.groupBy("row").agg(
        F.first("doc_id", True).alias(key),
        F.first("held_out", True).alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(told)).alias("n_known"),
        F.max("base").alias("base"),
        F.max("score").alias("own"),
        F.sum(worth).alias("rare"),
    )
    level = F.col("n_tokens") * F.lit(float(np.log10(known.tokens + SMOOTH * (known.types + 1))))
    base = F.col("base") + F.col("rare") - level
    score = F.col("own") + F.col("rare") if known.tokens else base
    return whole.select(key, "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
