"""A quality classifier by perplexity under interpolated modified Kneser-Ney models of trusted text.

The tokens are UTF-8 bytes. All trusted documents that are not held out are counted, a language
at a time, and the counts summed in shards dealt by n-gram; continuation counts, discounts and
context totals come from joining those counts with one another, all orders at once. What grows
with the text is the number of different n-grams, and much more slowly; their probabilities are
interpolated where they are gathered and go along to the scoring tasks. A document is kept if
its perplexity is at most a high quantile of those of all trusted documents of its language that
were held out, widened by a margin.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecast.llm.common import cut, prepare, remove, scratch


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    order: int = 5
    #: Trusted documents drawn for the model, and as many again for the quantiles; None: all there are.
    sample: int | None = None
    #: Trusted documents of a language, and held out, that it needs for a model and quantiles of its own.
    #: Where even all languages together have fewer held out, the limit is the mean and four standard
    #: deviations of all trusted documents.
    least_held_out: int = 50
    quantile: float = 0.995
    #: Bits a byte by which the quantile is widened; and bits that a number or address may cost a text besides.
    margin: float = 0.02
    extra: float = 150.0
    #: Shorter texts aren't judged.
    min_bytes: int = 100


# An n-gram's key is its bytes below a leading 1 in base 2^8, so that all orders up to 7 share one key space.


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Keys of the n-grams that end at each byte; what precedes the text counts as byte 0."""
    padded = np.concatenate([np.zeros(order - 1, np.int64), codes.astype(np.int64)])
    key = np.full(len(codes), 1, np.int64)
    for i in range(order):
        key = (key << 8) | padded[i : i + len(codes)]
    return key


def shorter(key: np.ndarray, order: int) -> np.ndarray:
    """The n-gram of the given order without its first byte."""
    return (key & ((1 << (8 * (order - 1))) - 1)) | (1 << (8 * (order - 1)))


#: n-grams that a task holds before it adds up what it has.
HOLD = 4_000_000


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = text_bytes(text)
                held.setdefault(lang or "", []).append(np.unique(grams(codes, order), return_counts=True))
                size += len(held[lang or ""][-1][0])
            if size > HOLD:
                held = {lang: [add_up(parts)] for lang, parts in held.items()}
                size = 0
        for lang, parts in held.items():
            keys, n = add_up(parts)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(keys)), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["lang", "key", "n"])

    return run


def estimates(counts: DataFrame, order: int) -> DataFrame:
    """counts (lang, key, n) of the highest order: rows (lang, order, key, alpha, weight) for the n-grams of every order.

    Below the highest order an n-gram counts the different bytes before it. alpha is its
    discounted share of its context's total, and weight what the context leaves to the next
    shorter n-gram. All orders go through the same three shuffles: by n-gram, by the n-gram
    without its first byte, and by context.
    """
    tail = lambda k: F.col("key").bitwiseAND(F.lit((1 << (8 * k)) - 1)).bitwiseOR(F.lit(1 << (8 * k)))
    # every n-gram that ends one of the highest order, once, with its order
    every = counts.select("lang", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("order"), (F.col("key") if k == order else tail(k)).alias("key")) for k in range(1, order + 1)])).alias("g"))
    every = every.groupBy("lang", F.col("g.order").alias("order"), F.col("g.key").alias("key")).agg(F.sum("n").alias("n"))
    every = cut(every)
    low = F.expr("shiftleft(1L, CAST(8 * (order - 1) AS INT))")
    before = every.where("order > 1").select("lang", (F.col("order") - 1).alias("order"), F.col("key").bitwiseAND(low - 1).bitwiseOR(low).alias("key"))
    levels = cut(before.groupBy("lang", "order", "key").agg(F.count("*").alias("n")).unionByName(every.where(F.col("order") == order)))
    of = levels.groupBy("lang", "order").agg(*[F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)])
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    discount = lambda i: F.when((F.col("t1") > 0) & (F.col(f"t{i}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i * 0.95), i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")))).otherwise(F.lit(0.5))
    # a row for each order of each language that has a model
    known = F.broadcast(of.select("lang", "order", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)]))
    rows = levels.join(known, ["lang", "order"])
    rows = rows.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    context = Window.partitionBy("lang", "order", F.shiftright("key", 8))
    total = F.sum("n").over(context)
    return rows.select("lang", "order", "key", ((F.col("n") - F.col("d")) / total).alias("alpha"), (F.sum("d").over(context) / total).alias("weight"))


class Table:
    """An open-addressed table from long keys to floats, looked up an array at a time."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(1.4 * len(keys) + 1).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, np.int64), np.zeros(size, np.float32)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = keys[left[free]]  # of several for a place, one gets it
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (size - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the key is there."""
        at = self._first(keys)
        there = self.keys[at]
        found = there == keys
        values = np.where(found, self.values[at], np.float32(0))
        left = np.flatnonzero(~found & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            found[left[hit]] = True
            values[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return values, found


@dataclass
class Model:
    """A language's log2 probabilities and back-off weights, by order."""

    order: int
    p: list[Table]
    back: list[Table]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of each byte's probability after those before it."""
        out = np.zeros(len(codes), np.float64)
        left, key = np.arange(len(codes)), grams(codes, self.order)
        for k in range(self.order, 0, -1):
            value, found = self.p[k].get(key)
            out[left[found]] -= value[found]
            left, key = left[~found], key[~found]
            if not len(left):
                break
            weight, known = self.back[k - 1].get(key >> 8)
            out[left[known]] -= weight[known]
            key = shorter(key, k) if k > 1 else key
        else:
            out[left] += 8.0  # a byte never seen: the uniform distribution, below the last back-off
        return out


#: Bytes of short texts that are looked up together.
TOGETHER = 1 << 15


def means(texts: list[np.ndarray], model: Model) -> list[float]:
    """The mean bits of each text; none is empty. Texts are looked up one behind the other, with bytes 0 between them."""
    gap = np.zeros(model.order - 1, np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    firsts = np.cumsum(lengths + len(gap)) - lengths - len(gap)
    found = model.bits(np.concatenate([part for t in texts for part in (t, gap)]))
    # sums from each text's first byte to its last, then over the gap behind it
    bounds = np.stack([firsts, firsts + lengths], 1).ravel()
    sums = np.add.reduceat(np.append(found, 0.0), bounds)[::2]
    return (sums / lengths).tolist()


def judged(texts: list[str | None], langs: list[str | None], models: dict[str, Model], most: dict[str, float], settings: Settings) -> list[tuple[int, float | None, bool]]:
    """Of each text its bytes, bits per byte (null: no model or no byte) and whether it is kept."""
    codes = [text_bytes(t) for t in texts]
    bits: list[float | None] = [None] * len(codes)
    waiting: dict[str, list[int]] = {}
    size: dict[str, int] = {}

    def look_up(name: str) -> None:
        at = waiting.pop(name)
        for i, mean in zip(at, means([codes[i] for i in at], models[name])):
            bits[i] = mean

    for i, (lang, text) in enumerate(zip(langs, codes)):
        name = lang if lang in models else ""
        if name in models and len(text):
            waiting.setdefault(name, []).append(i)
            size[name] = (size[name] if len(waiting[name]) > 1 else 0) + len(text)
            if size[name] >= TOGETHER:
                look_up(name)
    for name in list(waiting):
        look_up(name)
    out = []
    for text, mean, lang in zip(codes, bits, langs):
        known = most.get(lang or "", most.get(""))
        sure = mean is None or known is None or len(text) < settings.min_bytes
        out.append((len(text), mean, sure or mean <= known + settings.margin + settings.extra / len(text)))
    return out


@dataclass
class Classifier:
    """Broadcast models and the most bits per byte that are kept; '' serves languages without their own."""

    models: Broadcast
    most: dict[str, float]
    settings: Settings


#: 64-bit words in a map of hashed ids: 8 MB at every size. It only saves the shuffle of texts that no label names.
SIEVE_WORDS = 1 << 20


def _sieve(docs: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows of docs whose `on` may be in ids: all that are, and some that are not."""
    of = lambda h: F.pmod(F.shiftright(h, 6), F.lit(SIEVE_WORDS)).cast("int")
    h = F.xxhash64(on)
    found = ids.select(of(h).alias("word"), h.alias("h")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("bits")).toArrow()
    words = np.zeros(SIEVE_WORDS, np.int64)
    words[np.asarray(found["word"])] = np.asarray(found["bits"])
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column("__h"))
            yield batch.filter(pa.array((shared.value[(h >> 6) % SIEVE_WORDS] >> (h & 63)) & 1 == 1, pa.bool_()))

    return docs.withColumn("__h", h).mapInArrow(run, docs.withColumn("__h", h).schema).drop("__h")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Classifier:
    """Fits models and quantiles on all documents labelled quality 1 and not toxic: half of them train, half are held out.

    Labels without a document, null labels and documents of no trusted label do not matter;
    of several rows with one trusted id the least text counts. Without trusted text there is
    no model and everything is kept. The driver and each Python worker hold the different
    n-grams of all orders and languages.
    """
    spark = docs.sparkSession
    prepare(spark)
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col(key).isNotNull()).select(F.col(key).alias("__id")).distinct()
    if settings.sample is not None:
        trusted = trusted.orderBy(F.xxhash64("__id"), "__id").limit(2 * settings.sample)
    rows = docs.select(F.col(key).alias("__id"), F.struct(F.col(lang).cast("string").alias("lang"), F.coalesce(text, F.lit("")).alias("text")).alias("d"))
    # of the rows of one id, one
    rows = _sieve(rows, trusted, "__id").join(trusted, "__id").groupBy("__id").agg(F.min("d").alias("d"))
    path = scratch(spark, "trusted")
    rows.select("d.*", (F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)) == 0).alias("__test")).write.option("compression", "zstd").parquet(path)
    sample = spark.read.parquet(path)
    languages = [r.lang for r in sample.where("lang <> ''").groupBy("lang").count().where(F.col("count") >= settings.least_held_out).collect()]
    own = F.when(F.col("lang").isin(languages), F.col("lang")).otherwise(F.lit("")) if languages else F.lit("")
    order = settings.order
    own_counts = sample.where("NOT __test").select(own.alias("lang"), "text").mapInArrow(_count(order), "lang string, key long, n long")
    own_counts = cut(own_counts.groupBy("lang", "key").agg(F.sum("n").alias("n")))
    # '' is the model of all languages together
    pooled = own_counts.groupBy("key").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "key", "n")
    counts = cut(own_counts.where("lang <> ''").unionByName(pooled))
    models = _models(_gathered(estimates(counts, order)), order)
    found = Classifier(spark.sparkContext.broadcast(models), {}, settings)
    scored = scratch(spark, "trusted-bits")

    def bits(chosen: DataFrame) -> DataFrame:
        return scores(chosen, found, "__test", "text", "lang", carry=True).where((F.col("n_bytes") >= settings.min_bytes) & F.col("bits").isNotNull())

    bits(sample.where("__test")).select(F.when(F.col("lang").isin(list(models)), F.col("lang")).otherwise(F.lit("")).alias("lang"), "bits").write.parquet(scored)
    held = spark.read.parquet(scored)
    held = held.select(F.explode(F.array_distinct(F.array("lang", F.lit("")))).alias("lang"), "bits")
    found.most = quantiles(held, settings.quantile, settings.least_held_out)
    if "" not in found.most:
        every = bits(sample).agg(F.avg("bits").alias("mean"), F.stddev_pop("bits").alias("deviation")).first()
        if every.mean is not None:
            found.most[""] = every.mean + 4 * every.deviation
    remove(spark, path)
    remove(spark, scored)
    return found


def quantiles(rows: DataFrame, q: float, least: int) -> dict[str, float]:
    """The exact quantile of the bits of each lang of rows (lang, bits) that has at least so many.

    The two values beside the quantile are found by counting ranges of bits, then ranges of the
    ranges they lie in, then values: what is collected does not grow with the rows.
    """
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().where(F.col("count") >= least).collect()}
    at = {name: (n - 1) * q for name, n in sizes.items()}
    # lang and rank: the range it lies in, and its rank there
    places = {(name, rank): (0.0, rank) for name, x in at.items() for rank in {int(x), min(int(x) + 1, sizes[name] - 1)}}
    within = F.lit(0.0)
    for digit in (F.floor(F.col("bits") * 256).cast("double"), F.floor(F.col("bits") * (1 << 20)).cast("double"), F.col("bits")) if places else ():
        asked = rows.sparkSession.createDataFrame(sorted({(name, low) for (name, _), (low, _) in places.items()}), "lang string, low double")
        counted: dict[tuple[str, float], list[tuple[float, int]]] = {}
        for r in rows.withColumn("low", within).join(F.broadcast(asked), ["lang", "low"]).groupBy("lang", "low", digit.alias("digit")).count().collect():
            counted.setdefault((r["lang"], r["low"]), []).append((r["digit"], r["count"]))
        for (name, rank), (low, left) in places.items():
            for value, n in sorted(counted[name, low]):
                if left < n:
                    places[name, rank] = (value, left)
                    break
                left -= n
        within = digit
    value = {k: v for k, (v, _) in places.items()}
    return {name: value[name, int(x)] + (x - int(x)) * (value[name, min(int(x) + 1, sizes[name] - 1)] - value[name, int(x)]) for name, x in at.items()}


def _gathered(rows: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, ...]]:
    """Keys, alphas and weights by language and order, a partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        langs = table["lang"].combine_chunks().dictionary_encode()
        where, level = np.asarray(langs.indices), np.asarray(table["order"])
        parts = []
        for i, name in enumerate(langs.dictionary.to_pylist()):
            for k in np.unique(level[where == i]).tolist():
                mine = np.flatnonzero((where == i) & (level == k))
                parts.append((name, k, np.asarray(table["key"])[mine].tobytes(), *(np.asarray(table[c])[mine].astype(np.float32).tobytes() for c in ("alpha", "weight"))))
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*parts), kinds)], names=["lang", "order", "key", "alpha", "weight"])

    found: dict[tuple[str, int], list] = {}
    for r in cut(rows.mapInArrow(run, "lang string, order int, key binary, alpha binary, weight binary")).toLocalIterator():
        found.setdefault((r["lang"], r["order"]), []).append((np.frombuffer(r["key"], np.int64), np.frombuffer(r["alpha"], np.float32), np.frombuffer(r["weight"], np.float32)))
    return {k: tuple(map(np.concatenate, zip(*parts))) for k, parts in found.items()}


def _models(found: dict[tuple[str, int], tuple[np.ndarray, ...]], order: int) -> dict[str, Model]:
    """Interpolates the estimates, order by order, and puts each language's into tables."""
    made = {}
    for name in sorted({name for name, _ in found}):
        p, back = [Table(np.zeros(0, np.int64), np.zeros(0, np.float32))], []
        below_keys, below = np.zeros(0, np.int64), np.zeros(0)
        for k in range(1, order + 1):
            own, alpha, weight = found.pop((name, k))
            by_key = np.argsort(own)
            own, alpha, weight = own[by_key], alpha[by_key].astype(np.float64), weight[by_key].astype(np.float64)
            lower = below[np.searchsorted(below_keys, shorter(own, k))] if k > 1 else 1 / 256
            below_keys, below = own, alpha + weight * lower
            p.append(Table(own, np.log2(below).astype(np.float32)))
            contexts, first = np.unique(own >> 8, return_index=True)
            back.append(Table(contexts, np.log2(weight[first]).astype(np.float32)))
        made[name] = Model(order, p, back)
    return made


def scores(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text", lang: str = "lang", carry: bool = False) -> DataFrame:
    """(key, n_bytes, bits, perplexity, kept) for every row of docs; carry adds lang.

    bits is the mean of -log2 p over the bytes, perplexity is 2^bits. Null and empty texts
    have no bits and are kept, as are texts of fewer than min_bytes. Other columns are not read.
    """
    models, most, settings = classifier.models, classifier.most, classifier.settings
    fields = [docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("bits", T.DoubleType()), T.StructField("perplexity", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    fields += [T.StructField("lang", T.StringType())] * carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = judged(batch.column(1).to_pylist(), batch.column(2).to_pylist(), models.value, most, settings)
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())]
            columns += [pa.array([None if r[1] is None else 2 ** r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(2)] * carry, names=[f.name for f in fields])

    return docs.select(F.col(key), F.col(text), F.col(lang).cast("string").alias("__lang")).mapInArrow(run, T.StructType(fields))


def quality_filter(docs: DataFrame, classifier: Classifier, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    models, most, settings = classifier.models, classifier.most, classifier.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = judged(batch.column(text).to_pylist(), batch.column(lang).to_pylist(), models.value, most, settings)
            yield batch.filter(pa.array([r[2] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
