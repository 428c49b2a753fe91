"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Only the last incomplete piece of a document needs a place; full pieces are sequences of
their own. The pieces are dealt by hash to problems of a bounded number of pieces. For each
problem several islands breed packings, beginning with pieces put by best fit in random
orders: a crossover injects whole well-filled bins of one parent into the other, drops the
other's bins that hold duplicates and some that are poorly filled, and puts the displaced
pieces back by best fit, longest first; a mutation empties the least filled bins and some
drawn ones in the same way. After each round every island receives its neighbour's elite.
The best packing of any island is taken.
"""

import json
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecast.llm.common import cut, partitions, prepare

END = 0


@dataclass(frozen=True)
class Evolution:
    """Production parameters."""

    problem: int = 8192
    islands: int = 2
    rounds: int = 3
    generations: int = 30
    population: int = 5
    #: The most, as shares: of a parent's bins that a crossover injects, best filled first; of the other's bins without
    #: duplicates that it displaces, and of bins that a mutation empties, least filled first; of bins that it empties as drawn.
    inject: float = 0.7
    displace: float = 1.0
    empty: float = 0.8
    drawn: float = 0.4


# Tokenising -----------------------------------------------------------------------------

_TOKENIZERS: dict[str, "Tokens"] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible bytes stand for themselves, the rest for 256 and on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {chr(b): b for b in seen}
    return stand | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(seen))}


class Tokens:
    """Ids of a byte-level BPE file of `tokenizers`.

    Where the file's merges are ranked as its ids are, a rank encoder with the same
    vocabulary gives the same ids several times as fast; texts that hold an added token's
    string, and other files, go through `tokenizers` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        model, stand = spec["model"], _byte_alphabet()
        before = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if model.get("type") == "BPE" and plain and not model.get("dropout") and not model.get("ignore_merges"):
            vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            ids = [vocab.get("".join(m), -1) for m in pairs]
            if all(a < b for a, b in zip(ids, ids[1:])) and min(ids, default=0) >= 0 and len(ids) + 256 == len(vocab):
                import public_tokenizers

                ranks = {bytes(stand[c] for c in t): i for t, i in vocab.items()}
                self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def tokens(path: str | None) -> Tokens:
    """The tokenizer of a worker process, read once. None: the byte-level vocabulary that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokens(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, row): a document's ids and id 0, cut from its end into pieces of `size`.

    row numbers the pieces of all documents. Null text counts as empty: the one id 0.
    """
    names = ["piece", "start", "length", "ids_crc32", "row"]
    fields = T.StructType([docs.schema[key], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens(tokenizer).ids
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at, made = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(t or ""), np.array([END], "<u4")).astype("<u4", copy=False)
                start, n = 0, 0
                first = len(ids) % size or size
                while start < len(ids):
                    end = start + (first if start == 0 else size)
                    made.append((n, start, end - start, zlib.crc32(ids[start:end].tobytes()), row))
                    at.append(i)
                    start, n, row = end, n + 1, row + 1
            columns = [pa.array([m[j] for m in made], pa.int64() if j else pa.int32()) for j in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, *names])

    return docs.select(key, text).mapInArrow(run, fields)


# Breeding -------------------------------------------------------------------------------


class Problem:
    """Pieces to be packed into bins of `size`; a packing is an array of the bin of each piece."""

    def __init__(self, lengths: np.ndarray, size: int, seed: int):
        self.lengths, self.size, self.draw = lengths, size, random.Random(seed)
        self.list = lengths.tolist()

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, weights=self.lengths).astype(np.int64)

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins are better; of as many, unevenly filled ones."""
        fills = self.fills(bins)
        fills = fills[fills > 0]
        return -len(fills), float(((fills / self.size) ** 2).mean()) if len(fills) else 0.0

    def tidy(self, bins: np.ndarray) -> np.ndarray:
        return np.unique(bins, return_inverse=True)[1].astype(np.int32)

    def best_fit(self, bins: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """Puts each loose piece, in the order given, into the fullest bin that has room, or a new one."""
        held = bins.copy()
        held[loose] = -1
        placed = held >= 0
        fills = np.bincount(held[placed], weights=self.lengths[placed]).astype(np.int64) if placed.any() else np.zeros(0, np.int64)
        room: list[list[int]] = [[] for _ in range(self.size + 1)]
        there = 0
        for b, fill in enumerate(fills.tolist()):
            if 0 < fill < self.size:
                room[self.size - fill].append(b)
                there |= 1 << (self.size - fill)
        new = len(fills)
        for i in loose.tolist():
            n = self.list[i]
            above = there >> n
            if above:
                left = n + (above & -above).bit_length() - 1
                b = room[left].pop()
                if not room[left]:
                    there &= ~(1 << left)
            else:
                b, left, new = new, self.size, new + 1
            held[i] = b
            if left > n:
                room[left - n].append(b)
                there |= 1 << (left - n)
        return self.tidy(held)

    def longest_first(self, pieces: np.ndarray) -> np.ndarray:
        return pieces[np.argsort(-self.lengths[pieces], kind="stable")]

    def start(self) -> np.ndarray:
        """Best fit in a random order."""
        order = list(range(len(self.list)))
        self.draw.shuffle(order)
        return self.best_fit(np.full(len(order), -1, np.int32), np.array(order, np.int64))

    def cross(self, one: np.ndarray, other: np.ndarray, how: Evolution) -> np.ndarray:
        """Whole well-filled bins of `other` go into `one`."""
        given_fills, own_fills = self.fills(other), self.fills(one)
        count = max(1, int(len(given_fills) * how.inject * (0.5 + self.draw.random() / 2)))
        chosen = np.zeros(len(given_fills), bool)
        chosen[np.argsort(-given_fills, kind="stable")[:count]] = True
        given = chosen[other]
        gone = np.zeros(len(own_fills), bool)
        gone[one[given]] = True
        left = np.flatnonzero(~gone)
        gone[left[np.argsort(own_fills[left], kind="stable")[: int(len(left) * how.displace * self.draw.random())]]] = True
        loose = np.flatnonzero(gone[one] & ~given)
        child = np.where(given, other + len(own_fills), one)
        return self.best_fit(child, self.longest_first(loose))

    def mutate(self, bins: np.ndarray, how: Evolution) -> np.ndarray:
        """The least filled bins, and drawn ones, are emptied."""
        fills, share = self.fills(bins), self.draw.random()
        gone = np.zeros(len(fills), bool)
        gone[np.argsort(fills, kind="stable")[: max(1, int(len(fills) * how.empty * share))]] = True
        gone[[self.draw.randrange(len(fills)) for _ in range(max(1, int(len(fills) * how.drawn * share)))]] = True
        return self.best_fit(bins, self.longest_first(np.flatnonzero(gone[bins])))

    @property
    def least(self) -> int:
        """No packing has fewer bins."""
        return -(-int(self.lengths.sum()) // self.size)

    def evolve(self, population: list[np.ndarray], how: Evolution) -> tuple[list[np.ndarray], int]:
        """The population after some generations, best first, and how many there were. Stops when no packing can be better."""
        population = [*population, *(self.start() for _ in range(how.population - len(population)))]
        rated = sorted(((self.fitness(p), p) for p in population), key=lambda x: x[0], reverse=True)
        for turn in range(how.generations):
            if -rated[0][0][0] <= self.least:
                return [p for _, p in rated], turn
            a, b = sorted(self.draw.sample(range(len(rated)), 2)) if len(rated) > 1 else (0, 0)
            child = self.cross(rated[a][1], rated[b][1], how) if self.draw.random() < 0.6 else self.mutate(rated[a][1], how)
            rated.append((self.fitness(child), child))
            rated = sorted(rated, key=lambda x: x[0], reverse=True)[: how.population]
        return [p for _, p in rated], how.generations


ISLANDS = "problem long, island int, rows array<long>, lengths array<int>, population array<binary>, bins int, evenness double, generations int"


def _breed(size: int, how: Evolution, turn: int):
    names = [x.split()[0] for x in ISLANDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                problem, island = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                task = Problem(np.asarray(batch.column(3)[i].values, np.int64), size, hash((problem, island, turn)))
                given = [np.frombuffer(p, np.int32) for p in batch.column(4)[i].as_py() or []]
                found, ran = task.evolve(given, how)
                score = task.fitness(found[0])
                bins = pa.array([[p.astype(np.int32).tobytes() for p in found]], pa.list_(pa.binary()))
                ran += batch.column(5)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, 1) for c in range(4)), bins, pa.array([-score[0]], pa.int32()), pa.array([score[1]], pa.float64()), pa.array([ran], pa.int32())], names=names
                )

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A packing's rows, each with its sequence and its offset there."""
    for batch in batches:
        for i in range(batch.num_rows):
            problem = batch.column(0)[i].as_py()
            rows, lengths = np.asarray(batch.column(1)[i].values), np.asarray(batch.column(2)[i].values, np.int64)
            bins = np.frombuffer(batch.column(3)[i].as_py(), np.int32).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[order])
            starts = ends - lengths[order]
            first = np.r_[True, bins[order][1:] != bins[order][:-1]]
            base = np.maximum.accumulate(np.where(first, starts, 0))
            yield pa.record_batch([pa.array(rows[order]), pa.array((problem << 24) + bins[order]), pa.array(starts - base)], names=["row", "sequence_id", "offset"])


def bred(items: DataFrame, size: int = 2048, how: Evolution = Evolution()) -> DataFrame:
    """items (row, length): ISLANDS after the last round, with the generations that each island ran in all."""
    spark = items.sparkSession
    n = items.count()
    problems = -(-n // how.problem)
    dealt = items.select("row", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("row"), F.lit(max(1, problems))).alias("problem"))
    groups = dealt.groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("row", "length"))).alias("x"))
    islands = groups.select(
        "problem",
        F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))).alias("island"),
        F.col("x.row").alias("rows"),
        F.col("x.length").alias("lengths"),
        F.lit(None).cast("array<binary>").alias("population"),
        F.lit(0).alias("generations"),
    )
    spread = max(1, min(problems * how.islands, 16 * partitions(spark)))
    for turn in range(how.rounds):
        found = cut(islands.repartition(spread, "problem", "island").mapInArrow(_breed(size, how, turn), ISLANDS))
        if turn < how.rounds - 1:
            elite = found.select("problem", F.pmod(F.col("island") + 1, F.lit(how.islands)).alias("island"), F.element_at("population", 1).alias("elite"))
            mixed = F.concat(F.array("elite"), F.slice("population", 1, how.population - 1)).alias("population")
            islands = found.join(elite, ["problem", "island"]).select("problem", "island", "rows", "lengths", mixed, "generations")
    return found


def pack(items: DataFrame, size: int = 2048, how: Evolution = Evolution()) -> DataFrame:
    """items (row long, distinct; length, 1 to size): (row, sequence_id, offset), gapless from 0 in every sequence.

    Sequence ids are 0 or greater. Empty in, empty out.
    """
    packing = F.struct("rows", "lengths", F.element_at("population", 1).alias("packing"))
    best = bred(items, size, how).groupBy("problem").agg(F.max_by(packing, F.struct(-F.col("bins"), "evenness", -F.col("island"))).alias("b"))
    return best.select("problem", "b.rows", "b.lengths", "b.packing").mapInArrow(_places, "row long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", how: Evolution = Evolution()) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs.

    A document is its ids and id 0; only one longer than size is cut, into pieces of size,
    the first of which may be shorter. Full pieces fill sequences of negative ids. Null text
    counts as empty; repeated rows are documents of their own; other columns are not read.
    """
    prepare(docs.sparkSession)
    made = cut(pieces(docs, size, tokenizer, key, text))
    placed = pack(made.where(F.col("length") < size).select("row", "length"), size, how)
    whole = made.where(F.col("length") == size).withColumn("sequence_id", -F.col("row") - 1).withColumn("offset", F.lit(0).cast("long"))
    rest = made.where(F.col("length") < size).join(placed, "row")
    return whole.unionByName(rest).drop("row")
