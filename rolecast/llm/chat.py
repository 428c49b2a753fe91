r"""Chat formatting as a prefix tree.

Conversations that share their initial turns share the nodes of those turns. The forest is
written depth-first, each node's tokens once; a node is a run of turns that no two
conversations leave differently, and a token here is a code point of the formatted text. A
node carries its place in the sequence, the position ids of its tokens (they count along the
path from the root) and the intervals of the sequence that it may attend to: those of its
ancestors and its own. The depth-first order is the order of the paths of turn
hashes, and places are prefix sums over ranges of that order with even numbers of nodes, so
that a first turn shared by very many conversations is still spread over tasks.

A turn is written as ``### role: text</turn>`` and a line end. Within roles and texts a
backslash stands before every backslash, before the second of every two ``#`` and before the
stroke of ``</turn>`` (and, in roles, before every colon), so that neither ``###`` nor
``</turn>`` ever occurs in them. The loss mask covers the escaped text of each assistant turn.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecast.llm.common import cut, keep, prepare, spread_join

OPEN, CLOSE = "### ", "</turn>"
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", re.S)
LEARNED = "assistant"
#: Bytes of each turn's hash in a path.
STEP = 12
#: Nodes in a range of the order, on average; beyond MAX_RANGES times as many the ranges grow.
RANGE_ROWS, MAX_RANGES = 256, 10_000


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text begins and ends."""
    head = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


WALKED = "conv_id long, roles array<string>, turns array<string>, first array<int>, last array<int>, chain array<binary>"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's formatted turns, where their texts lie in them, and the hash of all turns up to each."""
    names = ["conv_id", "roles", "turns", "first", "last", "chain"]
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
    for batch in batches:
        rows = []
        for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            made = [format_turn(t["role"], t["text"]) for t in turns]
            chain, so_far = [], b""
            for formatted, _, _ in made:
                so_far = sha256(so_far + formatted.encode("utf-8", "surrogatepass")).digest()
                chain.append(so_far)
            rows.append((conv, [t["role"] for t in turns], *([m[i] for m in made] for i in range(3)), chain))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def walked(conversations: DataFrame) -> DataFrame:
    """WALKED for every conversation, its rows taken by turn (nulls first; ties by role, then text)."""
    clean = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turn = F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "text")
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).mapInArrow(_walk, WALKED)


def _starts(walks: DataFrame) -> DataFrame:
    """(conv_id, starts): the depths but 0 at which a conversation enters a new node, if any.

    A node is a run of turns that never parts: it ends where conversations go on
    differently, or where one of them ends.
    """
    steps = walks.select("conv_id", F.size("chain").alias("n"), "chain", F.posexplode("chain").alias("depth", "hash"))
    steps = steps.select("conv_id", "n", "depth", "hash", F.when(F.col("depth") > 0, F.get("chain", F.col("depth") - 1)).alias("parent"))
    distinct = steps.groupBy("hash").agg(F.first("parent").alias("parent"), F.max((F.col("depth") == F.col("n") - 1).cast("int")).alias("ends"), F.count("*").alias("count"))
    distinct = keep(distinct, "chat-turns")
    # counted before the shuffle, so that a turn with very many continuations is a number of them
    parting = distinct.where("parent is not null").groupBy(F.col("parent").alias("hash")).agg(F.count("*").alias("children")).where("children > 1").select("hash")
    parting = parting.union(distinct.where("ends = 1").select("hash")).distinct()
    after = spread_join(steps.where("depth < n - 1").select("conv_id", "depth", "hash"), parting, "hash", "conv_id", "left_semi", distinct.select("hash", "count"))
    return after.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("depth") + 1)).alias("starts"))


NODES = "conv_id long, leaf boolean, path binary, depth int, position long, text string, spans array<struct<first: int, last: int>>"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes along each conversation's path."""
    span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.list_(span)]
    names = ["conv_id", "leaf", "path", "depth", "position", "text", "spans"]
    for batch in batches:
        rows = []
        for conv, roles, turns, first, last, chain, starts in zip(*(c.to_pylist() for c in batch.columns)):
            path, position = b"", 0
            for a, b in zip(starts, [*starts[1:], len(turns)]):
                path += chain[a][:STEP]
                at, spans = 0, []
                for i in range(a, b):
                    if roles[i] == LEARNED:
                        spans.append({"first": at + first[i], "last": at + last[i]})
                    at += len(turns[i])
                rows.append((conv, b == len(turns), path, a, position, "".join(turns[a:b]), spans))
                position += at
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _ranges(nodes: DataFrame) -> list[bytes]:
    """The least paths of ranges of the depth-first order, at most MAX_RANGES of them, from an even sample."""
    n = min(MAX_RANGES, nodes.count() // RANGE_ROWS)
    sample = nodes.select("path").orderBy(F.xxhash64("path"), "path").limit(8 * n).collect() if n else []
    found = sorted(bytes(r.path) for r in sample)
    return found[7::8]


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packed forest, and each conversation's leaf in it.

    Nodes: path, parent (null at a root), depth (of its first turn), start (its first token
    in the sequence), length, position (the position id of its first token), attend
    (array<struct<start, end>>: its ancestors' intervals and its own, root first), spans
    (array<struct<first, last>>: its learned tokens, counted from start), text.
    Leaves: conv_id, path. Null texts and roles are empty; equal conversations share a leaf;
    the rows of a null conv_id are one conversation. Empty in, empty out.
    """
    prepare(conversations.sparkSession)
    walks = keep(walked(conversations), "chat-walks")
    starts = _starts(walks).withColumnRenamed("conv_id", "__conv")
    along = walks.join(starts, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    along = along.withColumn("starts", F.concat(F.array(F.lit(0)), F.coalesce("starts", F.array().cast("array<int>"))))
    along = keep(along.mapInArrow(_nodes, NODES), "chat-nodes")
    nodes = along.groupBy("path").agg(F.first(F.struct("depth", "position", "text", "spans")).alias("n")).select("path", "n.*")
    nodes = keep(nodes.withColumn("length", F.length("text").cast("long")), "chat-distinct")
    bounds = _ranges(nodes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [bisect_right(bounds, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int64())], names=["path", "length", "part"])

    light = nodes.select("path", "length").mapInArrow(place, "path binary, length long, part long")
    sums = light.groupBy("part").agg(F.sum("length").alias("sum"))
    before = F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    earlier = F.sum("length").over(Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut(light.withColumn("own", F.coalesce(earlier, F.lit(0))).join(bases, "part").select("path", (F.col("base") + F.col("own")).alias("start"), "length"))
    # a node's ancestors are the prefixes of its path
    size = F.length("path")
    prefixes = F.transform(F.sequence(F.lit(1), (size / STEP).cast("int")), lambda d: F.substring(F.col("path"), F.lit(1), (d * STEP).cast("int")))
    up = spread_join(nodes.select(F.col("path").alias("node"), F.explode(prefixes).alias("path")), placed, "path", "node")
    attend = up.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("attend"))
    out = (
        nodes.drop("length")
        .join(placed, "path")
        .join(attend.withColumnRenamed("node", "path"), "path")
        .select("path", F.when(size > STEP, F.substring(F.col("path"), F.lit(1), size - STEP)).alias("parent"), "depth", "start", "length", "position", "attend", "spans", "text")
    )
    return keep(out, "chat-forest"), along.where("leaf").select("conv_id", "path")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """READ of every conversation, from the tree alone: each leaf's tokens are those of the intervals it attends to."""
    prepare(nodes.sparkSession)
    spans = spread_join(leaves, nodes.select("path", "attend"), "path", "conv_id").select("conv_id", F.explode("attend").alias("a"))
    pieces = spread_join(cut(spans.select("conv_id", F.col("a.start").alias("start"))), nodes.select("start", "text", "spans"), "start", "conv_id")
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "text", "spans"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for conv, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                formatted = "".join(p["text"] for p in pieces)
                turns = parse(formatted)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                learned = "".join(unescape(p["text"][x["first"] : x["last"]]) for p in pieces for x in p["spans"])
                digest = lambda s: sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((conv, len(turns), digest(said), len(learned), digest(learned), len(formatted)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return whole.mapInArrow(run, READ)
