"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents, in a shuffled order, form one stream of words, cut into blocks of
equal length. The schedule's slots are the van der Corput points in base 2, mapped through
the cumulative weights to sources; the r-th slot of a source takes its r-th block, and
starts again from the first when the blocks are used up. A source's last slot takes only
what its target still lacks, so targets are met to the word. Nothing is ordered or ranked
by source alone: prefix sums run over chunks of a bounded number of rows, and over their sums
in as many levels as it takes.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.llm.common import cut, prepare, words

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK = 2048
#: Rows, on average, that are put in order together, and bits of the number of chunks, or of sums over chunks, that are added up together.
CHUNK_ROWS, LEVEL_BITS = 128, 8
#: Points are multiples of 2^-POINT_BITS; cells of the unit interval through which they find their source.
POINT_BITS, CELLS = 40, 4096
SEED = 6


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size): adds sid (place by code point, null last), weight and target.

    share x all sizes is dealt by weight; a target stops at most x its source's size, and
    the excess is dealt again by weight until no target is above. In the order of
    cap / weight, the level of the rest rises until the next cap is above it.
    """
    by_point, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("__ratio", "sid")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    placed = sources.withColumn("sid", F.row_number().over(by_point) - 1)
    placed = placed.withColumn("weight", F.element_at(wheel, F.col("sid") % len(weights) + 1)).withColumn("__cap", F.col("source_size") * F.lit(most))
    placed = placed.withColumn("__ratio", F.col("__cap") / F.col("weight"))
    rest = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("__cap").over(upto), F.lit(0.0))
    placed = placed.withColumn("__level", rest / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__ratio", "sid", "__level"))).over(everything)["__level"]
    goal = F.least(F.col("__cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return placed.withColumn("target", goal).drop("__cap", "__ratio", "__level")


def _starts(sums: DataFrame, group: str, chunk: str, value: str, bits: int) -> DataFrame:
    """sums (group, chunk, value), chunk below 2^bits: (group, chunk, __start), the sum of value over the group's earlier chunks.

    Chunks meet in windows of at most 2^LEVEL_BITS; windows are chunks of a level above.
    """
    up = f"__up{bits}"
    upto = F.sum(value).over(Window.partitionBy(group, up).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    placed = sums.withColumn(up, F.shiftright(chunk, LEVEL_BITS))
    own = placed.withColumn("__own", F.coalesce(upto, F.lit(0)))
    if bits <= LEVEL_BITS:
        return own.select(group, chunk, F.col("__own").alias("__start"))
    above = placed.groupBy(group, up).agg(F.sum(value).alias(value))
    starts = _starts(above, group, up, value, bits - LEVEL_BITS)
    return own.join(starts, [group, up]).select(group, chunk, (F.col("__start") + F.col("__own")).alias("__start"))


def _prefix(rows: DataFrame, group: str, chunk: str, value: str, name: str, order: list[str], bits: int) -> DataFrame:
    """rows with name: the sum of value over earlier rows of the group, by chunk (below 2^bits) and then by order; and __rn within the chunk."""
    starts = _starts(rows.groupBy(group, chunk).agg(F.sum(value).alias("__sum")), group, chunk, "__sum", bits)
    within = Window.partitionBy(group, chunk).orderBy(*order)
    own = F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(starts, [group, chunk]).withColumn(name, F.col("__start") + own).withColumn("__rn", F.row_number().over(within)).drop("__start")


def point(i: Column) -> Column:
    """The i-th van der Corput point in base 2."""
    digits = F.reverse(F.lpad(F.bin(i), POINT_BITS, "0"))
    return F.conv(digits, 2, 10).cast("double") / F.lit(float(1 << POINT_BITS))


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """goals (sid, source_size, target): rows (slot, sid, epoch, block, take), take being the words from the block's start."""
    spark = goals.sparkSession
    size, goal = F.col("source_size"), F.col("goal")
    blocks = F.ceil(size / F.lit(block)).cast("long")
    spare = goal - F.expr("source_size * (goal div source_size)")
    needed = F.expr("goal div source_size") * blocks + F.ceil(spare / F.lit(block)).cast("long")
    plan = cut(
        goals.select("sid", size.cast("long").alias("source_size"), F.round("target").cast("long").alias("goal"))
        .where("source_size > 0 and goal > 0")
        .withColumn("blocks", blocks)
        .withColumn("slots", needed)
    )
    n = plan.agg(F.sum("slots")).first()[0] or 0
    share = F.sum("slots").over(Window.orderBy("sid"))
    spans = plan.select("sid", ((share - F.col("slots")) / F.lit(float(max(n, 1)))).alias("lo"), (share / F.lit(float(max(n, 1)))).alias("hi"))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    points = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "sid", F.lit(1).alias("one"), F.expr(f"slot div {CHUNK_ROWS}").alias("part"))
    ranked = cut(_prefix(drawn, "sid", "part", "one", "rank", ["slot"], int(n // CHUNK_ROWS).bit_length()).select("slot", "sid", "rank"))
    # a source may draw a few points more or fewer than its share: the surplus goes, the lack is added at the end
    had = ranked.groupBy("sid").agg(F.count("*").alias("had"))
    lack = plan.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    added = lack.select("sid", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("rank")).select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank")
    placed = ranked.unionByName(added).join(plan, "sid").where("rank < slots")
    placed = placed.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    start = F.col("block") * block
    left = F.col("goal") - F.col("epoch") * F.col("source_size") - start
    take = F.greatest(F.lit(0), F.least(left, F.lit(block), F.col("source_size") - start))
    return placed.select("slot", "sid", "epoch", "block", take.alias("take")).where("take > 0")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix of docs, and the per-document account of it.

    Pieces: (slot, epoch, key, start, words): the words of a document from start on that a
    slot takes; slots in ascending order are the mix. Account: a row for each row of docs
    with key, source, tie (a hash of the text), size, source_size, target and taken.
    Null and blank texts have size 0 and are never taken; null is a source of its own, the
    last. Repeated rows count each for itself. Empty in, empty out. The order of a source's
    documents follows a hash of key, so that reruns agree.
    """
    prepare(docs.sparkSession)
    sized = cut(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(text).alias("tie")
        ).withColumn("mark", F.xxhash64("key", F.lit(SEED)))
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = cut(targets(sizes, share, most, weights))
    bits = max(0, (sized.count() // CHUNK_ROWS).bit_length())
    chunk = F.shiftrightunsigned("mark", 64 - bits) if bits else F.lit(0).cast("long")
    known = sized.withColumn("chunk", chunk).join(goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    streams = _prefix(known, "sid", "chunk", "size", "at", ["mark", "key", "tie"], bits)
    span = F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")))
    parts = streams.withColumn("block", F.explode_outer(span))
    first = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    last = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))
    parts = parts.withColumn("first", first).withColumn("last", last).withColumn("start", F.col("block") * block + first - F.col("at"))
    joined = parts.join(schedule(goals, block), ["sid", "block"], "left")
    got = F.greatest(F.lit(0), F.least(F.col("last"), F.coalesce("take", F.lit(0))) - F.col("first"))
    joined = joined.withColumn("words", F.when(F.col("size") > 0, got).otherwise(F.lit(0)))
    pieces = joined.where("words > 0").select("slot", "epoch", F.col("key").alias(key), "start", "words")
    account = joined.groupBy("sid", "chunk", "__rn").agg(
        *[F.first(c).alias(c) for c in ("key", "source", "tie", "size", "source_size", "target")], F.sum("words").alias("taken")
    )
    return pieces, account.withColumnRenamed("key", key).drop("sid", "chunk", "__rn")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """Whole documents as often as the mix takes them: taken / size rounded, 0 to 2 times; all columns of docs.

    Of repeated equal rows each is taken as often as its own account says.
    """
    account = mix(docs, key, text, source, **how)[1]
    tie, rn, times = "__mix_tie", "__mix_rn", "__mix_times"
    same = Window.partitionBy(key, source, tie)
    copies = account.select(key, source, F.col("tie").alias(tie), F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int").alias(times))
    copies = copies.withColumn(rn, F.row_number().over(same.orderBy(times))).where(F.col(times) > 0)
    rows = docs.withColumn(tie, F.xxhash64(text)).withColumn(rn, F.row_number().over(same.orderBy(tie)))
    other = copies.select(*[F.col(c).alias(f"__mix_{i}") for i, c in enumerate((key, source, tie, rn))], times)
    on = F.lit(True)
    for i, c in enumerate((key, source, tie, rn)):
        on = on & rows[c].eqNullSafe(F.col(f"__mix_{i}"))
    found = rows.join(other, on).withColumn(rn, F.explode(F.sequence(F.lit(1), F.col(times))))
    return found.select(*docs.columns)
