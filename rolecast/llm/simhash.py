"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are dealt to shards by masked bit patterns: the 64 bits are cut
into k blocks, and a fingerprint enters one shard for each choice of k - d blocks, under
its bits there. Two fingerprints that differ in at most d bits agree on at least k - d
blocks, so every link lies within some shard. A shard sorts its members by the rank of
their bits in the reflected Gray sequence, builds a tree over consecutive members whose
nodes hold the bits that all members share, and descends it adding up differences, which
prunes whole groups at once. A shard returns a spanning forest of its links, never all
pairs. Members of an overfull shard go on to a finer choice of blocks, which is as exact.

De-duplication by a similarity asks for far more differing bits than blocks can bear. It
takes a wider fingerprint of the set of shingles, whose shards are patterns of drawn bits,
and searches them in the same way; members of an overfull shard are candidates all together.
Only texts whose sets of shingles are as similar as asked are linked. Groups of candidates
are held against one another in blocks of a bounded number of members, and members that are
known to be of one component are not compared again.
"""

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecast.llm.common import cut, keep, partitions, prepare, spread_join, word_bytes
from rolecast.llm.components import connected_components

BITS = 64
SEED = 42
#: Members of a shard beyond which they go on to finer shards.
SPLIT_AT = 4096
#: Mean members of a shard for which the number of blocks is chosen.
MEAN_MEMBERS = 64
MAX_BLOCKS = 10
FAN = 8


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; no word: zero."""
    found = word_bytes(text)
    if not found:
        return 0
    found = b" ".join(found).lower().split(b" ")
    grams = map(b" ".join, zip(*(found[i:] for i in range(shingle)))) if len(found) >= shingle else [b" ".join(found)]
    n = max(1, len(found) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=">u8", count=n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4, name: str = "fp") -> DataFrame:
    """docs and a long column of fingerprints; all columns and rows are kept."""
    fields = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, fields)


def masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks - distance of the blocks, the bits they hold (as signed longs)."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    held = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    found = [sum(x) for x in combinations(held, blocks - distance)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in found]


def blocks_for(n: int, distance: int) -> int:
    """The least number of blocks, two above distance at least, with few members in an even shard."""
    blocks = distance + 2
    while blocks < distance + 6 and n / 2.0 ** (BITS * (blocks - distance) / blocks) > MEAN_MEMBERS:
        blocks += 1
    return blocks


def gray_order(codes: np.ndarray) -> np.ndarray:
    """codes (n, words): their order by place in the reflected Gray sequence."""
    ranks, odd = [], np.zeros(len(codes), bool)
    for word in codes.T:
        rank = word.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        ranks.append(np.where(odd, ~rank, rank))
        odd ^= (np.bitwise_count(word) & 1).astype(bool)
    return np.lexsort(ranks[::-1])


def differences(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


def linked_pairs(codes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of index pairs (i < j) of codes (n, words), in Gray order, that differ in at most distance bits."""
    n = len(codes)
    levels = [(codes, codes)]
    while len(levels[-1][0]) > 1:
        starts = np.arange(0, len(levels[-1][0]), FAN)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], starts), np.bitwise_or.reduceat(levels[-1][1], starts)))
    shared = [~(ones ^ some) for ones, some in levels]
    chunk = 512
    for start in range(0, n, chunk):
        query = np.arange(start, min(n, start + chunk))
        node = np.zeros(len(query), np.int64)
        seen = np.zeros(len(query), np.int64)
        known = np.zeros((len(query), codes.shape[1]), np.uint64)
        for level in range(len(levels) - 1, -1, -1):
            pattern, mask = levels[level][0], shared[level]
            seen = seen + differences((codes[query] ^ pattern[node]) & mask[node] & ~known)
            last = np.minimum((node + 1) * FAN**level, n) - 1
            keep = (seen <= distance) & (last > query)
            query, node, seen = query[keep], node[keep], seen[keep]
            if level and len(query):
                known = np.repeat(mask[node], FAN, axis=0)
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                query, seen = np.repeat(query, FAN), np.repeat(seen, FAN)
                there = child < len(levels[level - 1][0])
                query, node, seen, known = query[there], child[there], seen[there], known[there]
            elif level:
                break
        if len(query):
            yield query, node


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i] under their least index."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def spanning_edges(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) that link each code of a group with one code of its component within the group."""
    order = gray_order(codes)
    root = np.arange(len(codes))
    for a, b in linked_pairs(codes[order], distance):
        join_roots(root, a, b)
    moved = np.flatnonzero(root != np.arange(len(codes)))
    return order[moved], order[root[moved]]


def leaf_edges(group: np.ndarray, codes: np.ndarray, distance: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """spanning_edges of many small groups at once; rows of a group stand together, at most `most` of them."""
    root = np.arange(len(codes))
    for apart in range(1, most):
        at = np.flatnonzero(group[apart:] == group[:-apart])
        if not len(at):
            break
        at = at[differences(codes[at] ^ codes[at + apart]) <= distance]
        if len(at):
            join_roots(root, at, at + apart)
    moved = np.flatnonzero(root != np.arange(len(codes)))
    return moved, root[moved]


#: Groups of at most so many members are leaves: their members are compared with one another.
LEAF = 16


def _search(distance: int, words: int):
    """Rows (cell, fp, code words), sorted by cell: edges (a, b) between fps that span the links of each cell."""

    def edges(cell: np.ndarray, fp: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(cell)]
        sizes = ends - starts
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= LEAF), sizes))
        out = []
        if len(small):
            a, b = leaf_edges(group[small], codes[small], distance, LEAF)
            out.append((fp[small[a]], fp[small[b]]))
        for i in np.flatnonzero(sizes > LEAF):
            a, b = spanning_edges(codes[starts[i] : ends[i]], distance)
            out.append((fp[starts[i] + a], fp[starts[i] + b]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return tuple(np.concatenate([h[i] for h in held]) for i in range(3))

        def out(cell: np.ndarray, fp: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = edges(cell, fp, codes)
            if found:
                yield pa.record_batch([np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])], names=["a", "b"])

        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            held.append((columns[0], columns[1], np.stack(columns[2:], axis=1).view(np.uint64)))
            rows += batch.num_rows
            if rows > 50_000 and held[-1][0][0] != held[-1][0][-1]:
                cell, fp, codes = table()
                last = int(np.flatnonzero(cell != cell[-1])[-1]) + 1
                yield from out(cell[:last], fp[:last], codes[:last])
                held, rows = [(cell[last:], fp[last:], codes[last:])], len(cell) - last
        if rows > 1:
            yield from out(*table())

    return run


def _span(cells: DataFrame, distance: int, words: list[str]) -> DataFrame:
    """cells (cell, fp, words): the edges that span the links of each cell."""
    dealt = cells.select("cell", "fp", *words).repartition(partitions(cells.sparkSession), "cell")
    return dealt.sortWithinPartitions("cell").mapInArrow(_search(distance, len(words)), "a long, b long")


def link_fingerprints(codes: DataFrame, distance: int = 4, split_at: int = SPLIT_AT) -> DataFrame:
    """codes (fp long, distinct): edges (a, b) whose components are those of all links within distance bits."""
    n = codes.count()
    blocks, found, rest = blocks_for(n, distance), None, codes.select("fp")
    while True:
        pattern = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(blocks, distance))]
        cells = rest.select("fp", F.col("fp").alias("code"), F.explode(F.array(*pattern)).alias("cell"))
        final = blocks >= MAX_BLOCKS
        if not final:
            hot = cut(cells.groupBy("cell").count().where(F.col("count") > split_at).select("cell"))
            final = hot.isEmpty()
        if final:
            cool, rest = cells, None
        else:
            cool = cells.join(hot, "cell", "left_anti")
            rest = cut(cells.join(hot, "cell", "left_semi").select("fp").distinct())
        edges = _span(cool, distance, ["code"])
        found = edges if found is None else found.union(edges)
        if rest is None:
            return found
        blocks += 1


def simhash_classes(prints: DataFrame, distance: int = 4, key: str = "doc_id") -> DataFrame:
    """prints (key, fp): each distinct fp with the root of its component and component_id, the least key there.

    Links join fingerprints that differ in at most distance bits; null keys never are the
    least unless a component has no other. Rows: one for each distinct fp.
    """
    codes = cut(prints.groupBy("fp").agg(F.min(key).alias("least")))
    roots = connected_components(link_fingerprints(codes, distance)).withColumnRenamed("node", "fp")
    linked = codes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("count"))
    return spread_join(linked, least.drop("count"), "root", "fp", counts=least.select("root", "count")).select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(key, fp, component_id) for every row of docs, copies and repeated rows included.

    Null and blank texts have fingerprint zero and link like any other; other columns are
    not read; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    prints = cut(with_fingerprint(docs.select(key, text), text, shingle).select(key, "fp"))
    return spread_join(prints, simhash_classes(prints, distance, key), "fp", key).select(key, "fp", "component_id")


# Similarity -----------------------------------------------------------------------------

WIDE = 4
#: Share of pairs at the least similarity that some cell brings together, and standard deviations kept beyond their mean difference.
RECALL, SPREAD = 0.99, 3.0
#: Members of a group of candidates whose sets of shingles are held against one another in one task.
BLOCK_MEMBERS = 512


def shingles(text: str | None, shingle: int) -> set[bytes]:
    """The shingles of a text, each once; a shorter text is one shingle, a blank one has none."""
    found = word_bytes(text)
    if not found:
        return set()
    found = b" ".join(found).lower().split(b" ")
    return set(map(b" ".join, zip(*(found[i:] for i in range(shingle))))) if len(found) >= shingle else {b" ".join(found)}


def wide_fingerprint(text: str | None, shingle: int) -> bytes:
    """The SimHash of a text's set of shingles in 64 * WIDE bits."""
    grams = shingles(text, shingle)
    if not grams:
        return bytes(8 * WIDE)
    ones = []
    for seed in range(WIDE // 2):
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, grams, repeat(seed))), np.uint8).reshape(len(grams), 16)
        ones.append(np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64))
    return np.packbits(2 * np.concatenate(ones) > len(grams)).tobytes()


def with_wide(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """docs with fp, a hash of the wide fingerprint, and its words c0, c1, ..."""
    names = [f"c{i}" for i in range(WIDE)]
    fields = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in ("fp", *names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t, shingle) for t in batch.column(text).to_pylist()]
            words = np.frombuffer(b"".join(found), np.int64).reshape(len(found), WIDE)
            fp = np.array([xxhash.xxh64_intdigest(f) for f in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp), *(pa.array(words[:, i].copy()) for i in range(WIDE))], names=fields.names)

    return docs.mapInArrow(run, fields)


def radius(similarity: float) -> tuple[float, int]:
    """The chance that a bit differs between texts of this Jaccard similarity, and the differences up to which they are candidates."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    n = BITS * WIDE
    return p, int(np.ceil(n * p + SPREAD * np.sqrt(n * p * (1 - p))))


def _drawn(draw: np.random.Generator, bits: int) -> list[int]:
    """Masks of the words, as signed longs, that hold so many drawn bits between them."""
    chosen = draw.choice(BITS * WIDE, bits, replace=False)
    found = [sum(1 << int(b % BITS) for b in chosen if b // BITS == w) for w in range(WIDE)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in found]


def link_similar(codes: DataFrame, similarity: float, split_at: int = SPLIT_AT) -> DataFrame:
    """codes (fp, c0, ...), distinct: edges whose components hold together the candidates for this similarity.

    Cells are patterns of drawn bits, so many of them that RECALL of the pairs at the least
    similarity share one, and nearly all more alike; within a cell every link is found.
    """
    words = [f"c{i}" for i in range(WIDE)]
    n, (p, most) = codes.count(), radius(similarity)
    bits = max(14, int(np.ceil(np.log2(max(1, n / 16)))))
    ways = int(np.ceil(np.log(1 - RECALL) / np.log(1 - (1 - p) ** bits)))
    draw = np.random.default_rng(SEED)
    cell = lambda of, m: F.xxhash64(of, *[F.col(w).bitwiseAND(F.lit(x)) for w, x in zip(words, m)])
    cells = codes.select("fp", *words, F.explode(F.array(*[cell(F.lit(i), _drawn(draw, bits)) for i in range(ways)])).alias("cell"))
    sized = cut(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("hub")).where(F.col("n") > split_at))
    if sized.isEmpty():
        return _span(cells, most, words)
    # at most n * ways / split_at cells, each a row
    together = spread_join(cells.select("cell", "fp"), sized.select("cell", "hub"), "cell", "fp", counts=sized.select("cell", F.col("n").alias("count")))
    return _span(cells.join(sized, "cell", "left_anti"), most, words).union(together.where("fp <> hub").select("fp", "hub"))


def similar_roots(sets: list[np.ndarray], similarity: float, known: np.ndarray | None = None, asked: np.ndarray | None = None) -> np.ndarray:
    """The first index of each set's component over links of at least this Jaccard similarity, all pairs considered.

    known: labels of components known before, whose members are linked without a look;
    asked: sets of which one must be in a pair for it to be considered.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    at = np.r_[0, np.cumsum(sizes)]
    values, own = np.unique(np.concatenate(sets), return_inverse=True)
    item, owner = own, np.repeat(np.arange(n), sizes)
    kin: dict[int, list[int]] = {}
    for i, label in enumerate([] if known is None else known.tolist()):
        kin.setdefault(label, []).append(i)
    root, held = np.full(n, -1), np.zeros(len(values), bool)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first], queue = first, [first]
        while queue:
            one = queue.pop()
            if known is not None and (same := kin.pop(int(known[one]), None)):
                more = [i for i in same if root[i] < 0]
                root[more] = first
                queue += more
                left = root[owner] < 0
                item, owner = item[left], owner[left]
            if not len(owner):
                continue
            mine = own[at[one] : at[one + 1]]
            held[mine] = True
            shared = np.bincount(owner[held[item]], minlength=n)
            held[mine] = False
            near = (root < 0) & (shared / np.maximum(1, sizes + sizes[one] - shared) >= similarity)
            if asked is not None and not asked[one]:
                near &= asked
            near = np.flatnonzero(near)
            if len(near):
                root[near] = first
                queue += near.tolist()
                left = root[owner] < 0
                item, owner = item[left], owner[left]
    return root


GRAMS = "candidate long, members long, fp long, band int, grams binary"


def _gram_sets(shingle: int, similarity: float):
    """Rows (candidate, members, fp, text): the text's band and the hashes of its shingles in place of it.

    Bands are sizes of sets by powers of 1 / similarity, a little wide: sets as similar as that are of one band or of two that adjoin.
    """
    width = -1.000001 * np.log(similarity) if similarity < 1 else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array([xxhash.xxh3_64_intdigest(g, SEED) for g in shingles(t, shingle)], np.uint64) for t in batch.column(3).to_pylist()]
            bands = [int(np.log(max(1, len(f))) / width) for f in found]
            columns = [*(batch.column(i) for i in range(3)), pa.array(bands, pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in GRAMS.split(", ")])

    return run


def _verify(similarity: float):
    """Rows (block, fp, grams, known, asked), sorted by block: edges between the known component of each fp and that of the first it is linked with in the block."""

    def out(held: dict[int, tuple[bytes, int, bool]]) -> Iterator[pa.RecordBatch]:
        grams, known, asked = zip(*held.values())
        root = similar_roots([np.frombuffer(g, np.uint64) for g in grams], similarity, np.array(known, np.int64), np.array(asked, bool))
        label = np.array(known, np.int64)
        moved = np.flatnonzero(label[root] != label)
        if len(moved):
            yield pa.record_batch([pa.array(label[moved]), pa.array(label[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for block, fp, grams, known, asked in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now and held:
                    yield from out(held)
                    held = {}
                now = block
                if fp not in held or asked:  # repeated rows have the same set
                    held[fp] = grams, known, asked
        if held:
            yield from out(held)

    return run


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """rows (block, fp, grams, known, asked): the edges (a, b) that span the links within each block."""
    dealt = rows.select("block", "fp", "grams", "known", "asked").repartition(partitions(rows.sparkSession), "block")
    return cut(dealt.sortWithinPartitions("block").mapInArrow(_verify(similarity), "a long, b long"))


def similar_classes(texts: DataFrame, similarity: float, shingle: int = 5, members: int = BLOCK_MEMBERS) -> DataFrame:
    """texts (candidate, members, fp, text): (fp, root), the components of all links within a candidate of so many members; an fp without a link may be missing.

    A group of at most `members` is one block. A larger one is dealt into blocks by band and
    hash, which first link what they hold, and then the first members of what they found. Most
    of a group of near copies is one component by then; each member outside the group's largest
    one then meets every block of its own band and of the bands beside it. So every pair of sets
    that may be similar is compared, unless both are known to be of one component.
    """
    sets = lambda rows: rows.mapInArrow(_gram_sets(shingle, similarity), GRAMS)
    plain = lambda rows: rows.withColumn("known", F.col("fp")).withColumn("asked", F.lit(True))
    lane = lambda band: F.xxhash64("candidate", band).alias("lane")
    block = lambda *of: F.xxhash64("candidate", *of).alias("block")
    parts = lambda n: F.ceil(n / F.lit(members)).cast("int")
    place = lambda seed, ways: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(ways)).cast("int")
    three = lambda band: F.explode(F.array(F.col(band) - 1, F.col(band), F.col(band) + 1))

    found = _compared(plain(sets(texts.where(F.col("members") <= members)).withColumn("block", F.col("candidate"))), similarity)
    found = found.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    if texts.where(F.col("members") > members).isEmpty():
        return found
    big = sets(texts.where(F.col("members") > members)).withColumn("ways", parts(F.col("members")))
    big = keep(big.withColumn("place", place(0, "ways")), "near-sets")
    inner = _compared(plain(big.withColumn("block", block("band", "place"))), similarity)
    firsts = big.join(inner.select(F.col("a").alias("fp")), "fp", "left_anti")
    heads = cut(firsts.groupBy("candidate").count())
    firsts = spread_join(firsts, heads.select("candidate", parts(F.col("count")).alias("__n")), "candidate", "fp", counts=heads)
    outer = _compared(plain(firsts.withColumn("block", block("band", place(1, "__n")))), similarity)
    # both lead to a first member in one step: two steps name what is known
    named = big.select("candidate", "fp", "band", "ways", "place").distinct().join(inner.select(F.col("a").alias("fp"), "b"), "fp", "left").withColumn("head", F.coalesce("b", "fp")).drop("b")
    named = spread_join(named, outer.select(F.col("a").alias("head"), "b"), "head", "fp", "left")
    named = cut(named.withColumn("known", F.coalesce("b", "head")).drop("b", "head"))

    # the largest component of each group, counted before the shuffle; the members of all others are asked about
    sizes = named.groupBy("candidate", "known").agg(F.count("*").alias("n")).groupBy("candidate")
    most = cut(sizes.agg(F.max_by("known", F.struct("n", "known")).alias("largest"), F.sum("n").alias("count")))
    loose = cut(spread_join(named, most.drop("count"), "candidate", "fp", counts=most.select("candidate", "count")).where("known <> largest"))
    if loose.isEmpty():
        return found.union(named.select("fp", "known"))
    asking = cut(loose.groupBy("candidate", "band").agg(F.count("*").alias("count")).select(lane("band"), "*", parts(F.col("count")).alias("parts")))
    # a loose member goes to every block of three bands
    visits = spread_join(loose.withColumn("lane", lane("band")), asking.select("lane", "parts"), "lane", "fp", counts=asking.select("lane", "count"))
    visits = visits.select("candidate", "fp", "known", "band", place(2, "parts").alias("part"), "ways", three("band").alias("to"))
    visits = visits.select("*", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("at")).select(block("band", "part", "to", "at"), "fp", "known", F.lit(True).alias("asked"))
    # and the members of a block to the loose ones of its three bands: three rows at most for a band
    hosts = asking.select("candidate", F.col("band").alias("from"), "parts", three("band").alias("band"))
    hosts = hosts.groupBy("candidate", "band").agg(F.collect_list(F.struct("from", "parts")).alias("askers")).select(lane("band"), "askers")
    hosted = spread_join(named.withColumn("lane", lane("band")), hosts, "lane", "fp").withColumn("q", F.explode("askers"))
    hosted = hosted.select("*", F.explode(F.sequence(F.lit(0), F.col("q.parts") - 1)).alias("part")).select(block("q.from", "part", "band", "place"), "fp", "known", F.lit(False).alias("asked"))
    met = visits.union(hosted).join(big.select("fp", "grams").dropDuplicates(["fp"]), "fp")
    joined = connected_components(_compared(met, similarity)).withColumnRenamed("node", "known")
    return found.union(spread_join(named.select("fp", "known"), joined, "known", "fp", "left").select("fp", F.coalesce("root", "known")))


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keeps one row of each group of texts linked by a Jaccard similarity of at least `similarity`.

    The similarity is that of the texts' sets of shingles; SimHash only finds the candidates.
    The row with the least key stays (nulls last), then that of the least text hash; of equal
    rows one. All columns are returned. Null and blank texts are alike. Empty in, empty out.
    """
    prepare(docs.sparkSession)
    tie = "__simhash_tie"
    seen = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    prints = cut(with_wide(seen, "text", shingle).drop("text"))
    words = [f"c{i}" for i in range(WIDE)]
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tie"))
    codes = cut(prints.groupBy("fp").agg(*[F.first(w).alias(w) for w in words], best.alias("b"), F.count("*").alias("count")))
    near = connected_components(link_similar(codes, similarity)).withColumnRenamed("node", "fp").withColumnRenamed("root", "candidate")
    members = cut(near.groupBy("candidate").count())
    near = spread_join(near, members.withColumnRenamed("count", "members"), "candidate", "fp", counts=members)
    asked = codes.join(near, "fp").select("candidate", "members", "fp", F.col("b.key").alias("__k"), F.col("b.tie").alias("__t"))
    texts = seen.join(asked, (F.col("tie") == F.col("__t")) & F.col("key").eqNullSafe(F.col("__k"))).select("candidate", "members", "fp", "text")
    roots = similar_classes(keep(texts, "near-texts"), similarity, shingle)
    placed = spread_join(prints, roots, "fp", "key", "left", codes.select("fp", "count")).withColumn("root", F.coalesce("root", "fp"))
    kept = cut(placed.groupBy("root").agg(best.alias("b")).select(F.col("b.key").alias("__k"), F.col("b.tie").alias("__t")))
    # rows that occur once need no ranking, so their texts are not dealt by it
    twice = prints.groupBy(F.col("key").alias("__rk"), F.col("tie").alias("__rt")).count().where("count > 1")
    same = (F.col("__t") == F.col("__rt")) & F.col("__k").eqNullSafe(F.col("__rk"))
    marked, mine = docs.withColumn(tie, F.xxhash64(text)), (F.col(tie) == F.col("__t")) & F.col(key).eqNullSafe(F.col("__k"))
    once = marked.join(kept.join(twice, same, "left_anti"), mine, "left_semi")
    row = F.row_number().over(Window.partitionBy(tie, key).orderBy(F.lit(0)))
    again = marked.join(cut(kept.join(twice, same, "left_semi")), mine, "left_semi").withColumn("__row", row).where("__row = 1").drop("__row")
    return once.unionByName(again).drop(tie)
