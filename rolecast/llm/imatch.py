"""I-Match fingerprints, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band, given as shares of
all documents. The lower end bounds the lexicon: at most (distinct terms in a document on
average) / (least share) terms can reach it, however large the corpus. It therefore goes
along as a hash table in two literal arrays, so that looking a term up neither joins nor
shuffles. Each document keeps its distinct terms in the band, sorted, and hashes them
under several randomised lexicons: in each of FAMILIES families, nested lexicons that keep
each term with probability 1/4, 1/8, and so on. Sparse lexicons survive larger edits, and
dense ones tell small documents apart, so the share of equal hashes grades likeness.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecast.llm.common import partitions, prepare, words

FAMILIES = 6
#: A family's lexicons keep the terms whose hash has none of these bits, nor those of the masks before: 1/4, 1/8, ... 1/512.
MASKS = (3, 4, 8, 16, 32, 64, 128, 256)
#: The band, as shares of all documents that hold the term.
LEAST_SHARE, MOST_SHARE = 0.002, 0.25
DIGITS = 5
#: Documents in a group that is put in order together.
GROUP_ROWS = 500
MAX_GROUPS = 10_000


def terms(text: Column) -> Column:
    """The distinct terms of a text, as 64-bit hashes of its lower-cased words."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[int]:
    """Hashes of the terms in the band, counted over all rows of docs. At most (mean distinct terms) / least."""
    total = docs.count()
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").count()
    low, high = max(2, least * total), max(2, most * total)
    return sorted(r.term for r in counts.where((F.col("count") >= low) & (F.col("count") <= high)).select("term").collect())


def _places(found: list[int]) -> tuple[list[int], list[int], int]:
    """Two tables, of 2^bits places each: a term lies in the first at its low bits or in the second at the next ones."""
    bits = max(4, (2 * len(found) + 1).bit_length())
    while True:
        size = 1 << bits
        tables: tuple[list[int], list[int]] = ([0] * size, [0] * size)
        for term in found:
            side = 0
            for _ in range(64):
                at = (term >> (bits * side)) & (size - 1)
                term, tables[side][at] = tables[side][at], term
                if not term:
                    break
                side = 1 - side
            if term:
                break
        else:
            return *tables, bits
        bits += 1


def _literal(values: list[int | None]) -> Column:
    """An array literal, folded from text when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").try_cast("array<bigint>")


def member(found: list[int]):
    """term -> whether it is in the lexicon, by two look-ups."""
    first, second, bits = _places([t for t in found if t])
    one, two, low = _literal(first), _literal(second), (1 << bits) - 1

    def test(term: Column) -> Column:
        return (F.element_at(one, (term.bitwiseAND(low) + 1).cast("int")) == term) | (
            F.element_at(two, (F.shiftright(term, bits).bitwiseAND(low) + 1).cast("int")) == term
        )

    return test


def in_band(text: Column, found: list[int]) -> Column:
    """A text's distinct terms in the lexicon, sorted."""
    return F.array_sort(F.filter(terms(text), member(found)))


def hashes(terms: Column, text: Column) -> Column:
    """array<long>: a hash of the kept terms, which come sorted, for each randomised lexicon; 0 where it keeps none.

    A family's lexicons are nested: each mask keeps half of what the one before kept. Texts
    without a term in the band fall back on a hash of the whole text in every place, so that
    equal texts always have equal fingerprints.
    """
    kept = lambda family, mask: lambda t: F.xxhash64(t, F.lit(family)).bitwiseAND(mask) == 0
    told = lambda a: F.when(F.size(a) > 0, F.xxhash64(a)).otherwise(F.lit(0).cast("long"))

    def family(i: int) -> Column:
        first = F.filter(terms, kept(i, F.lit(MASKS[0])))
        start = F.struct(first.alias("a"), F.array().cast("array<bigint>").alias("h"))
        step = lambda s, mask: F.struct(F.filter(s["a"], kept(i, mask)).alias("a"), F.concat(s["h"], F.array(told(s["a"]))).alias("h"))
        return F.aggregate(F.array(*[F.lit(m) for m in MASKS[1:]]), start, step, lambda s: F.concat(s["h"], F.array(told(s["a"]))))

    whole = F.array_repeat(F.xxhash64(text, F.lit(-1)), FAMILIES * len(MASKS))
    return F.when(F.size(terms) > 0, F.concat(*[family(i) for i in range(FAMILIES)])).otherwise(whole)


def likeness(a: Column, b: Column) -> Column:
    """The mean of two shares: of equal hashes, and of families with an equal hash.

    Only lexicons that keep a term of either text count; 1 if none does.
    """
    places = F.sequence(F.lit(0), F.lit(FAMILIES * len(MASKS) - 1))
    same = F.filter(places, lambda i: (F.get(a, i) == F.get(b, i)) & (F.get(a, i) != 0))
    told = F.filter(places, lambda i: (F.get(a, i) != 0) | (F.get(b, i) != 0))
    family = lambda found: F.size(F.array_distinct(F.transform(found, lambda i: F.floor(i / len(MASKS)))))
    return F.when(F.size(told) == 0, F.lit(1.0)).otherwise((F.size(same) / F.size(told) + family(same) / family(told)) / 2)


def as_text(a: Column) -> Column:
    """The hashes in hex digits; '-' where a lexicon keeps no term."""
    return F.array_join(F.transform(a, lambda h: F.when(h == 0, F.lit("-")).otherwise(F.right(F.lower(F.hex(h)), F.lit(DIGITS)))), ".")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(key, fingerprint as array<long>) for every row of docs.

    Null text counts as empty. Repeated rows and equal texts have equal fingerprints. Empty in, empty out.
    """
    prepare(docs.sparkSession)
    found = lexicon(docs, text, least, most)
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = docs.select(key, whole.alias("__text"), in_band(whole, found).alias("__terms"))
    return kept.select(key, hashes(F.col("__terms"), F.col("__text")).alias("fingerprint"))


def _ends_above(key: Column, ends: list[int]) -> Column:
    """How many of the ends, which descend, are at least key: by blocks first, then within one."""
    if not ends:
        return F.lit(0)
    step = math.isqrt(len(ends)) + 1
    many = lambda a: F.size(F.filter(a, lambda e: e >= key))
    blocks = many(_literal(ends[step - 1 :: step])) if len(ends) >= step else F.lit(0)
    return blocks * step + many(F.slice(_literal(ends), blocks * step + 1, F.lit(step)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, group, ghost): rows in groups by descending key, each group ending with the next one's first row as a ghost.

    Within a group, ordered by ghost, descending key (nulls last) and text, every row but a
    ghost is followed by the next document; the last one of all is followed by the first.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    total = rows.count()
    groups = min(MAX_GROUPS, total // GROUP_ROWS + 1)
    shares = [i / groups for i in range(1, groups)]
    ends: list[int] = []
    if shares:
        ends = sorted(set(rows.agg(F.percentile_approx("__key", shares, 100_000)).first()[0] or []), reverse=True)
    # group i holds the keys k with exactly i ends above or at k; nulls are in the last
    group = F.when(F.col("__key").isNull(), F.lit(len(ends))).otherwise(_ends_above(F.col("__key"), ends))
    placed = rows.withColumn("__group", group)
    firsts = {r["g"]: r["k"] for r in placed.groupBy(F.col("__group").alias("g")).agg(F.max("__key").alias("k")).collect()}
    there = sorted(firsts)
    previous = dict(zip(there, [*there[-1:], *there[:-1]]))
    # the first key of each group, and the group before it, which ends with that row as a ghost
    first = _literal([firsts.get(g) for g in range(len(ends) + 1)])
    before = _literal([previous.get(g) for g in range(len(ends) + 1)])
    at = F.col("__group").cast("int")
    ghost = F.when(F.col("__key").eqNullSafe(F.get(first, at)), F.get(before, at))
    places = F.concat(
        F.array(F.struct(at.alias("group"), F.lit(0).alias("ghost"))),
        F.transform(F.array_compact(F.array(ghost)), lambda g: F.struct(g.cast("int").alias("group"), F.lit(1).alias("ghost"))),
    )
    out = placed.select("__key", "__text", F.explode(places).alias("p")).select("__key", "__text", "p.group", "p.ghost")
    return out.repartition(partitions(spark), "group")


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints every text and its edited text, and grades both that likeness and the next document's.

    The edited text has its last floor(n / 3) code points replaced by the first as many (or
    all) of the next document by descending key; the last document's next is the first.
    Rows of one key are ordered by text; null keys come last. Null text counts as empty.
    A single row is its own next document.
    """
    prepare(docs.sparkSession)
    found = lexicon(docs, text, least, most)
    order = Window.partitionBy("group").orderBy("ghost", F.col("__key").desc_nulls_last(), "__text")
    rows = with_next(docs, key, text).withColumn("__next", F.lead("__text").over(order)).withColumn("__rn", F.row_number().over(order))
    n = F.length("__text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), n - third), F.substring(F.coalesce("__next", F.lit("")), F.lit(1), third))
    rows = rows.select("__key", "__text", "group", "ghost", "__rn", F.length("__text").cast("long").alias("n_chars"), edited.alias("__edited"))
    band = rows.select(
        "__key", "group", "ghost", "__rn", "n_chars",
        F.sha2(F.encode("__edited", "UTF-8"), 256).alias("edited_sha256"),
        F.xxhash64("__text", F.lit(-1)).alias("__whole"), F.xxhash64("__edited", F.lit(-1)).alias("__ewhole"),
        in_band(F.col("__text"), found).alias("__terms"), in_band(F.col("__edited"), found).alias("__eterms"),
    )
    rows = band.select(
        "__key", "group", "ghost", "__rn", "n_chars", "edited_sha256",
        hashes(F.col("__terms"), F.col("__whole")).alias("__print"), hashes(F.col("__eterms"), F.col("__ewhole")).alias("__eprint"),
    )
    rows = rows.withColumn("__nprint", F.lead("__print").over(Window.partitionBy("group").orderBy("__rn"))).where("ghost = 0")
    return rows.select(
        F.col("__key").alias(key),
        "n_chars",
        "edited_sha256",
        as_text(F.col("__print")).alias("fingerprint"),
        as_text(F.col("__eprint")).alias("edited_fingerprint"),
        likeness(F.col("__print"), F.col("__eprint")).alias("near_edited"),
        likeness(F.col("__print"), F.col("__nprint")).alias("near_next"),
    )
