"""Quality rules by distribution divergence.

A document's character-class histogram and its histogram of common words are compared
with references of its language by the Jensen-Shannon distance (base 2, 0 to 1). The
references come from all documents: each that passes the base rules adds its own
normalised histogram, so that long ones weigh no more than short ones. Too short texts
give no evidence and are not judged by a histogram (minimum-length guards).
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecast.llm.common import cut, prepare, word_bytes

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "wide")
#: Entries of a worker's word counts beyond which it hands them on.
FLUSH_WORDS = 200_000


def _class_table() -> bytes:
    """Byte to class; the bytes after the first of a code point get the value past the last class."""
    kind = [6] * 256
    for codes, which in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\n\x0b\x0c\r", 3), (b".,;:!?'\"()-", 4), (SYMBOLS, 5)):
        for c in codes:
            kind[c] = which
    for c in range(128, 256):
        kind[c] = 7 if c >= 192 else len(CLASSES)
    return bytes(kind)


CLASS_OF = _class_table()


@dataclass(frozen=True)
class Rules:
    """Production parameters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Characters and words below which the histograms aren't judged.
    min_chars: int = 100
    min_common_words: int = 100
    max_class_distance: float = 0.3
    max_word_distance: float = 0.36
    common_words: int = 50
    #: Least share of a language's words for a common word; at most 1 / share words can reach it.
    min_share: float = 0.002
    #: Share of the documents that pass the base rules which a language needs for a reference of its own; others take
    #: that of all documents. At most 1 / share languages can reach it.
    min_language_share: float = 0.001


def class_histogram(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(CLASS_OF), np.uint8)
    return np.bincount(codes, minlength=len(CLASSES) + 1)[: len(CLASSES)]


def base_counts(text: str | None) -> tuple[list[bytes], int, int, int, int]:
    """The words; code points in them; symbols; repeated lines; words in repeated 3-word windows."""
    text = text or ""
    found = word_bytes(text)
    raw = text.encode("utf-8", "surrogatepass")
    joined = b"".join(found)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = list(zip(found, found[1:], found[2:]))
    repeats = 0
    if len(set(grams)) < len(grams):
        times, last = Counter(grams), 0
        for i, gram in enumerate(grams):
            if times[gram] > 1:
                repeats += i + 3 - max(i, last)
                last = i + 3
    return found, chars, symbols, len(lines) - len(set(lines)), repeats


def base_failed(n_words: int, repeats: int, rules: Rules) -> bool:
    return n_words < rules.min_words or 100 * repeats > rules.max_repeat_percent * n_words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """The Jensen-Shannon distance of two histograms, each with a positive sum."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0).sum(), np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


STATS = "lang string, kind string, item binary, value double"


def _gather(rules: Rules):
    """Sums for each language and for all (null): words ('w') in normalised shares, classes ('c'), documents ('n')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        documents: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(k, "w", w, v) for k, c in held.items() for w, v in c.items()]
            rows += [(k, "c", name.encode(), float(v)) for k, c in classes.items() for name, v in zip(CLASSES, c)]
            rows += [(k, "n", b"", float(v)) for k, v in documents.items()]
            held.clear(), classes.clear(), documents.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.float64())],
                names=["lang", "kind", "item", "value"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, _, _, _, repeats = base_counts(text)
                if base_failed(len(found), repeats, rules):
                    continue
                shape, share = class_histogram(text), 1 / len(found)
                key = lang or ""
                counts = held.setdefault(key, Counter())
                for w, n in Counter(found).items():
                    counts[w.lower()] += n * share
                classes[key] = classes.get(key, 0) + shape / shape.sum()
                documents[key] += 1
            if sum(map(len, held.values())) > FLUSH_WORDS:
                yield out()
        if documents:
            yield out()

    return run


@dataclass(frozen=True)
class Reference:
    """A language's shares: of the character classes, and of its common words with the rest last."""

    classes: np.ndarray
    words: dict[bytes, int]
    shares: np.ndarray


def references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> dict[str, Reference]:
    """Language references over all documents; '' is that of all languages together. Empty for an empty table."""
    prepare(docs.sparkSession)
    sums = cut(
        docs.select(F.col(lang).cast("string"), F.col(text))
        .mapInArrow(_gather(rules), STATS)
        .groupBy("lang", "kind", "item")
        .agg(F.sum("value").alias("value"))
    )
    counts = sums.where("kind = 'n'").select("lang", F.col("value").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    top = [(r.lang, r.n) for r in counts.where(F.col("n") >= rules.min_language_share * total).collect()]
    keep = {k for k, _ in top}
    whole = sums.where("kind <> 'n'").groupBy("kind", "item").agg(F.sum("value").alias("value")).select(F.lit("").alias("lang"), "kind", "item", "value")
    own = sums.where(F.col("lang").isin([k for k in keep if k]) & (F.col("kind") != "n")) if keep - {""} else sums.limit(0)
    docs_of = F.create_map(*[x for k, n in [*((k, n) for k, n in top if k), ("", total)] for x in (F.lit(k), F.lit(float(n)))])
    share = F.col("value") / docs_of[F.col("lang")]
    rows = own.unionByName(whole).where((F.col("kind") == "c") | (share >= rules.min_share)).select("lang", "kind", "item", share.alias("share")).collect()
    found = {}
    by_lang: dict[str, tuple[dict[str, float], list[tuple[float, bytes]]]] = {}
    for r in rows:
        shapes, words = by_lang.setdefault(r.lang, ({}, []))
        if r.kind == "c":
            shapes[bytes(r.item).decode()] = r.share
        else:
            words.append((r.share, bytes(r.item)))
    for key, (shapes, words) in by_lang.items():
        words = sorted(words, key=lambda x: (-x[0], x[1]))[: rules.common_words]
        shares = np.array([s for s, _ in words] + [max(0.0, 1 - sum(s for s, _ in words))])
        found[key] = Reference(np.array([shapes.get(c, 0.0) for c in CLASSES]), {w: i for i, (_, w) in enumerate(words)}, shares)
    return found


def judge(text: str | None, lang: str | None, refs: dict[str, Reference], rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class and word distance (null: not judged)."""
    found, chars, symbols, lines, repeats = base_counts(text)
    failed = base_failed(len(found), repeats, rules)
    ref = refs.get(lang or "") or refs.get("")
    by_class = by_word = None
    if ref is not None and found:
        shape = class_histogram(text)
        if shape.sum() >= rules.min_chars:
            by_class = distance(shape.astype(float), ref.classes)
        if len(found) >= rules.min_common_words and len(ref.words):
            common = np.zeros(len(ref.shares))
            for w, n in Counter(found).items():
                common[ref.words.get(w.lower(), -1)] += n
            by_word = distance(common, ref.shares)
    far = (by_class or 0) > rules.max_class_distance or (by_word or 0) > rules.max_word_distance
    return len(found), chars, symbols, lines, repeats, failed, not failed and not far, by_class, by_word


JUDGED = (
    ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()),
    ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()),
    ("n_repeat_words", T.LongType(), pa.int64()),
    ("base_failed", T.BooleanType(), pa.bool_()),
    ("kept", T.BooleanType(), pa.bool_()),
    ("class_distance", T.DoubleType(), pa.float64()),
    ("word_distance", T.DoubleType(), pa.float64()),
)


def quality_scores(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for every row of docs: key and the columns of JUDGED.

    Null text counts as empty: no words, base_failed, not kept. A null or unknown language
    is held against the reference of all documents. Repeated rows are judged alike; other
    columns are not read.
    """
    refs = references(docs, rules, text, lang)
    fields = T.StructType([docs.schema[key], *(T.StructField(n, t) for n, t, _ in JUDGED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, g, refs, rules) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(JUDGED)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *(n for n, _, _ in JUDGED)])

    return docs.select(F.col(key), F.col(text), F.col(lang).cast("string").alias("__lang")).mapInArrow(run, fields)


def quality_filter(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    refs = references(docs, rules, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist())
            yield batch.filter(pa.array([judge(t, g, refs, rules)[6] for t, g in pairs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
