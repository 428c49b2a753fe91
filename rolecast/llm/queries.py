"""The operators over their whole tables, with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.llm import chat, divergence, imatch, kneser_ney, licenses, mixing, neural_lm, packing, simhash, warc
from rolecast.llm.common import scratch, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence sentences and licences of every document, as lists joined by commas."""
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licences")]
    return found.select("doc_id", *joined, "n_unknown", "status")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page and reads the archive back."""
    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.catalogue(spark, path).withColumnRenamed("key", "page_id")


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return imatch.edits(table(spark, sf_dir, "documents"))


def op5_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the neural model and under the unigram baseline."""
    return neural_lm.lm_scores(table(spark, sf_dir, "documents"))


def op6_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a low-discrepancy mix of the sources takes of every document."""
    account = mixing.mix(table(spark, sf_dir, "documents"))[1]
    return account.select("doc_id", "size", "source_size", "target", "taken")


def op7_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether its distributions are near enough to its language's."""
    found = divergence.quality_scores(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 9) for c in ("class_distance", "word_distance")})


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its fingerprint (16 hex digits) and the least doc_id reachable over links of 4 bits or fewer."""
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, and one made of control strings, as a prefix tree, and reads the tree back."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(*chat.prefix_tree(given.unionByName(extra)))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under its language's model of trusted text, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.scores(docs, kneser_ney.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_licenses": op2_licenses,
    "op3_warc": op3_warc,
    "op4_imatch": op4_imatch,
    "op5_neural_lm": op5_neural_lm,
    "op6_schedule": op6_schedule,
    "op7_divergence": op7_divergence,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_kneser_ney": op10_kneser_ney,
}
#: The classes of divergence.CLASSES as patterns; what is left is "other".
CLASS_PATTERNS = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": r"""[.,;:!?''"()\-]""", "symbol": "[#*$%&|<>]", "wide": r"[^\x00-\x7F]"}


def _divergence_sql(rules: divergence.Rules) -> str:
    counted = ", ".join(f"len(regexp_extract_all(t, '{p}'))::DOUBLE AS {c}" for c, p in CLASS_PATTERNS.items())
    known, names = " + ".join(CLASS_PATTERNS), list(divergence.CLASSES)
    term = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
    return rf"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), grams AS (
            SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)
        ), hit AS (
            SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM grams, range(3) r(k) WHERE n > 1 GROUP BY rid
        ), base AS (
            SELECT d.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM d LEFT JOIN hit USING (rid)
        ), b AS (
            SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM base
        ), c AS (
            SELECT *, length(t) - ({known}) AS other FROM (SELECT rid, t, {counted} FROM b)
        ), shape AS (
            SELECT rid, length(t) AS chars, unnest({names}) AS item, unnest([{", ".join(names)}]) / length(t) AS p FROM c WHERE length(t) > 0
        ), words AS (
            SELECT rid, item, count(*)::DOUBLE AS n FROM (SELECT rid, unnest(list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS item FROM b) GROUP BY ALL
        ), fine AS (
            SELECT rid, unnest(list_distinct([lang, ''])) AS ref, n_words FROM b WHERE NOT base_failed
        ), total AS (
            SELECT ref, count(*) AS n FROM fine GROUP BY ref HAVING ref = '' OR n >= {rules.min_language_share} * (SELECT count(*) FROM b WHERE NOT base_failed)
        ), shape_ref AS (
            SELECT ref, item, sum(p) / any_value(total.n) AS q FROM fine JOIN shape USING (rid) JOIN total USING (ref) GROUP BY ALL
        ), word_ref AS (
            SELECT ref, item, sum(words.n / n_words) / any_value(total.n) AS q FROM fine JOIN words USING (rid) JOIN total USING (ref) GROUP BY ref, item
            HAVING q >= {rules.min_share} QUALIFY row_number() OVER (PARTITION BY ref ORDER BY q DESC, encode(item)) <= {rules.common_words}
        ), of AS (
            SELECT rid, CASE WHEN lang IN (SELECT ref FROM total) THEN lang ELSE '' END AS ref, n_words FROM b
        ), by_class AS (
            SELECT rid, sqrt(greatest(0, sum({term.format(p="p", q="q")} + {term.format(p="q", q="p")}) / 2)) AS x
            FROM of JOIN shape USING (rid) JOIN shape_ref USING (ref, item) WHERE chars >= {rules.min_chars} GROUP BY rid
        ), pairs AS (
            SELECT rid, word_ref.item, coalesce(words.n, 0) / n_words AS p, q FROM of JOIN word_ref USING (ref) LEFT JOIN words USING (rid, item) WHERE n_words >= {rules.min_common_words}
        ), whole AS (
            SELECT rid, p, q FROM pairs UNION ALL SELECT rid, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM pairs GROUP BY rid
        ), by_word AS (
            SELECT rid, sqrt(greatest(0, sum({term.format(p="p", q="q")} + {term.format(p="q", q="p")}) / 2)) AS x FROM whole GROUP BY rid
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND coalesce(by_class.x, 0) <= {rules.max_class_distance} AND coalesce(by_word.x, 0) <= {rules.max_word_distance} AS kept,
            round(by_class.x, 9) AS class_distance, round(by_word.x, 9) AS word_distance
        FROM b LEFT JOIN by_class USING (rid) LEFT JOIN by_word USING (rid)
    """


ORACLE_SQL: dict[str, str] = {
    "op7_divergence": _divergence_sql(divergence.Rules()),
    "op3_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
                strlen(coalesce(html, ''))::BIGINT AS payload_bytes
            FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY html) AS first,
                row_number() OVER (PARTITION BY html, page_id ORDER BY page_id) AS turn
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes < 100 OR (page_id = first AND turn = 1) THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN payload_bytes < 100 OR (page_id = first AND turn = 1) THEN NULL ELSE first END AS refers_to
        FROM f
    """,
    "op9_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS r,
                replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS t
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            sum(length('### ' || replace(r, ':', '\:') || ': ' || t || '</turn>' || chr(10)))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
