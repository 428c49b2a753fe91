"""Named queries over imports, pushes, folds in other modes and maintenance."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.functions import text
from rolecast.operators import ops, registry, schedule, snapshots
from rolecast.plans import analogues as a
from rolecast.plans.queries import NOW, query, sql_values, values
from rolecast.sources import sinks, staged


@query(
    """WITH r AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'workday' ELSE 'lever' END AS provider, CASE WHEN event_id % 2 = 0 THEN 'U' ELSE 'u' END || user_id AS board_key, (event_id % 9)::VARCHAR AS source_id FROM events),
    w AS (SELECT lower(board_key) || ':' || source_id AS key, min(event_id) AS event_id FROM r WHERE provider = 'workday' GROUP BY lower(board_key), source_id)
    SELECT key, event_id FROM w UNION ALL SELECT board_key || ':' || source_id, event_id FROM r WHERE provider = 'lever'"""
)
def workday_case_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    board = F.concat(F.when(F.col("event_id") % 2 == 0, "U").otherwise("u"), F.col("user_id").cast("string"))
    rows = e.select("event_id", F.when(F.col("user_id") % 2 == 0, "workday").otherwise("lever").alias("provider"), board.alias("board_key"), (F.col("event_id") % 9).cast("string").alias("source_id"))
    rows = rows.withColumn("key", F.concat("board_key", F.lit(":"), "source_id"))
    return snapshots.collapse_case_variants(rows, "event_id").select("key", "event_id")


@query(
    """WITH r AS (SELECT page_id, regexp_extract(url, '^https?://([^/.]*)', 1) AS i, CASE page_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'empty' END AS s FROM pages WHERE page_id % 2 = 0)
    SELECT 'lever:global:' || i AS key, 'https://jobs.lever.co/' || i AS board_url, max(page_id)::VARCHAR AS newest FROM r WHERE s = 'active' GROUP BY i"""
)
def board_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated boards of a provider; what a record says is replaced by what its URL says."""
    p, k = a.table(spark, sf_dir, "pages"), F.col("page_id")
    name = F.split(text.url_host(F.col("url")), r"\.")[0]
    records = p.select(
        F.lit("stale").alias("key"), F.when(k % 2 == 0, "lever").otherwise("gem").alias("provider"), name.alias("identifier"), F.lit("global").alias("region"), F.concat(F.lit("jobs.lever.co/"), name, F.lit("/x")).alias("board_url"),
        F.lit("").alias("api_url"), F.when(k % 3 == 0, '{"status": "active"}').when(k % 3 == 1, '{"status": "empty"}').alias("validation"), k.alias("ord"),
    )
    newest = records.where("validation like '%active%' and provider = 'lever'").groupBy("identifier").agg(F.max("ord").cast("string").alias("newest"))
    return registry.import_boards(records, ["lever"], True).join(newest, "identifier").select("key", "board_url", "newest")


@query("SELECT (event_id % 50)::VARCHAR AS id, arg_max(event_type, (ts >= TIMESTAMP '2024-01-10', ts)) AS status FROM events GROUP BY 1")
def discovery_page_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").select((F.col("event_id") % 50).cast("string").alias("id"), F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated_at"))
    return registry.upsert_pages(e.where("updated_at < '2024-01-10'"), e.where("updated_at >= '2024-01-10'")).select("id", "status")


@query("SELECT event_id::VARCHAR AS key FROM events WHERE user_id % 5 > 0 AND event_type <> 'error' AND event_id % 3 > 0")
def sync_request_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    k, b = F.col("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    board = F.struct(b.alias("key"), F.lit("p").alias("provider"), F.lit("i").alias("identifier"), F.lit("active").alias("status"), F.when(F.col("user_id") % 5 > 0, F.lit(NOW)).alias("synced_at"))
    job = F.struct(
        k.cast("string").alias("key"), k.alias("source_id"), F.when(k % 3 > 0, b).otherwise("other").alias("board_key"), F.lit("p").alias("provider"), F.lit("i").alias("company_identifier"),
        F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("title"), F.lit("u").alias("url"),
    )
    return snapshots.sound_requests(e.select(board.alias("board"), job.alias("job"))).select("job.key")


@query(f"WITH {a.JOBS_SQL} SELECT key, published_at FROM jobs ORDER BY coalesce(published_at, '') DESC, key")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export_order(a.jobs(spark, sf_dir).select("key", "published_at"))


COMPACT = ["key", "source_id", "board_key", "provider", "company_identifier", "company_name", "company_logo_url", "title", "location", "country", "city", "role_family", "company_industry", "workplace", "employment_type", "category", "url"]


@query(
    f"""WITH {a.JOBS_SQL}, j AS (SELECT *, key AS source_id FROM jobs)
    SELECT key, sha256(concat_ws(chr(31), {", ".join(f"coalesce({c}, chr(0))" for c in COMPACT)})) AS fingerprint FROM j"""
)
def compact_job_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date is no part of it."""
    return snapshots.compact_jobs(a.jobs(spark, sf_dir).withColumn("source_id", F.col("key"))).select("key", "fingerprint")


@query(
    f"""WITH {a.POSTINGS_SQL}, {a.RESULTS_SQL}, fine AS (SELECT key AS b FROM r WHERE status <> 'error')
    SELECT count(*) FILTER (old.key IS NULL) AS inserted, count(*) FILTER (old.key IS NOT NULL AND old.ord % 5 = 0) AS reopened,
    count(*) FILTER (old.ord % 5 > 0 AND (old.title, old.location) IS DISTINCT FROM (new.title, new.location)) AS updated FROM new JOIN fine ON b = new.board_key LEFT JOIN old ON old.key = new.key"""
)
def snapshot_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rolecast.plans.queries import TINY, _fold

    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    return _fold(spark, sf_dir, TINY).agg(count("inserted"), count("reopened"), count("updated"))


SUMMARIES = (('{"syncedAt": "t0", "summary": {"boardCount": 3, "statuses": {"active": 2, "error": 1}}}', "t0", 3, 0, 2, 0, 0, 1), ('{"syncedAt": "t1"}', "t1", 0, 0, 0, 0, 0, 0))


@query(f"SELECT synced_at, COLUMNS('_(count|boards)$')::BIGINT FROM {sql_values('v', 'd, synced_at, board_count, job_count, active_boards, empty_boards, invalid_boards, error_boards', *SUMMARIES)}")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged.run_summary(values(spark, "d string", *[(s[0],) for s in SUMMARIES]), "d")


STRINGS = (("  a b\t", "a b"), (" x﻿", "x"), (" ", None), ("", None), (None, None))


@query(f"SELECT * FROM {sql_values('v', 'given, clean', *STRINGS)}")
def clean_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, "given string, expected string", *STRINGS).select("given", text.clean_string(F.col("given")).alias("clean"))


@query(
    """SELECT c_custkey, replace(replace(c_name || CASE WHEN c_custkey % 2 = 0 THEN '|a b!' ELSE '' END, '#', '%23'), ' ', '%20') AS id FROM (SELECT c_custkey, c_name FROM customer) t"""
    .replace("'|a b!'", "'%7Ca b!'")
)
def stable_fallback_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return a.table(spark, sf_dir, "customer").select("c_custkey", text.stable_fallback_id(F.col("c_name"), F.lit(None).cast("string"), F.when(k % 2 == 0, "a b!").otherwise("")).alias("id"))


@query("SELECT event_id, (trunc(value - 50)::BIGINT % 7 + 7) % 7 AS modulo FROM events")
def positive_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "events").select("event_id", text.positive_modulo(F.col("value") - 50, F.lit(7)).alias("modulo"))


@query(
    """SELECT 'sync_only' AS name, 'sync' AS due UNION ALL SELECT 'both', 'discovery,sync' UNION ALL SELECT 'none', ''"""
)
def updater_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"sync_only": {"last_sync_at": "2026-07-21T11:00:00.000Z", "last_discovery_at": "2026-07-20T00:00:00.000Z"}, "both": {}, "none": {"last_sync_at": "2026-07-21T11:30:00.000Z", "last_discovery_at": "2026-07-20T00:00:00.000Z"}}
    return values(spark, "name string, due string", *[(k, ",".join(schedule.due(v, NOW))) for k, v in given.items()])


@query(
    f"""WITH {a.JOBS_SQL}, s AS (SELECT *, CASE WHEN is_active = 0 THEN published_at END AS closed_at FROM jobs)
    SELECT title, count(*) AS job_count FROM s WHERE is_active = 1 GROUP BY 1"""
)
def maintenance_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = a.jobs(spark, sf_dir).withColumn("closed_at", F.when(F.col("is_active") == 0, F.col("published_at")))
    boards = a.boards(spark, sf_dir)
    failures = boards.select("key", F.col("key").alias("board_key"), F.lit(None).cast("string").alias("resolved_at"))
    health = boards.select("provider", F.lit(0).cast("bigint").alias("active_jobs")).distinct()
    runs = boards.select("key", F.col("updated_at").alias("started_at"))
    return schedule.maintenance(jobs, runs, failures, boards, health, NOW, ops.archive_rows(jobs, NOW))["titles"]


@query(
    f"""WITH {a.BOARDS_SQL} SELECT key, CASE WHEN queue_state = 'queued' AND key IN (SELECT key FROM boards WHERE job_count < 20) THEN 'idle' ELSE queue_state END AS queue_state FROM boards"""
)
def release_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = a.boards(spark, sf_dir)
    return ops.release(boards, boards.where("job_count < 20"), NOW).select("key", "queue_state")


@query(
    f"""SELECT event_id::VARCHAR AS board_key, 'unknown' AS task_type, 1::BIGINT AS attempts, '{NOW}' AS created_at FROM events WHERE event_type = 'error'"""
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").where("event_type = 'error'")
    tasks = e.select(F.lit(None).cast("string").alias("type"), F.lit("p").alias("provider"), F.col("event_id").cast("string").alias("board_key"), F.col("props").alias("payload"), F.lit("e").alias("error"), F.lit(1).cast("bigint").alias("attempts"))
    return ops.dead_letters(tasks, NOW).select("board_key", "task_type", "attempts", "created_at")
