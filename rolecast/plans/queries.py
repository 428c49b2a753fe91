"""Named queries over the test tables, each beside the SQL that another engine runs."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.functions import text
from rolecast.operators import ops, registry, snapshots
from rolecast.plans import analogues as a
from rolecast.plans import jobs as j
from rolecast.plans.jobs import JobQuery

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2026-07-21T12:00:00.000Z"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_values(alias: str, columns: str, *rows: tuple) -> str:
    """An inline table of SQL."""
    body = ", ".join("(" + ", ".join(sql_text(v) if v is None or isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({columns})"


# Job queries ----------------------------------------------------------------------------

PAGE = ["key", "title", "company_identifier", "company_name", "company_logo_url", "location", "country", "workplace", "category", "provider", "published_at"]
WITH = f"WITH {a.JOBS_SQL}"
WITH_LOGOS = (
    f"WITH {a.JOBS_SQL}, {a.BOARDS_SQL}, {a.COMPANIES_SQL}, shown AS (SELECT j.* EXCLUDE (company_logo_url), coalesce(j.company_logo_url, c.logo_url) AS company_logo_url "
    "FROM jobs j LEFT JOIN boards b ON b.key = j.board_key LEFT JOIN companies c ON c.key = b.company_key)"
)


def _page(q: JobQuery, mode: str = "offset"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return j.page(a.jobs(spark, sf_dir), q, mode).select(*PAGE)

    return run


def _page_sql(where: str, order: str, limit: int = 50, offset: int = 0) -> str:
    return f"{WITH} SELECT {', '.join(PAGE)} FROM jobs WHERE is_active = 1 AND ({where}) ORDER BY {order} LIMIT {limit} OFFSET {offset}"


NEWEST, OLDEST = "coalesce(published_at, '') DESC, key", "coalesce(published_at, '') ASC, key"
COMPANY = "lower(coalesce(company_name, company_identifier)), key"
ALL = "true"
for _name, _q, _where, _order, _limit, _offset in (
    ("jobs_oldest_page", JobQuery(sort="oldest", limit=100), ALL, OLDEST, 100, 0),
    ("jobs_company_page", JobQuery(sort="company", limit=100), ALL, COMPANY, 100, 0),
    ("jobs_offset_page", JobQuery(limit=25, offset=60), ALL, NEWEST, 25, 60),
    ("jobs_limit_clamped", JobQuery(limit=5000, offset=-3), ALL, NEWEST, 100, 0),
    ("search_substring", JobQuery(search="ring cus"), "lower(title || ' ' || company_identifier || ' ' || coalesce(company_name, '') || ' ' || coalesce(department, '')) LIKE '%ring cus%'", NEWEST, 50, 0),
    ("like_escaped", JobQuery(location="NATION_1", company="nation_", title="R%"), "contains(lower(coalesce(location, '')), 'nation_1') AND contains(lower(coalesce(company_name, company_identifier)), 'nation_') AND contains(lower(title), 'r%')", NEWEST, 50, 0),
    ("like_raw_wildcards", JobQuery(title="r_d", location=" nation%7 ", likes="raw"), "lower(title) LIKE '%r_d%' AND lower(coalesce(location, '')) LIKE '%nation%7%'", NEWEST, 50, 0),
    ("set_filter_cap12", JobQuery(city=",".join(f"NATION_{i}" for i in range(20)), provider="House Hold, machinery"), "city IN (" + ", ".join(f"'NATION_{i}'" for i in range(12)) + ") AND provider IN ('household', 'machinery')", NEWEST, 50, 0),
    ("facet_filters", JobQuery(workplace="Remote,Hybrid", category="2-HIGH", employment_type="Full-Time", industry="FURNITURE,MACHINERY", role_family="Brand#2,Brand#4,Brand#17"), "workplace IN ('Remote', 'Hybrid') AND category = '2-HIGH' AND employment_type = 'Full-Time' AND company_industry IN ('FURNITURE', 'MACHINERY') AND role_family IN ('Brand#2', 'Brand#4', 'Brand#17')", NEWEST, 50, 0),
    ("anywhere_filter", JobQuery(country="anywhere"), "country IS NULL AND workplace = 'Remote'", NEWEST, 50, 0),
    ("country_filter", JobQuery(country="N1, n2"), "country IN ('n1', 'n2')", NEWEST, 50, 0),
    ("posted_within", JobQuery(posted_within="900 days", now="2000-06-15T12:00:00.000Z"), "published_at >= '1997-12-28 12:00:00'", NEWEST, 50, 0),
):
    query(_page_sql(_where, _order, _limit, _offset), _name)(_page(_q))

CURSOR = {"value": "1998-06-01T00:00:00.000Z", "key": "000000000500"}
query(
    _page_sql(f"coalesce(published_at, '') < '{CURSOR['value']}' OR (coalesce(published_at, '') = '{CURSOR['value']}' AND key > '{CURSOR['key']}')", NEWEST, 100),
    "jobs_keyset_page2",
)(_page(JobQuery(cursor=j.encode_cursor(**CURSOR)), "keyset"))
query(_page_sql("lower(coalesce(company_name, company_identifier)) > 'nation_12' OR (lower(coalesce(company_name, company_identifier)) = 'nation_12' AND key > '000000000100')", COMPANY, 40), "jobs_keyset_company")(
    _page(JobQuery(sort="company", limit=40, cursor=j.encode_cursor(value="nation_12", key="000000000100")), "keyset")
)
query(_page_sql(ALL, NEWEST, 100), "jobs_bad_cursor_ignored")(_page(JobQuery(cursor="no cursor"), "keyset"))
query(_page_sql(ALL, NEWEST, 30, 90), "jobs_offset_cursor")(_page(JobQuery(limit=30, cursor=j.encode_cursor(offset=90))))


@query(f"{WITH_LOGOS} SELECT {', '.join(PAGE)} FROM shown WHERE is_active = 1 AND category IN ('1-URGENT', '2-HIGH') ORDER BY {NEWEST} LIMIT 100")
def jobs_newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a filtered, sorted page with its companies' logos. The joins only meet the page's rows."""
    rows = j.page(a.jobs(spark, sf_dir), JobQuery(category="1-URGENT,2-HIGH", limit=100))
    return j.with_logos(rows, a.boards(spark, sf_dir), a.companies(spark, sf_dir)).select(*PAGE)


@query(f"{WITH} SELECT count(*) AS total FROM jobs WHERE is_active = 1 AND workplace = 'Remote'")
def jobs_total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.total(a.jobs(spark, sf_dir), JobQuery(workplace="Remote", cursor=j.encode_cursor(offset=5)))


HUMAN_SQL = "array_to_string(list_transform(regexp_extract_all(regexp_replace({0}, '[._-]+', ' ', 'g'), '([0-9A-Za-z_]+|[^0-9A-Za-z_]+)'), lambda w: upper(w[1]) || w[2:]), '')"


@query(
    f"""{WITH}, p AS (SELECT * FROM jobs WHERE is_active = 1 ORDER BY {NEWEST} LIMIT 50), c AS (SELECT *, coalesce(company_name, {HUMAN_SQL.format("company_identifier")}) AS company FROM p)
    SELECT key AS id, title, company, upper(array_to_string(list_transform(list_filter(string_split_regex(company, '\\s+'), lambda w: w <> '')[:2], lambda w: w[1]), '')) AS company_mark,
        coalesce(location, 'Location not specified') AS location, CASE WHEN category IN ('1-URGENT') THEN category ELSE 'Other' END AS category,
        upper(provider[1]) || provider[2:] AS source, '' AS description,
        list_reduce(list_transform(string_split(company, ''), lambda x: ascii(x)::BIGINT), lambda h, x: (h * 31 + x) & 4294967295, 0::BIGINT) % 8 AS company_colour
    FROM c"""
)
def public_jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = j.public_jobs(j.page(a.jobs(spark, sf_dir), JobQuery()), ["1-URGENT"], description=False)
    return shown.select("id", "title", "company", "company_mark", "location", "category", "source", "description", "company_colour")


@query(
    """SELECT doc_id FROM documents, (SELECT ' ' AS s)
    WHERE contains(' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'), ' '), ' the')
      AND contains(' ' || array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'), ' '), ' licensed under')"""
)
def search_fts_prefix_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search tokens: a plain one is a prefix, one with marks is a phrase whose last word is a prefix."""
    docs = a.table(spark, sf_dir, "documents")
    return docs.where(j.fts_match("The licensed-under", F.col("text"))).select("doc_id")


@query("SELECT p_name AS title, count(*) AS job_count FROM part WHERE p_partkey % 3 > 0 GROUP BY 1")
def title_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.title_counts(_titles(spark, sf_dir))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 > 0, 1).otherwise(0).alias("is_active"))


@query(
    """SELECT title, job_count FROM (SELECT p_name AS title, count(*) AS job_count FROM part WHERE p_partkey % 3 > 0 GROUP BY 1)
    WHERE contains(lower(title), 're') ORDER BY CASE WHEN starts_with(lower(title), 're') THEN 0 ELSE 1 END, job_count DESC, title LIMIT 8"""
)
def title_suggest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.suggest_titles(j.title_counts(_titles(spark, sf_dir)), " RE ")


@query(
    f"""WITH {a.JOBS_SQL}, {a.BOARDS_SQL} SELECT (SELECT count(*) FROM jobs WHERE is_active = 1) AS active_jobs, (SELECT count(*) FROM jobs WHERE is_active = 0) AS closed_jobs,
    (SELECT count(*) FROM boards WHERE status = 'active') AS active_boards, (SELECT max(last_synced_at) FROM boards) AS last_synced_at"""
)
def stats_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = a.boards(spark, sf_dir)
    return j.stats(a.jobs(spark, sf_dir), boards, boards.select(F.col("last_synced_at").alias("synced_at")))


# Operations -----------------------------------------------------------------------------


@query(
    f"""WITH {a.JOBS_SQL}, {a.BOARDS_SQL} SELECT (SELECT count(*) FROM jobs WHERE is_active = 1) AS active_jobs, (SELECT count(*) FROM boards) AS boards,
    (SELECT count(*) FROM boards WHERE next_sync_at <= '2026-07-21 12:00:00') AS due_boards, (SELECT count(*) FROM events WHERE event_type = 'error' AND event_id % 2 = 0) AS unresolved_failures"""
)
def health_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = a.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.when(F.col("event_id") % 2 == 1, F.lit(NOW)).alias("resolved_at"))
    return ops.health_row(a.jobs(spark, sf_dir), a.boards(spark, sf_dir), failures, NOW)


@query(
    f"""WITH {a.JOBS_SQL}, n AS (SELECT provider, count(*) AS n FROM jobs WHERE is_active = 1 AND category <> '5-LOW' AND provider <> 'furniture' GROUP BY 1)
    SELECT h.provider, coalesce(n.n, 7) AS active_jobs FROM (SELECT DISTINCT lower(c_mktsegment) AS provider FROM customer) h LEFT JOIN n USING (provider)"""
)
def provider_active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers without postings keep the number they had."""
    health = a.boards(spark, sf_dir).select("provider").distinct().withColumn("active_jobs", F.lit(7).cast("bigint"))
    return ops.reconcile_health(health, a.jobs(spark, sf_dir).where("category <> '5-LOW' and provider <> 'furniture'")).select("provider", "active_jobs")


@query(
    f"""WITH {a.BOARDS_SQL}, s AS (SELECT *, CASE WHEN queue_state = 'queued' AND updated_at < '2026-07-10 10:00:00' THEN 'idle' ELSE queue_state END AS q FROM boards)
    SELECT key, provider, next_sync_at FROM s WHERE q = 'idle' AND next_sync_at <= '2026-07-10T12:00:00.000Z' ORDER BY next_sync_at, key LIMIT 500"""
)
def due_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = "2026-07-10T12:00:00.000Z"
    return ops.due_boards(ops.reclaim_stuck(a.boards(spark, sf_dir), now), now).select("key", "provider", "next_sync_at")


@query(f"WITH {a.BOARDS_SQL} SELECT key, CASE WHEN queue_state = 'queued' AND updated_at < '2026-07-10 10:00:00' THEN 'idle' ELSE queue_state END AS queue_state FROM boards")
def stuck_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reclaim_stuck(a.boards(spark, sf_dir), "2026-07-10T12:00:00.000Z").select("key", "queue_state")


@query(
    f"""WITH {a.BOARDS_SQL}, d AS (SELECT key, status, date_diff('second', strptime(last_synced_at, '%Y-%m-%dT%H:%M:%S.%gZ'), TIMESTAMP '2026-07-21 12:00:00') / 3600.0 AS h FROM boards)
    SELECT key FROM d WHERE CASE WHEN h IS NULL THEN true WHEN status = 'invalid' THEN h >= 168 WHEN status = 'empty' THEN h >= 24 ELSE true END"""
)
def adaptive_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = a.boards(spark, sf_dir)
    return ops.adaptively_due(boards.select("key"), boards, NOW).select("key")


@query(f"WITH {a.BOARDS_SQL} SELECT key FROM boards WHERE last_synced_at IS NULL OR last_synced_at >= '2026-07-11'")
def only_new_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = a.boards(spark, sf_dir)
    return registry.only_new(boards, boards.where("last_synced_at < '2026-07-11'")).select("key")


@query(
    f"""WITH {a.BOARDS_SQL}, d AS (SELECT key FROM boards WHERE queue_state = 'idle' AND next_sync_at <= '2026-07-10T12:00:00.000Z' ORDER BY next_sync_at, key LIMIT 40)
    SELECT key, CASE WHEN key IN (SELECT key FROM d) THEN 'queued' ELSE queue_state END AS queue_state FROM boards"""
)
def claim_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards, now = a.boards(spark, sf_dir), "2026-07-10T12:00:00.000Z"
    return ops.claim(boards, ops.due_boards(boards, now, 40), now).select("key", "queue_state")


@query(f"WITH {a.BOARDS_SQL} SELECT key, provider, CAST((row_number() OVER (PARTITION BY provider ORDER BY key) - 1) // 100 AS BIGINT) AS batch FROM boards")
def chunked_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.batches(a.boards(spark, sf_dir), 100, "key", group="provider").select("key", "provider", "batch")


EVENTS_CLOSED = "SELECT event_id::VARCHAR AS key, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS closed_at, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_active FROM events"


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("key"), F.date_format("ts", text.ISO).alias("closed_at"), F.when(F.col("event_type") == "view", 1).otherwise(0).alias("is_active"))


@query(f"WITH j AS ({EVENTS_CLOSED}) SELECT key FROM j WHERE NOT (is_active = 0 AND closed_at < '2024-01-11 12:00:00')")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.prune(_closed(spark, sf_dir), "closed_at", "2024-02-10T12:00:00.000Z", 30, also=F.col("is_active") == 0).select("key")


@query(
    f"""WITH j AS ({EVENTS_CLOSED}), gone AS (SELECT key FROM j WHERE is_active = 0 AND closed_at < '2024-01-11 12:00:00' ORDER BY closed_at, key LIMIT 500)
    SELECT key FROM j WHERE key NOT IN (SELECT key FROM gone)"""
)
def retention_prune_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.prune(_closed(spark, sf_dir), "closed_at", "2024-02-10T12:00:00.000Z", 30, 500, F.col("is_active") == 0).select("key")


@query(f"WITH j AS ({EVENTS_CLOSED}) SELECT key, closed_at, '2024-02-10' AS day FROM j WHERE is_active = 0 AND closed_at < '2024-01-11 12:00:00' ORDER BY closed_at, key LIMIT 5000")
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.archive_rows(_closed(spark, sf_dir), "2024-02-10T12:00:00.000Z").select("key", "closed_at", "day")


@query(
    f"""WITH {a.RESULTS_SQL} SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 3 = 0 THEN 'before' WHEN r.key IS NOT NULL THEN '{NOW}' END AS resolved_at
    FROM events LEFT JOIN (SELECT key FROM r WHERE status <> 'error') r ON r.key = 'u' || user_id WHERE event_type = 'error'"""
)
def resolve_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").where("event_type = 'error'")
    failures = e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("board_key"), F.when(F.col("event_id") % 3 == 0, "before").alias("resolved_at"))
    return ops.resolve_failures(failures, a.results(spark, sf_dir), NOW).select("id", "resolved_at")


@query(
    "SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at FROM events WHERE event_type = 'error' AND event_id % 3 > 0 ORDER BY created_at DESC, id LIMIT 200"
)
def unresolved_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").where("event_type = 'error'")
    failures = e.select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", text.ISO).alias("created_at"), F.when(F.col("event_id") % 3 == 0, "before").alias("resolved_at"))
    return ops.unresolved(failures).select("id", "created_at")


@query(
    f"""WITH {a.COMPANIES_SQL}, {a.RESULTS_SQL}, x AS (SELECT r.key, r.status, 'n' || (substr(r.key, 2)::INT % 25) AS company_key, substr(r.key, 2)::INT % 4 = 0 AS has_logo FROM r)
    SELECT x.key FROM x LEFT JOIN companies c ON c.key = x.company_key
    WHERE status <> 'error' AND NOT has_logo AND logo_url IS NULL AND coalesce(logo_checked_at, '') <= '2026-06-21T12:00:00.000Z'"""
)
def stale_logo_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring(F.col("key"), F.lit(2), F.length("key")).cast("int")
    found = a.results(spark, sf_dir).withColumn("company_key", F.concat(F.lit("n"), (number % 25).cast("string"))).withColumn("has_logo", number % 4 == 0)
    return ops.stale_logos(found, a.companies(spark, sf_dir), NOW).select("key")


@query(
    f"""WITH {a.RESULTS_SQL} SELECT provider, count(*) AS boards, CAST(sum(job_count) AS BIGINT) AS jobs, count(*) FILTER (status = 'active') AS active_boards,
    count(*) FILTER (status = 'empty') AS empty_boards, count(*) FILTER (status = 'invalid') AS invalid_boards, count(*) FILTER (status = 'error') AS error_boards FROM r GROUP BY 1"""
)
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.sync_summary(a.results(spark, sf_dir))


@query(f"WITH {a.BOARDS_SQL} SELECT provider, count(*) AS boards, count(*) FILTER (status = 'active') AS active, CAST(coalesce(sum(CASE WHEN key <> 'c3' THEN job_count END), 0) AS BIGINT) AS jobs FROM boards GROUP BY 1")
def report_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.report_by_provider(a.boards(spark, sf_dir).withColumn("job_count", F.when(F.col("key") != "c3", F.col("job_count"))))


@query(f"WITH {a.BOARDS_SQL} SELECT coalesce(CASE WHEN status <> 'empty' THEN status END, 'unvalidated') AS status, count(*) AS boards FROM boards GROUP BY 1")
def report_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.status_counts(a.boards(spark, sf_dir).withColumn("status", F.when(F.col("status") != "empty", F.col("status"))))


# Registry and sampling ------------------------------------------------------------------


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    pages = F.array_sort(F.collect_set((F.col("event_id") % 97).cast("bigint")))
    return e.groupBy(F.col("user_id").alias("target")).agg(pages.alias("sampled_pages"), (F.max("user_id") % 90 + 3).alias("total_pages"))


@query(
    """WITH l AS (SELECT user_id, count(DISTINCT event_id % 97) AS n, user_id % 90 + 3 AS total FROM events GROUP BY user_id)
    SELECT count(*) AS targets, count(*) FILTER (n >= total) AS completed, CAST(sum(total) AS BIGINT) AS total_pages, CAST(sum(least(n, total)) AS BIGINT) AS sampled_pages,
    round(sum(least(n, total))::DOUBLE / sum(total), 4) AS completion FROM l"""
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.coverage_summary(_ledger(spark, sf_dir))


@query(
    """WITH a AS (SELECT user_id AS target, event_id % 97 AS page, ts >= TIMESTAMP '2024-01-16' AS late FROM events), t AS (SELECT target, CASE WHEN bool_or(late) THEN 60 ELSE 97 END AS total_pages FROM a GROUP BY 1),
    l AS (SELECT t.target, t.total_pages, list_sort(list(DISTINCT page) FILTER (page < total_pages)) AS p FROM a JOIN t USING (target) GROUP BY 1, 2)
    SELECT target, total_pages::BIGINT AS total_pages, coalesce(array_to_string(p, ','), '') AS pages, coalesce(len(p), 0) >= total_pages AS completed FROM l"""
)
def coverage_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), (F.col("event_id") % 97).alias("page"), (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("late"))
    pages = lambda late, total, at: e.where(late).groupBy("target").agg(F.lit(total).cast("bigint").alias("total_pages"), F.collect_set("page").alias("sampled_pages"), F.lit(at).alias("sampled_at"))
    after = registry.record_coverage(pages(~F.col("late"), 97, "t0"), pages(F.col("late"), 60, "t1"))
    return after.select("target", "total_pages", F.array_join(F.transform("sampled_pages", lambda p: p.cast("string")), ",").alias("pages"), "completed")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.keep_first(a.table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def union_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    return snapshots.keep_first(e.where("event_type = 'view'").unionByName(e.where("event_type <> 'view'")), "user_id", F.desc("event_id")).select("event_id", "user_id")


@query("SELECT 'u' || user_id AS board, arg_min(props, event_id) FILTER (event_type = 'purchase') AS company_name FROM events GROUP BY 1")
def first_nonnull_by_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").withColumn("name", F.when(F.col("event_type") == "purchase", F.col("props")).when(F.col("event_type") == "view", F.lit("")))
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("board")).agg(registry.first_by(F.col("name"), F.col("event_id")).alias("company_name"))


@query(
    """WITH r AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS key, page_id, url, 'crawl-' || (page_id % 3) AS source, printf('2026-07-%02d', 1 + (page_id * 7) % 28) AS day FROM pages)
    SELECT key, arg_min(url, page_id) AS board_url, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list(url ORDER BY page_id)[:3], ' ') AS samples, min(day) AS first_discovered_at,
    arg_min(page_id::VARCHAR, page_id) FILTER (page_id % 4 = 0) AS validation FROM r GROUP BY 1"""
)
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.table(spark, sf_dir, "pages")
    records = p.select(
        text.url_host(F.col("url")).alias("key"), F.lit("p").alias("provider"), F.col("url").alias("identifier"), F.lit("global").alias("region"), F.col("url").alias("board_url"), F.col("url").alias("api_url"),
        F.array(F.concat(F.lit("crawl-"), (F.col("page_id") % 3).cast("string"))).alias("discovery_sources"), F.array("url").alias("sample_urls"),
        F.format_string("2026-07-%02d", 1 + (F.col("page_id") * 7) % 28).alias("first_discovered_at"), F.when(F.col("page_id") % 4 == 0, F.col("page_id").cast("string")).alias("validation"), F.col("page_id").alias("ord"),
    )
    merged = registry.merge_registry(records)
    return merged.select("key", "board_url", F.array_join(F.array_sort("discovery_sources"), ",").alias("sources"), F.array_join("sample_urls", " ").alias("samples"), "first_discovered_at", "validation")


@query(
    """WITH t AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS turn, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS first FROM customer)
    SELECT c_custkey, c_mktsegment, turn::BIGINT AS turn FROM t ORDER BY turn, first LIMIT 47"""
)
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.round_robin(a.table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 47).select("c_custkey", "c_mktsegment", F.col("turn").cast("bigint").alias("turn"))


EVEN = ((3, 5), (101, 5), (0, 5), (100, 1), (1000, 7), (12, 0))
ROTATING = ((20, 5, 0), (20, 5, 1), (3, 5, 99), (1000, 7, 12345), (50, 1, 77), (10, 3, -4))
_page_list = "array_to_string(list_sort(list_distinct({0})), ',')"


def _joined(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: p.cast("string")), ",")


@query(
    f"""SELECT total, most, CASE WHEN total <= 0 OR most <= 0 THEN '' WHEN total <= most THEN array_to_string(range(total), ',') WHEN most = 1 THEN ((total - 1) // 2)::VARCHAR
    ELSE {_page_list.format("list_transform(range(most), lambda i: floor(i * (total - 1) / (most - 1) + 0.5)::BIGINT)")} END AS pages FROM {sql_values("v", "total, most", *EVEN)}"""
)
def page_sampling_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, "total int, most int", *EVEN).select("total", "most", _joined(registry.even_pages(F.col("total"), F.col("most"))).alias("pages"))


@query(
    f"""SELECT total, most, seed, CASE WHEN total <= most THEN array_to_string(range(total), ',') WHEN most = 1 THEN (((seed % total) + total) % total)::VARCHAR
    ELSE {_page_list.format("list_transform(range(most), lambda i: floor((((seed % total) + total) % total + i * (total / most)) % total)::BIGINT)")} END AS pages FROM {sql_values("v", "total, most, seed", *ROTATING)}"""
)
def page_sampling_rotating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, "total int, most int, seed int", *ROTATING).select("total", "most", "seed", _joined(registry.rotating_pages(F.col("total"), F.col("most"), F.col("seed"))).alias("pages"))


@query(
    """WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_id % 40)) AS seen FROM events WHERE event_type = 'view' GROUP BY 1), u AS (SELECT user_id, list_filter(range(40), lambda p: NOT list_contains(seen, p)) AS l FROM s)
    SELECT user_id, array_to_string(CASE WHEN len(l) <= 6 THEN l ELSE list_transform(list_sort(list_distinct(list_transform(range(6), lambda i: floor((user_id % len(l) + i * (len(l) / 6)) % len(l))::BIGINT))), lambda i: l[i + 1]) END, ',') AS pages FROM u"""
)
def page_sampling_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = a.table(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 40).alias("seen"))
    return seen.select("user_id", _joined(registry.unseen_pages(F.lit(40), F.lit(6), F.col("seen"), F.col("user_id"))).alias("pages"))


# Snapshots ------------------------------------------------------------------------------

STATE = [c for c in snapshots.JOB_FIELDS if c in ("source_id", "board_key", "title", "location")]
TINY = snapshots.Mode("key", True, ("key", "title", "location"))


def _state(spark: SparkSession, sf_dir: str, mode: snapshots.Mode = snapshots.LOCAL) -> DataFrame:
    old = snapshots.keep_first(a.postings(spark, sf_dir, False), "key", "ord")
    if mode.guarded:
        old = old.withColumn("fingerprint", snapshots.job_fingerprint(mode))
    return old.select(
        "key", *STATE, *(["fingerprint"] if mode.guarded else []), F.col("synced_at").alias("first_seen_at"), F.col("synced_at").alias("last_seen_at"),
        F.when(F.col("ord") % 5 == 0, F.col("synced_at")).alias("closed_at"), F.when(F.col("ord") % 5 == 0, 0).otherwise(1).alias("is_active"),
    )


def _fold(spark: SparkSession, sf_dir: str, mode: snapshots.Mode) -> DataFrame:
    new = snapshots.keep_first(a.postings(spark, sf_dir, True), "key", "ord")
    return snapshots.apply_snapshot(_state(spark, sf_dir, mode), new, a.results(spark, sf_dir), mode)


FOLD_SQL = f"""WITH {a.POSTINGS_SQL}, {a.RESULTS_SQL}, fine AS (SELECT key AS b, synced_at AS done_at FROM r WHERE status <> 'error'),
    s AS (SELECT *, ord % 5 > 0 AS open FROM old), n AS (SELECT new.* FROM new JOIN fine ON b = board_key),
    f AS (SELECT coalesce(s.key, n.key) AS key, s.key IS NOT NULL AS known, n.key IS NOT NULL AS came, coalesce(s.open, false) AS open, done_at IS NOT NULL AS fine, done_at,
        s.title AS t0, n.title AS t1, s.location AS l0, n.location AS l1, s.synced_at AS s0, n.synced_at AS s1
        FROM s FULL JOIN n ON s.key = n.key LEFT JOIN fine ON b = coalesce(s.board_key, n.board_key))"""


@query(
    f"""{FOLD_SQL} SELECT key, CASE WHEN came THEN t1 ELSE t0 END AS title, coalesce(s0, s1) AS first_seen_at, CASE WHEN came THEN s1 ELSE s0 END AS last_seen_at,
    CASE WHEN came THEN NULL WHEN known AND open AND fine THEN done_at WHEN known AND NOT open THEN s0 END AS closed_at, CASE WHEN came THEN 1 WHEN open AND fine THEN 0 WHEN open THEN 1 ELSE 0 END AS is_active FROM f"""
)
def snapshot_upsert_unconditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, snapshots.LOCAL).select("key", "title", "first_seen_at", "last_seen_at", "closed_at", "is_active")


@query(
    f"""{FOLD_SQL} SELECT key, CASE WHEN came AND NOT known THEN 'inserted' WHEN came AND NOT open THEN 'reopened' WHEN came AND (t0 IS DISTINCT FROM t1 OR l0 IS DISTINCT FROM l1) THEN 'updated'
    WHEN known AND open AND NOT came AND fine THEN 'closed' ELSE 'kept' END AS change, CASE WHEN came THEN 1 WHEN open AND fine THEN 0 WHEN open THEN 1 ELSE 0 END AS is_active FROM f"""
)
def snapshot_upsert_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, TINY).select("key", "change", "is_active")


@query(f"{FOLD_SQL} SELECT key, done_at AS closed_at FROM f WHERE known AND open AND NOT came AND fine")
def close_by_absence_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, snapshots.LOCAL).where("change = 'closed'").select("key", "closed_at")


@query(
    f"""WITH {a.POSTINGS_SQL}, {a.RESULTS_SQL} SELECT old.key FROM old JOIN r ON r.key = old.board_key AND status <> 'error'
    WHERE ord % 5 > 0 AND NOT EXISTS (SELECT 1 FROM new WHERE new.board_key = old.board_key AND new.source_id = old.source_id)"""
)
def close_by_absence_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = snapshots.Mode("source_id", True, ("key", "title", "location"))
    return _fold(spark, sf_dir, mode).where("change = 'closed'").select("key")


@query(
    f"""WITH {a.POSTINGS_SQL}, {a.RESULTS_SQL} SELECT old.key, title, CASE WHEN ord % 5 > 0 THEN 1 ELSE 0 END AS is_active FROM old JOIN r ON r.key = old.board_key WHERE status = 'error'"""
)
def error_snapshot_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = a.results(spark, sf_dir).where("status = 'error'").select(F.col("key").alias("board_key"))
    return _fold(spark, sf_dir, snapshots.LOCAL).join(failed, "board_key", "left_semi").select("key", "title", "is_active")


@query(
    f"""WITH {a.RESULTS_SQL} SELECT r.key, r.status, r.job_count, coalesce(o.at, r.synced_at) AS first_seen_at, r.synced_at AS last_synced_at, CASE WHEN r.status = 'error' THEN o.at ELSE r.synced_at END AS last_success_at, r.error
    FROM r LEFT JOIN (SELECT 'u' || user_id AS key, '2024-01-01' AS at FROM events WHERE user_id % 2 = 0 GROUP BY 1) o ON o.key = r.key"""
)
def board_upsert_last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = a.results(spark, sf_dir)
    even = r.where(F.substring(F.col("key"), F.lit(2), F.length("key")).cast("int") % 2 == 0)
    old = even.select("key", "provider", F.col("key").alias("identifier"), F.lit("active").alias("status"), F.lit(1).cast("bigint").alias("job_count"), *[F.lit("2024-01-01").alias(c) for c in ("first_seen_at", "last_synced_at", "last_success_at")], F.lit(None).cast("string").alias("error"))
    after = snapshots.apply_boards(old, r.withColumn("identifier", F.col("key")).withColumn("ord", F.lit(0)))
    return after.select("key", "status", "job_count", "first_seen_at", "last_synced_at", "last_success_at", "error")


@query(
    f"""WITH {a.COMPANIES_SQL}, n AS (SELECT 'n' || (n_nationkey + 5) AS key, CASE WHEN n_nationkey % 2 = 1 THEN 'New ' || n_nationkey END AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'logo' || n_nationkey END AS logo_url, 'fall' || n_nationkey AS fallback FROM nation)
    SELECT coalesce(c.key, n.key) AS key, CASE WHEN c.key IS NOT NULL THEN coalesce(n.name, c.name) ELSE coalesce(n.name, n.fallback) END AS name, coalesce(n.logo_url, c.logo_url) AS logo_url FROM companies c FULL JOIN n ON c.key = n.key"""
)
def company_upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    new = a.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), (k + 5).cast("string")).alias("key"), F.when(k % 2 == 1, F.concat(F.lit("New "), k.cast("string"))).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("logo"), k.cast("string"))).alias("logo_url"), F.lit(None).cast("string").alias("logo_checked_at"), F.concat(F.lit("fall"), k.cast("string")).alias("fallback"),
    )
    return snapshots.upsert_companies(a.companies(spark, sf_dir), new).select("key", "name", "logo_url")


@query(
    f"""WITH {a.BOARDS_SQL}, f AS (SELECT 'c' || (c_custkey + 700) AS key, 'https://b/' || c_custkey AS board_url FROM customer)
    SELECT coalesce(b.key, f.key) AS key, coalesce(f.board_url, 'https://old') AS board_url, coalesce(b.status, 'new') AS status, coalesce(b.queue_state, 'idle') AS queue_state, coalesce(b.next_sync_at, '{NOW}') AS next_sync_at FROM boards b FULL JOIN f ON b.key = f.key"""
)
def discovered_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = a.boards(spark, sf_dir).withColumn("region", F.lit("global")).withColumn("board_url", F.lit("https://old")).withColumn("api_url", F.lit("https://old"))
    k = F.col("c_custkey")
    found = a.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), (k + 700).cast("string")).alias("key"), F.lit("p").alias("provider"), F.lit("i").alias("identifier"), F.lit(None).cast("string").alias("region"),
        F.concat(F.lit("https://b/"), k.cast("string")).alias("board_url"), F.lit("https://api").alias("api_url"), k.alias("ord"),
    )
    return snapshots.upsert_discovered(old, found, NOW).select("key", "board_url", "status", "queue_state", "next_sync_at")


@query(
    f"""WITH {a.RESULTS_SQL}, s AS (SELECT 'p' || i AS provider, i AS n FROM range(5) t(i)), d AS (SELECT provider, count(*) FILTER (status <> 'error') AS ok, count(*) FILTER (status = 'error') AS bad, coalesce(sum(delta) FILTER (status <> 'error'), 0) AS delta,
    max(synced_at) FILTER (status = 'error') AS bad_at FROM r GROUP BY 1)
    SELECT coalesce(s.provider, d.provider) AS provider, (coalesce(n, 0) + coalesce(ok, 0))::BIGINT AS successful_runs, coalesce(bad, 0)::BIGINT AS failed_runs, greatest(0, coalesce(n, 0) + coalesce(delta, 0))::BIGINT AS active_jobs, bad_at AS last_failure_at FROM s FULL JOIN d ON s.provider = d.provider"""
)
def provider_health_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = spark.range(5).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("provider"), F.col("id").alias("successful_runs"), F.lit(0).cast("bigint").alias("failed_runs"), F.col("id").alias("active_jobs"),
        F.lit(None).cast("string").alias("last_success_at"), F.lit(None).cast("string").alias("last_failure_at"),
    )
    return snapshots.provider_health(state, a.results(spark, sf_dir)).select("provider", "successful_runs", "failed_runs", F.col("active_jobs").cast("bigint").alias("active_jobs"), "last_failure_at")


@query(
    f"""WITH {a.RESULTS_SQL}, t AS (SELECT key, status, CASE WHEN status = 'error' THEN substr(key, 2)::INT % 8 + 1 ELSE 0 END AS failure_count, strptime(synced_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS done_at FROM r)
    SELECT key, status, failure_count, strftime(done_at + to_minutes(CASE status WHEN 'active' THEN 720 WHEN 'empty' THEN 5760 WHEN 'invalid' THEN 43200 ELSE least(1440, 15 * 2 ** failure_count)::INT END), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS next_sync_at FROM t"""
)
def board_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = a.results(spark, sf_dir)
    state = r.select("key", F.lit("new").alias("status"), F.lit("queued").alias("queue_state"), F.lit(0).cast("bigint").alias("job_count"), (F.substring(F.col("key"), F.lit(2), F.length("key")).cast("int") % 8).alias("failure_count"), *[F.lit(None).cast("string").alias(c) for c in ("last_synced_at", "next_sync_at", "last_error")])
    return snapshots.schedule_boards(state, r).select("key", "status", "failure_count", "next_sync_at")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS synced_at FROM events")
def run_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = a.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("synced_at"))
    return snapshots.append_run(days.where("synced_at < '2024-01-10'").distinct(), days)
