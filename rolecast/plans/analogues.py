"""The generic test tables seen as postings, boards and snapshots, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.functions.text import ISO


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings of boards (customers) that belong to companies (nations)."""
    o, c, n, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "part"))
    titled = o.withColumn("__p", F.col("o_orderkey") % 200).join(p.select(F.col("p_partkey").alias("__p"), "p_name", "p_brand"), "__p")
    joined = titled.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    when = lambda cond, value: F.when(cond, value)
    return joined.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("board_key"),
        F.lower("c_mktsegment").alias("provider"),
        F.lower("c_name").alias("company_identifier"),
        when(F.col("c_custkey") % 3 > 0, F.col("n_name")).alias("company_name"),
        when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("https://logo/"), F.col("o_orderkey").cast("string"))).alias("company_logo_url"),
        F.col("p_name").alias("title"),
        when(F.col("o_orderkey") % 11 > 0, F.concat("n_name", F.lit(" / "), "p_brand")).alias("location"),
        when(F.col("c_nationkey") % 5 > 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("country"),
        F.col("n_name").alias("city"),
        F.col("p_brand").alias("role_family"),
        F.col("c_mktsegment").alias("company_industry"),
        F.when(F.col("o_orderstatus") == "F", "Remote").when(F.col("o_orderstatus") == "O", "On-site").otherwise("Hybrid").alias("workplace"),
        F.col("o_orderpriority").alias("category"),
        when(F.col("o_orderkey") % 2 == 0, F.lit("Full-Time")).alias("employment_type"),
        when(F.col("o_orderkey") % 13 == 0, F.lit("Red Team")).alias("department"),
        F.lit(None).cast("string").alias("description_plain"),
        when(F.col("o_orderkey") % 17 > 0, F.date_format("o_orderdate", ISO)).alias("published_at"),
        F.concat(F.lit("https://jobs/"), F.col("o_orderkey").cast("string")).alias("url"),
        when(F.col("o_orderkey") % 10 > 0, F.lit(1)).otherwise(0).alias("is_active"),
    )


JOBS_SQL = """jobs AS (
    SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS key, 'c' || o_custkey AS board_key, lower(c_mktsegment) AS provider,
        lower(c_name) AS company_identifier, CASE WHEN c_custkey % 3 > 0 THEN n_name END AS company_name,
        CASE WHEN o_orderkey % 7 = 0 THEN 'https://logo/' || o_orderkey END AS company_logo_url, p_name AS title,
        CASE WHEN o_orderkey % 11 > 0 THEN n_name || ' / ' || p_brand END AS location,
        CASE WHEN c_nationkey % 5 > 0 THEN 'n' || c_nationkey END AS country, n_name AS city, p_brand AS role_family,
        c_mktsegment AS company_industry,
        CASE o_orderstatus WHEN 'F' THEN 'Remote' WHEN 'O' THEN 'On-site' ELSE 'Hybrid' END AS workplace,
        o_orderpriority AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'Full-Time' END AS employment_type,
        CASE WHEN o_orderkey % 13 = 0 THEN 'Red Team' END AS department,
        CASE WHEN o_orderkey % 17 > 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS published_at,
        'https://jobs/' || o_orderkey AS url, CASE WHEN o_orderkey % 10 > 0 THEN 1 ELSE 0 END AS is_active
    FROM orders JOIN part ON p_partkey = o_orderkey % 200
        LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
)"""


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as boards with a sync state."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    # days since 2026-07-01, as ISO texts
    day = lambda n: F.date_format(F.to_timestamp(F.lit("2026-07-01")) + F.make_dt_interval(n.cast("int"), (k % 24).cast("int")), ISO)
    status = F.when(k % 6 == 0, "error").when(k % 6 == 1, "empty").when(k % 6 == 2, "invalid").otherwise("active")
    return c.select(
        F.concat(F.lit("c"), k.cast("string")).alias("key"),
        F.lower("c_mktsegment").alias("provider"),
        F.lower("c_name").alias("identifier"),
        status.alias("status"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("company_key"),
        F.when(k % 4 == 0, "queued").otherwise("idle").alias("queue_state"),
        (k % 50).cast("bigint").alias("job_count"),
        (k % 5).cast("int").alias("failure_count"),
        F.when(k % 9 > 0, day(k % 20)).alias("last_synced_at"),
        day(k % 40).alias("next_sync_at"),
        day(k % 21).alias("updated_at"),
    )


BOARDS_SQL = """boards AS (
    SELECT 'c' || c_custkey AS key, lower(c_mktsegment) AS provider, lower(c_name) AS identifier,
        CASE c_custkey % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'empty' WHEN 2 THEN 'invalid' ELSE 'active' END AS status,
        'n' || c_nationkey AS company_key, CASE WHEN c_custkey % 4 = 0 THEN 'queued' ELSE 'idle' END AS queue_state,
        c_custkey % 50 AS job_count, (c_custkey % 5)::INT AS failure_count,
        CASE WHEN c_custkey % 9 > 0 THEN strftime(TIMESTAMP '2026-07-01' + to_days((c_custkey % 20)::INT) + to_hours(c_custkey % 24), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS last_synced_at,
        strftime(TIMESTAMP '2026-07-01' + to_days((c_custkey % 40)::INT) + to_hours(c_custkey % 24), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS next_sync_at,
        strftime(TIMESTAMP '2026-07-01' + to_days((c_custkey % 21)::INT) + to_hours(c_custkey % 24), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS updated_at
    FROM customer
)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("https://nation/"), F.col("n_nationkey").cast("string"))).alias("logo_url"),
        F.when(F.col("n_nationkey") % 3 == 0, F.lit("2026-07-10T00:00:00.000Z")).alias("logo_checked_at"),
    )


COMPANIES_SQL = """companies AS (
    SELECT 'n' || n_nationkey AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'https://nation/' || n_nationkey END AS logo_url,
        CASE WHEN n_nationkey % 3 = 0 THEN '2026-07-10T00:00:00.000Z' END AS logo_checked_at
    FROM nation
)"""


def postings(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """Events as a snapshot of postings: those before, or from, the middle of the month; a posting is a user's kind of value."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    half = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    e = e.where(half if late else ~half)
    return e.select(
        F.concat_ws(":", F.lit("u") , F.col("user_id").cast("string"), (F.col("event_id") % 40).cast("string")).alias("key"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("board_key"),
        (F.col("event_id") % 40).cast("string").alias("source_id"),
        F.col("event_type").alias("title"),
        F.col("props").alias("location"),
        F.date_format("ts", ISO).alias("synced_at"),
        F.col("event_id").alias("ord"),
    )


POSTINGS_SQL = """p AS (
    SELECT 'u:' || user_id || ':' || (event_id % 40) AS key, 'u' || user_id AS board_key, (event_id % 40)::VARCHAR AS source_id,
        event_type AS title, props AS location, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS synced_at, event_id AS ord,
        ts >= TIMESTAMP '2024-01-16' AS late
    FROM events WHERE event_type <> 'error'
), old AS (SELECT * FROM p WHERE NOT late QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1),
new AS (SELECT * FROM p WHERE late QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event from the middle of the month on as the result of a sync."""
    from rolecast.operators.snapshots import keep_first

    e = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-16'")
    last = keep_first(e, "user_id", F.desc("event_id"))
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "invalid").when(F.col("event_type") == "view", "empty").otherwise("active")
    return last.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("provider"),
        status.alias("status"),
        (F.col("event_id") % 30).alias("job_count"),
        F.date_format("ts", ISO).alias("synced_at"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        ((F.col("event_id") % 9) - 4).alias("delta"),
    )


RESULTS_SQL = """r AS (
    SELECT 'u' || user_id AS key, 'p' || (user_id % 7) AS provider,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'invalid' WHEN 'view' THEN 'empty' ELSE 'active' END AS status,
        event_id % 30 AS job_count, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS synced_at,
        CASE WHEN event_type = 'error' THEN props END AS error, (event_id % 9) - 4 AS delta
    FROM events WHERE ts >= TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
)"""
