"""Operations: due work, claims, failures, retention, archive, health and the report."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.functions.text import parse_date


def sql_time(now: str, **ago: int) -> Column:
    """A time before now, written as a database's datetime text. ISO texts of the same day sort after it."""
    interval = " ".join(f"{n} {unit}" for unit, n in ago.items())
    return F.date_format(F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {interval}"), "yyyy-MM-dd HH:mm:ss")


def before(column: str, now: str, strict_time: bool = False, **ago: int) -> Column:
    """Whether an ISO text lies before a time. By default texts are compared, so the bound's whole day does not; strict_time compares times."""
    if strict_time:
        interval = " ".join(f"{n} {unit}" for unit, n in ago.items())
        return parse_date(F.col(column)) < F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {interval}")
    return F.col(column) < sql_time(now, **ago)


def reclaim_stuck(boards: DataFrame, now: str, strict_time: bool = False) -> DataFrame:
    """Boards queued for over two hours are idle again."""
    stuck = (F.col("queue_state") == "queued") & before("updated_at", now, strict_time, hours=2)
    return boards.withColumns({"queue_state": F.when(stuck, "idle").otherwise(F.col("queue_state")), "updated_at": F.when(stuck, F.lit(now)).otherwise(F.col("updated_at"))})


def due_boards(boards: DataFrame, now: str, limit: int = 500, provider: str | None = None) -> DataFrame:
    """Idle boards whose time has come, the longest due first; the provider's are picked from these."""
    found = boards.where((F.col("queue_state") == "idle") & (F.col("next_sync_at") <= F.lit(now))).orderBy("next_sync_at", "key").limit(min(2000, max(1, limit)))
    return found.where(F.col("provider") == provider) if provider else found


def claim(boards: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """Boards of keys that are idle become queued."""
    picked = boards.join(keys.select("key").distinct().withColumn("__picked", F.lit(True)), "key", "left")
    mine = F.coalesce("__picked", F.lit(False)) & (F.col("queue_state") == "idle")
    return picked.withColumns({"updated_at": F.when(mine, F.lit(now)).otherwise(F.col("updated_at")), "queue_state": F.when(mine, "queued").otherwise(F.col("queue_state"))}).drop("__picked")


def release(boards: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """Boards of keys become idle, whatever they are."""
    picked = boards.join(keys.select("key").distinct().withColumn("__picked", F.lit(True)), "key", "left")
    mine = F.coalesce("__picked", F.lit(False))
    return picked.withColumns({"queue_state": F.when(mine, "idle").otherwise(F.col("queue_state")), "updated_at": F.when(mine, F.lit(now)).otherwise(F.col("updated_at"))}).drop("__picked")


def adaptively_due(boards: DataFrame, states: DataFrame, now: str) -> DataFrame:
    """Boards to sync: unknown and never synced ones, invalid ones after a week, empty ones after a day, others always."""
    joined = boards.join(states.select(F.col("key").alias("__k"), F.col("status").alias("__s"), F.col("last_synced_at").alias("__at")), F.col("key") == F.col("__k"), "left")
    hours = (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(parse_date(F.col("__at")))) / 3600
    due = F.when(hours.isNull(), True).when(F.col("__s") == "invalid", hours >= 168).when(F.col("__s") == "empty", hours >= 24).otherwise(True)
    return joined.where(due).drop("__k", "__s", "__at")


def batches(frame: DataFrame, size: int, *order: Column | str, group: str | None = None) -> DataFrame:
    """frame with batch: consecutive rows, `size` at a time, within each group."""
    window = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(*order)
    return frame.withColumn("batch", F.floor((F.row_number().over(window) - 1) / size).cast("bigint"))


def dead_letters(tasks: DataFrame, now: str) -> DataFrame:
    """Failed tasks (type, provider, board_key, payload, error, attempts) as rows of the failure table."""
    return tasks.select(
        F.sha2(F.concat_ws("\x1f", F.coalesce("board_key", F.lit("")), "payload", F.lit(now)), 256).alias("id"),
        F.coalesce("type", F.lit("unknown")).alias("task_type"), "provider", "board_key", "payload", "error", "attempts",
        F.lit(now).alias("created_at"), F.lit(None).cast("string").alias("resolved_at"),
    )


def unresolved(failures: DataFrame, limit: int = 200) -> DataFrame:
    return failures.where("resolved_at is null").orderBy(F.desc("created_at"), "id").limit(limit)


def resolve_failures(failures: DataFrame, boards: DataFrame, now: str) -> DataFrame:
    """Open failures of boards that are no longer in error are resolved."""
    fine = boards.where("status <> 'error'").select(F.col("key").alias("__k")).distinct()
    joined = failures.join(fine, F.col("board_key") == F.col("__k"), "left")
    return joined.withColumn("resolved_at", F.when(F.col("resolved_at").isNull() & F.col("__k").isNotNull(), F.lit(now)).otherwise(F.col("resolved_at"))).drop("__k")


def prune(frame: DataFrame, column: str, now: str, days: int, most: int | None = None, also: Column | None = None, strict_time: bool = False) -> DataFrame:
    """frame without the rows whose column lies over `days` days back; of these the oldest `most` go at a time."""
    old = before(column, now, strict_time, days=days)
    old = F.coalesce(old if also is None else old & also, F.lit(False))
    if most is None:
        return frame.where(~old)
    gone = frame.where(old).orderBy(column, "key").limit(most).select(F.col("key").alias("__k"))
    return frame.join(gone, F.col("key").eqNullSafe(F.col("__k")), "left_anti")


def archive_rows(jobs: DataFrame, now: str, days: int = 30, most: int = 5000) -> DataFrame:
    """Closed postings to archive: those closed over `days` days ago, the oldest `most` of them, with the day of the archive."""
    old = (F.col("is_active") == 0) & before("closed_at", now, days=days)
    return jobs.where(old).orderBy("closed_at", "key").limit(most).withColumn("day", F.lit(now[:10]))


def write_archive(rows: DataFrame, path: str) -> None:
    """Appends rows as gzip NDJSON below a folder for the day."""
    rows.write.mode("append").partitionBy("day").option("compression", "gzip").json(path)


def archive(jobs: DataFrame, path: str, now: str) -> DataFrame:
    """Writes the rows to archive, and returns the rows that stay."""
    rows = archive_rows(jobs, now)
    write_archive(rows, path)
    return jobs.join(rows.select("key"), "key", "left_anti")


def reconcile_health(health: DataFrame, jobs: DataFrame) -> DataFrame:
    """Health with the true counts of active postings; providers without any keep their number."""
    counts = jobs.where("is_active = 1").groupBy("provider").agg(F.count("*").alias("__n"))
    return health.join(counts, "provider", "left").withColumn("active_jobs", F.coalesce("__n", "active_jobs")).drop("__n")


def health_row(jobs: DataFrame, boards: DataFrame, failures: DataFrame, now: str) -> DataFrame:
    """One row: active_jobs, boards, due_boards, unresolved_failures. Due times are compared as texts."""
    j = jobs.agg(F.count_if(F.col("is_active") == 1).alias("active_jobs"))
    due = F.col("next_sync_at") <= F.date_format(F.to_timestamp(F.lit(now)), "yyyy-MM-dd HH:mm:ss")
    b = boards.agg(F.count("*").alias("boards"), F.count_if(due).alias("due_boards"))
    return j.join(b).join(failures.agg(F.count_if(F.col("resolved_at").isNull()).alias("unresolved_failures")))


def stale_logos(results: DataFrame, companies: DataFrame, now: str) -> DataFrame:
    """Boards whose page should be asked for a logo: synced without error, no logo in the postings or known, not asked for 30 days."""
    joined = results.join(companies.select(F.col("key").alias("company_key"), "logo_url", "logo_checked_at"), "company_key", "left")
    asked = parse_date(F.col("logo_checked_at")) > F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 30 DAYS")
    return joined.where((F.col("status") != "error") & ~F.col("has_logo") & F.col("logo_url").isNull() & ~F.coalesce(asked, F.lit(False))).drop("logo_url", "logo_checked_at")


def status_counts(boards: DataFrame) -> DataFrame:
    return boards.groupBy(F.coalesce("status", F.lit("unvalidated")).alias("status")).agg(F.count("*").alias("boards"))


def report_by_provider(boards: DataFrame) -> DataFrame:
    return boards.groupBy("provider").agg(
        F.count("*").alias("boards"), F.count_if(F.col("status") == "active").alias("active"), F.coalesce(F.sum("job_count"), F.lit(0)).alias("jobs")
    )


def report(boards: DataFrame, title: str = "Board report") -> str:
    """A Markdown report; only the two aggregates come to the driver."""
    states = {r.status: r.boards for r in status_counts(boards).collect()}
    rows = sorted(report_by_provider(boards).collect(), key=lambda r: r.provider or "")
    lines = [f"# {title}", "", f"- Boards: {sum(states.values())}", f"- Jobs: {sum(r.jobs for r in rows)}", *(f"- {k}: {v}" for k, v in sorted(states.items()))]
    lines += ["", "| Provider | Boards | Active | Jobs |", "| --- | ---: | ---: | ---: |"]
    return "\n".join([*lines, *(f"| {r.provider} | {r.boards} | {r.active} | {r.jobs} |" for r in rows), ""])
