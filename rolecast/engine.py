"""The engine over stored state: what a caller can ask for, in one place.

State lies under a path as versions of Parquet tables (jobs, boards, companies, runs, failures,
health). Reads are lazy DataFrames; a write folds tables and commits them together.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.operators import ops, schedule, snapshots
from rolecast.plans import jobs as j
from rolecast.sources.state import Store

TEXT = lambda *names: ", ".join(f"{n} string" for n in names)
SCHEMAS = {
    "jobs": TEXT("key", *snapshots.JOB_FIELDS, "first_seen_at", "last_seen_at", "closed_at", "fingerprint") + ", is_active int",
    "boards": TEXT("key", "provider", "identifier", "region", "board_url", "api_url", "company_key", "status", "queue_state", "last_synced_at", "next_sync_at", "last_error", "updated_at") + ", job_count bigint, failure_count int",
    "companies": TEXT("key", "name", "logo_url", "logo_checked_at"),
    "runs": TEXT("key", "board_key", "provider", "status", "synced_at", "started_at") + ", job_count bigint",
    "failures": TEXT("id", "task_type", "provider", "board_key", "payload", "error", "created_at", "resolved_at") + ", attempts bigint",
    "health": "provider string, successful_runs bigint, failed_runs bigint, active_jobs bigint, last_success_at string, last_failure_at string",
    "titles": "title string, job_count bigint",
}
MODES = {"local": snapshots.LOCAL, "production": snapshots.PRODUCTION, "http": snapshots.HTTP}


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path, Store(spark, path)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, SCHEMAS[name])

    def save(self, **tables: DataFrame) -> None:
        """All of the tables change, or none."""
        self.store.commit(**tables)

    # Reads

    def query_jobs(self, q: j.JobQuery, mode: str = "offset") -> tuple[DataFrame, DataFrame]:
        """A page of public postings, with their companies' logos, and the total."""
        rows = j.page(self.table("jobs"), q, mode)
        shown = j.with_logos(rows, self.table("boards"), self.table("companies"))
        return j.public_jobs(shown), j.total(self.table("jobs"), q)

    def suggest_titles(self, query: str, limit: int = 8) -> DataFrame:
        return j.suggest_titles(j.title_counts(self.table("jobs")), query, limit)

    def stats(self) -> DataFrame:
        return j.stats(self.table("jobs"), self.table("boards"), self.table("runs"))

    def health(self, now: str) -> DataFrame:
        return ops.health_row(self.table("jobs"), self.table("boards"), self.table("failures"), now)

    def failures(self, limit: int = 200) -> DataFrame:
        return ops.unresolved(self.table("failures"), limit)

    # Writes

    def upsert_discovered(self, found: DataFrame, now: str) -> None:
        """Boards (key, provider, identifier, region, board_url, api_url, ord) that discovery found."""
        old = self.table("boards")
        after = snapshots.upsert_discovered(old, found, now)
        kept = old.select("key", *[c for c in old.columns if c not in after.columns])
        self.save(boards=after.join(kept, "key", "left").select(*old.columns))

    def schedule_due(self, now: str, limit: int = 500, provider: str | None = None) -> list[dict]:
        """Claims the boards that are due and returns them, at most 2000."""
        boards = ops.reclaim_stuck(self.table("boards"), now)
        due = ops.due_boards(boards, now, limit, provider).select("key", "provider", "identifier", "region", "board_url", "api_url").checkpoint()
        self.save(boards=ops.claim(boards, due, now).select(*self.table("boards").columns))
        return [r.asDict() for r in due.orderBy("key").collect()]

    def apply_snapshot(self, jobs: DataFrame, results: DataFrame, mode: str = "production") -> dict[str, int]:
        """Folds postings (JOB_FIELDS, key, synced_at, ord) and results (key, provider, identifier, status, job_count, synced_at, error); returns the number of changes by kind."""
        how, old = MODES[mode], self.table("jobs")
        new = snapshots.stage_jobs(jobs)
        folded = snapshots.apply_snapshot(old, new, results, how).checkpoint()
        counts = {r.change: r["count"] for r in folded.groupBy("change").count().collect()}
        boards = self.table("boards")
        companies = results.where("status <> 'error'").select(F.concat(F.lit("company:"), "key").alias("key"), F.col("key").alias("board_key"), F.col("identifier").alias("fallback"), F.col("synced_at").alias("logo_checked_at"))
        told = jobs.groupBy("board_key").agg(*[F.min_by(c, F.when(F.col(c) != "", F.col("ord"))).alias(n) for c, n in (("company_name", "name"), ("company_logo_url", "logo_url"))])
        active = old.where("is_active = 1").groupBy("board_key").agg(F.count("*").alias("before"))
        sent = jobs.groupBy("board_key").agg(F.count("*").alias("sent"))
        deltas = results.join(active, results["key"] == active["board_key"], "left").drop("board_key").join(sent, F.col("key") == sent["board_key"], "left")
        deltas = deltas.withColumn("delta", F.coalesce("sent", F.lit(0)) - F.coalesce("before", F.lit(0)))
        columns = self.table("jobs").columns
        after = {
            "jobs": folded.withColumns({c: F.lit(None).cast("string") for c in columns if c not in folded.columns}).select(*columns),
            "boards": snapshots.schedule_boards(boards, results, how).withColumn("company_key", F.coalesce("company_key", F.concat(F.lit("company:"), "key"))).select(*boards.columns),
            "companies": snapshots.upsert_companies(self.table("companies"), companies.join(told, "board_key", "left")),
            "runs": self.table("runs").unionByName(results.select(F.sha2(F.concat_ws("|", "key", "synced_at"), 256).alias("key"), F.col("key").alias("board_key"), "provider", "status", "synced_at", F.col("synced_at").alias("started_at"), F.col("job_count").cast("bigint").alias("job_count"))),
            "health": snapshots.provider_health(self.table("health"), deltas).select(*self.table("health").columns),
            "failures": ops.resolve_failures(self.table("failures"), results.where("status <> 'error'"), str(results.agg(F.max("synced_at")).first()[0])).select(*self.table("failures").columns),
        }
        self.save(**after)
        return counts

    def record_dead_letters(self, tasks: DataFrame, now: str) -> None:
        self.save(failures=self.table("failures").unionByName(ops.dead_letters(tasks, now).withColumn("attempts", F.col("attempts").cast("bigint"))))

    def run_maintenance(self, now: str) -> None:
        """Archive, retention, title counts, health and failures, once a day.

        Only postings that are in the archive leave the state. A crash in between leaves them
        in both, and they are archived again.
        """
        failures = self.table("failures")
        archived = ops.archive_rows(self.table("jobs"), now).checkpoint()
        ops.write_archive(archived, f"{self.path}/archive")
        out = schedule.maintenance(self.table("jobs"), self.table("runs"), failures.withColumn("key", F.col("id")), self.table("boards"), self.table("health"), now, archived)
        self.save(**{name: frame.select(*self.table(name).columns) for name, frame in out.items()})
