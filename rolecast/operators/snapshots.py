"""Snapshots folded into current state, as functions from DataFrames to DataFrames.

No stored table is changed in place: a fold reads the state and the snapshot and returns the
new state, which the caller writes beside the old one and swaps in.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.functions.text import fingerprint, next_sync

JOB_FIELDS = [
    "source_id", "board_key", "provider", "company_identifier", "company_name", "company_logo_url", "title", "location", "country", "city",
    "role_family", "company_industry", "workplace", "employment_type", "department", "category", "description_plain", "published_at", "url",
    "apply_url", "compensation_json",
]
#: What makes a posting another one. Dates are left out: some providers only give relative ones, which drift.
FINGERPRINT_FIELDS = [
    "key", "source_id", "board_key", "provider", "company_identifier", "company_name", "company_logo_url", "title", "location", "country",
    "city", "role_family", "company_industry", "workplace", "employment_type", "category", "url",
]
#: The HTTP sink's own list: with the date, without the derived columns.
HTTP_FINGERPRINT_FIELDS = [
    "key", "source_id", "board_key", "provider", "company_identifier", "company_name", "company_logo_url", "title", "location", "workplace",
    "employment_type", "category", "published_at", "url",
]


@dataclass(frozen=True)
class Mode:
    """How a snapshot is applied: which key tells that a posting is gone, whether equal postings are rewritten, what a board's next sync is."""

    absent_by: str = "key"
    guarded: bool = False
    fingerprint_fields: tuple[str, ...] = ()
    next_sync: str | None = None


LOCAL = Mode()
PRODUCTION = Mode("source_id", True, tuple(FINGERPRINT_FIELDS), "rule")
HTTP = Mode("source_id", True, tuple(HTTP_FINGERPRINT_FIELDS), "now")


def keep_first(frame: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """One row for each key: the first in the order."""
    keys = [key] if isinstance(key, str) else key
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def canonical_keys(jobs: DataFrame) -> DataFrame:
    """Workday site names are the same in any case: their keys are lowered."""
    lower = F.when(F.col("provider") == "workday", F.lower("board_key")).otherwise(F.col("board_key"))
    key = F.when(F.col("provider") == "workday", F.concat(F.lower("board_key"), F.lit(":"), F.col("source_id"))).otherwise(F.col("key"))
    return jobs.withColumn("key", key).withColumn("board_key", lower)


def collapse_case_variants(jobs: DataFrame, order: str) -> DataFrame:
    """Of stored Workday rows that differ in case only, the first stays, under its lowered key."""
    old = jobs.where("provider = 'workday'")
    rest = jobs.where("provider is null or provider <> 'workday'")
    kept = keep_first(old.withColumn("__b", F.lower("board_key")), ["__b", "source_id"], order).drop("__b")
    return rest.unionByName(canonical_keys(kept))


def stage_jobs(jobs: DataFrame, order: str = "ord") -> DataFrame:
    """Incoming postings with their defaults, keys made canonical, the first row of each key; null keys are rejected."""
    staged = canonical_keys(jobs).where("key is not null")
    staged = staged.withColumn("workplace", F.coalesce("workplace", F.lit("Unspecified"))).withColumn("category", F.coalesce("category", F.lit("Other")))
    staged = staged.withColumn("apply_url", F.coalesce("apply_url", "url"))
    return keep_first(staged, "key", order)


def job_fingerprint(mode: Mode = PRODUCTION) -> Column:
    return fingerprint(*[F.col(c) for c in mode.fingerprint_fields])


def apply_jobs(state: DataFrame, incoming: DataFrame, boards: DataFrame, mode: Mode = LOCAL) -> DataFrame:
    """The postings after a snapshot.

    state: key, JOB_FIELDS, first_seen_at, last_seen_at, closed_at, is_active, and
    fingerprint where the mode is guarded. incoming: staged postings with synced_at.
    boards: key, status, synced_at of the snapshot; a failed board ('error') closes and
    changes nothing, an invalid one closes all its postings. One full outer join: a posting
    is written if it came, closed if its board came without it, and kept otherwise. A column
    `change` tells inserted, updated, reopened, closed or kept.
    """
    fine = boards.where("status <> 'error'").select(F.col("key").alias("__board"), F.col("synced_at").alias("__at"))
    new = incoming.join(fine.select("__board"), F.col("board_key") == F.col("__board"), "left_semi")
    if mode.guarded:
        new = new.withColumn("fingerprint", job_fingerprint(mode))
    fields = [c for c in state.columns if c in JOB_FIELDS or c == "fingerprint"]
    old = state.alias("o")
    both = old.join(new.select("key", "synced_at", *[c for c in fields if c in new.columns]).alias("n"), F.col("o.key") == F.col("n.key"), "full_outer")
    came, known = F.col("n.key").isNotNull(), F.col("o.key").isNotNull()
    both = both.join(fine, F.coalesce(F.col("o.board_key"), F.col("n.board_key")) == F.col("__board"), "left")
    active = F.coalesce(F.col("o.is_active") == 1, F.lit(False))
    same = F.lit(False)
    if mode.guarded:
        same = known & active & F.col("o.fingerprint").eqNullSafe(F.col("n.fingerprint"))
    write = came & ~same
    absent = known & active & ~came & F.col("__board").isNotNull()
    change = F.when(came & ~known, "inserted").when(write & ~active, "reopened").when(write, "updated").when(absent, "closed").otherwise("kept")
    pick = lambda c: F.when(write, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    out = [F.coalesce("o.key", "n.key").alias("key"), *[pick(c).alias(c) for c in fields]]
    seen = write if mode.guarded else came
    out += [
        F.coalesce("o.first_seen_at", "n.synced_at").alias("first_seen_at"),
        F.when(seen, F.col("n.synced_at")).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(write, F.lit(None).cast("string")).when(absent, F.coalesce("o.closed_at", "__at")).otherwise(F.col("o.closed_at")).alias("closed_at"),
        F.when(came, 1).when(absent, 0).otherwise(F.col("o.is_active")).cast("int").alias("is_active"),
        change.alias("change"),
    ]
    return both.select(*out)


def apply_snapshot(state: DataFrame, incoming: DataFrame, boards: DataFrame, mode: Mode = PRODUCTION) -> DataFrame:
    """apply_jobs, with absence told as the mode tells it: by key, or by the source ids that came from the board."""
    folded = apply_jobs(state, incoming, boards, mode)
    if mode.absent_by == "key":
        return folded
    # a posting whose key changed but whose source id came stays open
    came = incoming.select("board_key", "source_id").distinct()
    kept = folded.where("change = 'closed'").join(came, ["board_key", "source_id"], "left_semi").select(F.col("key").alias("__k"))
    joined = folded.join(kept, F.col("key") == F.col("__k"), "left")
    stays = F.col("__k").isNotNull()
    return joined.select(
        *[c for c in folded.columns if c not in ("closed_at", "is_active", "change")],
        F.when(stays, F.lit(None).cast("string")).otherwise(F.col("closed_at")).alias("closed_at"),
        F.when(stays, 1).otherwise(F.col("is_active")).cast("int").alias("is_active"),
        F.when(stays, F.lit("kept")).otherwise(F.col("change")).alias("change"),
    )


def apply_boards(state: DataFrame, incoming: DataFrame, order: str = "ord") -> DataFrame:
    """Boards after a snapshot: an error keeps the time of the last success."""
    key = F.when(F.col("provider") == "workday", F.lower("key")).otherwise(F.col("key"))
    new = keep_first(incoming.withColumn("key", key), "key", order)
    both = state.alias("o").join(new.alias("n"), F.col("o.key") == F.col("n.key"), "full_outer")
    came = F.col("n.key").isNotNull()
    pick = lambda c: F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    success = F.when(~came | (F.col("n.status") == "error"), F.col("o.last_success_at")).otherwise(F.col("n.synced_at"))
    return both.select(
        F.coalesce("o.key", "n.key").alias("key"),
        *[pick(c).alias(c) for c in ("provider", "identifier", "status")],
        F.when(came, F.coalesce("n.job_count", F.lit(0))).otherwise(F.col("o.job_count")).alias("job_count"),
        F.coalesce("o.first_seen_at", "n.synced_at").alias("first_seen_at"),
        F.when(came, F.col("n.synced_at")).otherwise(F.col("o.last_synced_at")).alias("last_synced_at"),
        success.alias("last_success_at"),
        pick("error").alias("error"),
    )


def schedule_boards(state: DataFrame, results: DataFrame, mode: Mode = PRODUCTION) -> DataFrame:
    """state (key, status, queue_state, job_count, failure_count, last_synced_at, next_sync_at, last_error, ...) after results (key, status, job_count, synced_at, error).

    Success resets the failures; an error adds one, which sets the next attempt, and leaves
    the count of postings. Every result makes its board idle.
    """
    both = state.alias("o").join(results.alias("n"), F.col("o.key") == F.col("n.key"), "left")
    came, failed = F.col("n.key").isNotNull(), F.col("n.status") == "error"
    failures = F.when(came & failed, F.coalesce("o.failure_count", F.lit(0)) + 1).when(came, 0).otherwise(F.col("o.failure_count"))
    due = F.col("n.synced_at") if mode.next_sync == "now" else next_sync(F.col("n.status"), failures, F.col("n.synced_at"))
    other = [c for c in state.columns if c not in ("status", "queue_state", "job_count", "failure_count", "last_synced_at", "next_sync_at", "last_error")]
    return both.select(
        *[F.col(f"o.{c}").alias(c) for c in other],
        F.when(came, F.col("n.status")).otherwise(F.col("o.status")).alias("status"),
        F.when(came, F.lit("idle")).otherwise(F.col("o.queue_state")).alias("queue_state"),
        F.when(came & ~failed, F.col("n.job_count")).otherwise(F.col("o.job_count")).alias("job_count"),
        failures.cast("int").alias("failure_count"),
        F.when(came, F.col("n.synced_at")).otherwise(F.col("o.last_synced_at")).alias("last_synced_at"),
        F.when(came, due).otherwise(F.col("o.next_sync_at")).alias("next_sync_at"),
        F.when(came & failed, F.col("n.error")).when(came, F.lit(None).cast("string")).otherwise(F.col("o.last_error")).alias("last_error"),
    )


def upsert_companies(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """Companies (key, name, logo_url, logo_checked_at) after incoming ones with a fallback name: what is known stays where the new is null."""
    both = state.alias("o").join(incoming.alias("n"), F.col("o.key") == F.col("n.key"), "full_outer")
    known = F.col("o.key").isNotNull()
    return both.select(
        F.coalesce("o.key", "n.key").alias("key"),
        F.when(known, F.coalesce("n.name", "o.name")).otherwise(F.coalesce("n.name", "n.fallback")).alias("name"),
        F.coalesce("n.logo_url", "o.logo_url").alias("logo_url"),
        F.coalesce("n.logo_checked_at", "o.logo_checked_at").alias("logo_checked_at"),
    )


def upsert_discovered(state: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """Boards after discovery: new ones are due at once, known ones get the newest URLs."""
    new = keep_first(found, "key", F.desc("ord"))
    both = state.alias("o").join(new.alias("n"), F.col("o.key") == F.col("n.key"), "full_outer")
    came, known = F.col("n.key").isNotNull(), F.col("o.key").isNotNull()
    first = lambda c, v: F.when(known, F.col(f"o.{c}")).otherwise(v).alias(c)
    newest = lambda c: F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(
        F.coalesce("o.key", "n.key").alias("key"),
        *[first(c, F.col(f"n.{c}")) for c in ("provider", "identifier")],
        first("region", F.coalesce("n.region", F.lit("global"))),
        newest("board_url"), newest("api_url"),
        first("status", F.lit("new")), first("queue_state", F.lit("idle")),
        first("next_sync_at", F.lit(now)),
        F.when(came, F.lit(now)).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def append_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    """The run log with a run; a run of a time that is there already changes nothing."""
    return runs.unionByName(keep_first(run, "synced_at", "synced_at").join(runs, "synced_at", "left_anti"))


def sync_summary(results: DataFrame) -> DataFrame:
    """Per provider: boards, jobs, and boards by status."""
    by = [F.count_if(F.col("status") == s).alias(f"{s}_boards") for s in ("active", "empty", "invalid", "error")]
    return results.groupBy("provider").agg(F.count("*").alias("boards"), F.sum("job_count").alias("jobs"), *by)


def provider_health(state: DataFrame, results: DataFrame) -> DataFrame:
    """state (provider, successful_runs, failed_runs, active_jobs, last_success_at, last_failure_at) after results (provider, status, delta, synced_at)."""
    fine = F.col("status") != "error"
    new = results.groupBy("provider").agg(
        F.count_if(fine).alias("ok"),
        F.count_if(~fine).alias("bad"),
        F.coalesce(F.sum(F.when(fine, F.col("delta"))), F.lit(0)).alias("delta"),
        F.max(F.when(fine, F.col("synced_at"))).alias("ok_at"),
        F.max(F.when(~fine, F.col("synced_at"))).alias("bad_at"),
    )
    both = state.alias("o").join(new.alias("n"), F.col("o.provider") == F.col("n.provider"), "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        F.coalesce("o.provider", "n.provider").alias("provider"),
        (zero("o.successful_runs") + zero("n.ok")).alias("successful_runs"),
        (zero("o.failed_runs") + zero("n.bad")).alias("failed_runs"),
        F.greatest(F.lit(0), zero("o.active_jobs") + zero("n.delta")).alias("active_jobs"),
        F.coalesce("n.ok_at", "o.last_success_at").alias("last_success_at"),
        F.coalesce("n.bad_at", "o.last_failure_at").alias("last_failure_at"),
    )


def merge_columns(state: DataFrame, schema_of: DataFrame) -> DataFrame:
    """Additive schema evolution: columns that the state lacks are added as nulls."""
    return state.unionByName(schema_of.limit(0), allowMissingColumns=True)


def compact_jobs(jobs: DataFrame, mode: Mode = PRODUCTION) -> DataFrame:
    """Postings as a hosted table keeps them: without descriptions, departments and pay, with defaults and a fingerprint."""
    slim = jobs.drop("description_plain", "department", "apply_url", "compensation_json")
    slim = slim.withColumns({"workplace": F.coalesce("workplace", F.lit("Unspecified")), "category": F.coalesce("category", F.lit("Other")), "source_id": F.col("source_id").cast("string")})
    return slim.withColumn("fingerprint", job_fingerprint(mode))


def sound_requests(requests: DataFrame) -> DataFrame:
    """Pushed postings (board: struct, job: struct) that can be applied: every required field is there and the posting is of its board."""
    there = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    board = [there(f"board.{c}") for c in ("key", "provider", "identifier", "status", "synced_at")]
    job = [there(f"job.{c}") for c in ("key", "source_id", "board_key", "provider", "company_identifier", "title", "url")]
    ok = F.col("job.board_key") == F.col("board.key")
    for c in (*board, *job):
        ok = ok & c
    return requests.where(F.coalesce(ok, F.lit(False)))
