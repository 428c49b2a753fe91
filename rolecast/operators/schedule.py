"""When the updater has something to do, and the daily maintenance as one plan."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from rolecast.operators import ops
from rolecast.plans.jobs import title_counts


def _time(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def due(state: dict, now: str, sync_minutes: int = 60, discovery_days: int = 7) -> list[str]:
    """The runs that are due by the updater's state (last_sync_at, last_discovery_at); never run means due."""
    found = []
    for name, wait in (("discovery", timedelta(days=discovery_days)), ("sync", timedelta(minutes=sync_minutes))):
        last = state.get(f"last_{name}_at")
        if last is None or _time(now) - _time(last) >= wait:
            found.append(name)
    return found


def maintenance(jobs: DataFrame, runs: DataFrame, failures: DataFrame, boards: DataFrame, health: DataFrame, now: str, archived: DataFrame) -> dict[str, DataFrame]:
    """The tables after a day's maintenance. jobs: key, closed_at, is_active, provider, title; runs: key, started_at; failures: key, board_key, resolved_at; archived: the postings that an archive holds, which alone go."""
    kept = jobs.join(archived.select("key"), "key", "left_anti")
    return {
        "jobs": kept,
        "titles": title_counts(kept),
        "health": ops.reconcile_health(health, kept),
        "runs": ops.prune(runs, "started_at", now, 14, 100_000),
        "failures": ops.prune(ops.resolve_failures(failures, boards, now), "resolved_at", now, 7, 100_000),
    }
