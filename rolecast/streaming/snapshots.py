"""Snapshots as a stream: each micro-batch is folded into the stored state.

Postings, boards and the number of the batch are committed as one version after each batch,
so that a restarted stream folds each batch once, whenever it stopped. Failed snapshots change no posting. Snapshots are folded in the order of their time;
a late one that is older than the state overwrites it unless reject_stale is set.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecast.operators.snapshots import apply_boards, apply_snapshot, keep_first
from rolecast.operators.snapshots import LOCAL, Mode
from rolecast.sources.state import Store

JOBS = "key string, source_id string, board_key string, title string, location string, first_seen_at string, last_seen_at string, closed_at string, is_active int"
BOARDS = "key string, provider string, identifier string, status string, job_count bigint, first_seen_at string, last_synced_at string, last_success_at string, error string"


class SnapshotState:
    """The stored postings and boards."""

    def __init__(self, spark: SparkSession, path: str, mode: Mode = LOCAL, reject_stale: bool = False):
        self.spark, self.store, self.mode, self.reject_stale = spark, Store(spark, path), mode, reject_stale

    def jobs(self) -> DataFrame:
        return self.store.read("jobs", JOBS)

    def boards(self) -> DataFrame:
        return self.store.read("boards", BOARDS)

    def done(self) -> int:
        """The last batch that was folded, -1 before the first."""
        return self.store.version()["notes"].get("batch", -1)

    def folded(self, jobs: DataFrame, boards: DataFrame, postings: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and boards after one snapshot of each board: postings (JOBS fields, synced_at, ord) and results (key, provider, identifier, status, job_count, synced_at, error)."""
        if self.reject_stale:
            known = boards.select("key", F.col("last_synced_at").alias("__at"))
            results = results.join(known, "key", "left").where("__at is null or synced_at >= __at").drop("__at")
        mine = postings.join(results.select(F.col("key").alias("board_key")), "board_key", "left_semi")
        after = apply_snapshot(jobs, keep_first(mine, "key", "ord"), results, self.mode).drop("change")
        return after, apply_boards(boards, results.withColumn("ord", F.lit(0)))

    def fold(self, postings: DataFrame, results: DataFrame) -> None:
        """Folds one snapshot of each board into the stored state."""
        jobs, boards = self.folded(self.jobs(), self.boards(), postings, results)
        self.store.commit(jobs=jobs, boards=boards)

    def batch(self, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch. split: rows of a batch -> postings and results with a column `round` that orders a board's snapshots."""

        def run(rows: DataFrame, batch: int) -> None:
            if batch <= self.done():
                return
            postings, results = split(rows)
            postings, results = postings.checkpoint(), results.checkpoint()
            most = results.agg(F.max("round")).first()[0] or 0
            jobs, boards = self.jobs(), self.boards()
            for i in range(1, most + 1):  # a board's snapshots one after the other; boards side by side
                if i > 1:
                    jobs, boards = jobs.checkpoint(), boards.checkpoint()
                jobs, boards = self.folded(jobs, boards, postings.where(F.col("round") == i).drop("round"), results.where(F.col("round") == i).drop("round"))
            self.store.commit({"batch": batch}, **({"jobs": jobs, "boards": boards} if most else {}))

        return run


def rounds(results: DataFrame) -> DataFrame:
    """results with round: a board's first snapshot of the batch is 1, the next 2, ..., by time."""
    return results.withColumn("round", F.row_number().over(Window.partitionBy("key").orderBy("synced_at")))


def stream(spark: SparkSession, source: DataFrame, state: SnapshotState, split, checkpoint: str):
    """Starts folding a streaming source, whatever there is of it now, and returns the query."""
    return source.writeStream.foreachBatch(state.batch(split)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Board state with timers, kept by the stream itself -------------------------------------


def board_state_machine():
    """A stateful processor: results of a board (status, synced_at) in, its state after each out."""
    from pyspark.sql.streaming import StatefulProcessor

    class Machine(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("board", "failures int")

        def handleInputRows(self, key, rows, timers):
            import pandas as pd

            from rolecast.streaming.rules import next_time

            frames = [r for r in rows]
            found = pd.concat(frames).sort_values("synced_at") if frames else pd.DataFrame()
            failures = self.state.get()[0] if self.state.exists() else 0
            out = []
            for r in found.itertuples():
                failures = failures + 1 if r.status == "error" else 0
                out.append((key[0], r.status, failures, r.synced_at, next_time(r.status, failures, r.synced_at)))
            self.state.update((failures,))
            yield pd.DataFrame(out, columns=["key", "status", "failures", "synced_at", "next_sync_at"])

        def close(self) -> None:
            pass

    return Machine()
