"""Writers: NDJSON exports, documents and pushes. Stored state is in sources/state.py."""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_ndjson(frame: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON object a line; null fields are kept."""
    frame.write.mode("overwrite").option("compression", compression).option("ignoreNullFields", "false").json(path)


def export_order(jobs: DataFrame) -> DataFrame:
    """Newest first, then by key."""
    return jobs.orderBy(F.coalesce("published_at", F.lit("")).desc(), "key")


def export_document(jobs: DataFrame, path: str, **head) -> None:
    """A single JSON document with an array of postings, written as lines of one text part; rows stream through one task, as one file demands."""
    rows = export_order(jobs).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    numbered = rows.coalesce(1).select(F.concat(F.when(F.monotonically_increasing_id() > 0, F.lit(",")).otherwise(F.lit("")), "value").alias("value"))
    spark = jobs.sparkSession
    opening = json.dumps(head)[:-1] + (", " if head else "") + '"jobs": ['
    first, last = (spark.createDataFrame([(x,)], "value string").coalesce(1) for x in (opening, "]}"))
    first.union(numbered).union(last).coalesce(1).write.mode("overwrite").text(path)


def push(results: DataFrame, send: str, size: int = 100, retries: int = 4, wait: float = 0.3) -> DataFrame:
    """Sends each partition's rows as JSON, `size` at a time, through the function at an import path; returns (sent, failed) for each partition.

    The function may return an HTTP status or raise an error with one as `status` or `code`.
    408, 429, statuses of 500 and more and network errors are tried again, after `wait`
    seconds doubled each time; what still fails, or is refused, counts as failed. A task that
    Spark repeats sends its rows again: rows arrive at least once.
    """

    def run(batches):
        import time

        from rolecast.sources.paged import RETRIED, transport

        post: Callable[[list[dict]], int | None] = transport(send)
        import pyarrow as pa

        def sent_all(rows: list[dict]) -> bool:
            for attempt in range(retries + 1):
                try:
                    status = post(rows) or 200
                except Exception as error:
                    status = getattr(error, "status", None) or getattr(error, "code", None)
                    if status is None and not isinstance(error, OSError):
                        raise
                if isinstance(status, int) and 200 <= status < 300:
                    return True
                if isinstance(status, int) and not (status in RETRIED or status >= 500):
                    return False
                if attempt < retries:
                    time.sleep(wait * 2**attempt)
            return False

        sent = failed = 0
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), size):
                part = rows[i : i + size]
                done = sent_all(part)
                sent, failed = sent + len(part) * done, failed + len(part) * (not done)
        yield pa.record_batch([pa.array([sent], pa.int64()), pa.array([failed], pa.int64())], names=["sent", "failed"])

    return results.mapInArrow(run, "sent long, failed long")
