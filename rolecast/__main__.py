"""Commands over staged files and stored state: python -m rolecast <command> --help."""

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.operators import ops, registry, snapshots
from rolecast.plans import jobs as j
from rolecast.sources import paged, providers, sinks, staged
from rolecast.sources.state import Store
from rolecast.streaming.snapshots import BOARDS


def session() -> SparkSession:
    return SparkSession.builder.appName("rolecast").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    columns = ["key", *snapshots.JOB_FIELDS, "first_seen_at", "last_seen_at", "closed_at"]
    store = Store(spark, path)
    return store.read("jobs", ", ".join(f"{c} string" for c in columns) + ", is_active int"), store.read("boards", BOARDS)


def fold(spark: SparkSession, path: str, jobs: DataFrame, results: DataFrame) -> None:
    """Folds a snapshot into the state under a path."""
    old_jobs, old_boards = state(spark, path)
    after = snapshots.apply_snapshot(old_jobs, snapshots.stage_jobs(jobs), results, snapshots.LOCAL).drop("change")
    boards = snapshots.apply_boards(old_boards, results if "ord" in results.columns else results.withColumn("ord", F.lit(0)))
    Store(spark, path).commit(jobs=after, boards=boards)


def discover(spark: SparkSession, a: argparse.Namespace) -> None:
    urls = staged.crawl_index(spark, a.urls) if a.ndjson else staged.url_list(spark, a.urls)
    rows = urls.select("url", F.lit(a.source).alias("discovery_source"), F.lit(a.now).alias("discovered_at"), F.monotonically_increasing_id().alias("ord"))
    sinks.export_ndjson(registry.merge_registry(registry.discovered_records(rows)).orderBy("key"), a.output)


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    shards = None
    for i, path in enumerate(a.shards):
        rows = staged.registry_shard(spark, path).withColumn("ord", F.col("ord") + F.lit(i * 1_000_000_000))
        shards = rows if shards is None else shards.unionByName(rows)
    get = lambda p: F.get_json_object("value", f"$.{p}")
    lists = lambda p: F.from_json(get(p), "array<string>")
    records = shards.select(
        get("key").alias("key"), get("provider").alias("provider"), get("identifier").alias("identifier"), get("region").alias("region"), get("boardUrl").alias("board_url"), get("apiUrl").alias("api_url"),
        lists("discoverySources").alias("discovery_sources"), lists("sampleUrls").alias("sample_urls"), get("firstDiscoveredAt").alias("first_discovered_at"), get("validation").alias("validation"), "ord",
    )
    sinks.export_ndjson(registry.merge_registry(records.where("key is not null")).orderBy("key"), a.output)


def sync(spark: SparkSession, a: argparse.Namespace) -> None:
    paged.register(spark)
    get = lambda p: F.get_json_object("value", f"$.{p}")
    listed = spark.read.text(a.boards).select("value", get("key").alias("key"), get("provider").alias("p"), F.monotonically_increasing_id().alias("o"))
    if a.provider:
        listed = listed.where(F.col("p").isin(a.provider.split(",")))
    if a.only_new:
        listed = registry.only_new(listed, state(spark, a.state)[1])
    boards = [json.loads(r.value) for r in registry.round_robin(listed, "p", "o", a.limit).collect()]  # at most limit
    read = spark.read.format("boards").option("boards", json.dumps(boards)).option("transport", a.transport).option("synced_at", a.now).load()
    path = f"{a.state}/staged"
    read.write.mode("overwrite").parquet(path)
    rows, names = spark.read.parquet(path), sorted({b["provider"] for b in boards})
    if names:
        fold(spark, a.state, providers.normalise_all(rows, names).withColumn("ord", F.lit(0)), providers.board_results(rows, names))


def database(spark: SparkSession, a: argparse.Namespace) -> None:
    fold(spark, a.state, staged.snapshot_jobs(spark, a.jobs), staged.snapshot_boards(spark, a.sync))


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    q = j.JobQuery(search=a.search, location=a.location, company=a.company, title=a.title, country=a.country, provider=a.provider, workplace=a.workplace, category=a.category, sort=a.sort, limit=a.limit, cursor=a.cursor, posted_within=a.posted_within)
    jobs, _ = state(spark, a.state)
    for row in j.public_jobs(j.page(jobs, q)).toJSON().collect():  # a page of at most 100 rows
        print(row)
    print(json.dumps({"total": j.total(jobs, q).first().total}))


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    print(ops.report(state(spark, a.state)[1]))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rolecast")
    commands = parser.add_subparsers(required=True)

    def command(run, *required: str, **optional):
        p = commands.add_parser(run.__name__, help=(run.__doc__ or run.__name__).splitlines()[0])
        for name in required:
            p.add_argument(f"--{name}", required=True)
        for name, default in optional.items():
            p.add_argument(f"--{name.replace('_', '-')}", default=default, **({"type": int} if isinstance(default, int) and not isinstance(default, bool) else {"action": "store_true"} if isinstance(default, bool) else {}))
        p.set_defaults(run=run)
        return p

    command(discover, "urls", "output", "now", source="urls", ndjson=False)
    command(merge, "output").add_argument("shards", nargs="+")
    command(sync, "boards", "state", "transport", "now", limit=1000, provider="", only_new=False)
    command(database, "state", "jobs", "sync")
    command(search, "state", search=None, location=None, company=None, title=None, country=None, provider=None, workplace=None, category=None, sort="newest", limit=50, cursor=None, posted_within=None)
    command(report, "state")
    a = parser.parse_args(args)
    a.run(session(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
