"""Board registry, crawl-page sampling and the coverage ledger."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.functions.grammar import PROVIDERS, TARGETS, with_board
from rolecast.functions.text import positive_modulo

SAMPLE_URLS = 3


def discovery_targets(spark, providers: list[str] | None = None) -> DataFrame:
    """The crawl targets of the providers; an unknown name is an error."""
    for name in providers or []:
        if name not in PROVIDERS:
            raise ValueError(f"unsupported provider: {name}")
    rows = [t for t in TARGETS if providers is None or t[0] in providers]
    return spark.createDataFrame(rows, "provider string, pattern string, query string, match_type string, region string")


def first_by(value: Column, order: Column) -> Column:
    """Aggregate: the value of the least order among rows whose value is neither null nor empty."""
    return F.min_by(F.when(value.cast("string") != "", value), F.when(value.cast("string") != "", order))


def merge_registry(records: DataFrame, order: str = "ord") -> DataFrame:
    """Merges records of one board key.

    records: key, provider, identifier, region, board_url, api_url, discovery_sources and
    sample_urls (array<string>), first_discovered_at, validation, and an order. The first
    record's board fields stay; sources are united and the first three sample URLs kept, in
    order of appearance; the earliest discovery date and the first validation win.
    """
    ord_ = F.col(order)

    def distinct(column: str) -> DataFrame:
        """(key, v, o): each element once for a key, with its first place. Elements of a hot key are combined before the shuffle."""
        rows = records.select("key", ord_.alias("o"), F.posexplode(column).alias("at", "v"))
        return rows.groupBy("key", "v").agg(F.min(F.struct("o", "at")).alias("o"))

    def listed(rows: DataFrame, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("o", "v")))
        return rows.groupBy("key").agg(F.transform(ordered, lambda x: x["v"]).alias(name))

    nth = F.row_number().over(Window.partitionBy("key").orderBy("o"))
    samples = distinct("sample_urls").withColumn("n", nth).where(F.col("n") <= SAMPLE_URLS)
    merged = records.groupBy("key").agg(
        *[F.min_by(c, ord_).alias(c) for c in ("provider", "identifier", "region", "board_url", "api_url")],
        F.min("first_discovered_at").alias("first_discovered_at"),
        F.min_by("validation", F.when(F.col("validation").isNotNull(), ord_)).alias("validation"),
    )
    merged = merged.join(listed(distinct("discovery_sources"), "discovery_sources"), "key", "left").join(listed(samples, "sample_urls"), "key", "left")
    none = F.array().cast("array<string>")
    return merged.withColumns({c: F.coalesce(c, none) for c in ("discovery_sources", "sample_urls")}).select(
        "key", "provider", "identifier", "region", "board_url", "api_url", "discovery_sources", "sample_urls", "first_discovered_at", "validation"
    )


def discovered_records(urls: DataFrame, hint: str | None = None) -> DataFrame:
    """urls (url, discovery_source, discovered_at, ord): registry records of those that are boards."""
    found = with_board(urls, "url", "b", hint).where("b is not null")
    return found.select(
        "b.*",
        F.array_compact(F.array("discovery_source")).alias("discovery_sources"),
        F.array("url").alias("sample_urls"),
        F.col("discovered_at").alias("first_discovered_at"),
        F.lit(None).cast("string").alias("validation"),
        "ord",
    )


def round_robin(frame: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """Rows taken in turn from each group, groups in the order of their first row."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = F.min(order).over(Window.partitionBy(group))
    limit = max(0, limit)
    # no group gives more rows than the limit, so each task drops the rest before it sorts
    picked = frame.withColumn("turn", turn).where(F.col("turn") <= limit)
    return picked.withColumn("first", first).orderBy("turn", "first").limit(limit).drop("first")


def even_pages(total: Column, most: Column) -> Column:
    """Page numbers spread evenly from the first to the last: all if there are no more than most."""
    none = F.array().cast("array<bigint>")
    total, most = total.cast("bigint"), most.cast("bigint")
    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(most, F.lit(1)) - 1), lambda i: F.floor(i * (total - 1) / F.greatest(most - 1, F.lit(1)) + 0.5).cast("bigint"))
    return (
        F.when((total <= 0) | (most <= 0), none)
        .when(total <= most, F.sequence(F.lit(0).cast("bigint"), F.greatest(total, F.lit(1)) - 1))
        .when(most == 1, F.array(F.floor((total - 1) / 2).cast("bigint")))
        .otherwise(F.array_sort(F.array_distinct(spread)))
    )


def rotating_pages(total: Column, most: Column, seed: Column) -> Column:
    """Evenly spread page numbers that start at the seed."""
    total, most = total.cast("bigint"), most.cast("bigint")
    start = positive_modulo(seed, F.greatest(total, F.lit(1)))
    turned = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(most, F.lit(1)) - 1), lambda i: F.floor((start + i * (total / most)) % total).cast("bigint"))
    return (
        F.when(total <= most, even_pages(total, most))
        .when(most <= 0, F.array().cast("array<bigint>"))
        .when(most == 1, F.array(start))
        .otherwise(F.array_sort(F.array_distinct(turned)))
    )


def unseen_pages(total: Column, most: Column, seen: Column, seed: Column) -> Column:
    """Pages not seen yet: all if there are no more than most, else spread from the seed."""
    total = total.cast("bigint")
    every = F.when(total > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(total, F.lit(1)) - 1)).otherwise(F.array().cast("array<bigint>"))
    left = F.array_except(every, seen.cast("array<bigint>"))
    picked = F.transform(rotating_pages(F.size(left), most, seed), lambda i: F.get(left, i.cast("int")))
    return F.when(most <= 0, F.array().cast("array<bigint>")).when(F.size(left) <= most, left).otherwise(picked)


def record_coverage(ledger: DataFrame, sampled: DataFrame) -> DataFrame:
    """ledger and sampled (target, total_pages, sampled_pages, sampled_at): the ledger after the samples.

    A target's pages are united, those below the newest total kept, in ascending order.
    """
    both = ledger.select("target", "total_pages", "sampled_pages", F.lit(None).cast("string").alias("sampled_at")).withColumn("age", F.lit(0)).unionByName(
        sampled.select("target", "total_pages", "sampled_pages", "sampled_at").withColumn("age", F.lit(1))
    )
    total = F.max_by("total_pages", F.struct("age", F.coalesce("sampled_at", F.lit(""))))
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list("sampled_pages"))))
    out = both.groupBy("target").agg(total.alias("total_pages"), pages.alias("p"), F.max("sampled_at").alias("sampled_at"))
    out = out.withColumn("sampled_pages", F.filter("p", lambda x: (x >= 0) & (x < F.col("total_pages")))).drop("p")
    return out.withColumn("completed", F.size("sampled_pages") >= F.col("total_pages"))


def coverage_summary(ledger: DataFrame) -> DataFrame:
    """One row: targets, completed, total_pages, sampled_pages, completion (1 when there is nothing to do)."""
    sampled = F.coalesce(F.sum(F.least(F.size("sampled_pages"), F.col("total_pages"))), F.lit(0))
    pages = F.coalesce(F.sum("total_pages"), F.lit(0))
    done = F.count_if(F.size("sampled_pages") >= F.col("total_pages"))
    return ledger.agg(
        F.count("*").alias("targets"),
        done.alias("completed"),
        pages.cast("bigint").alias("total_pages"),
        sampled.cast("bigint").alias("sampled_pages"),
        F.when(pages == 0, F.lit(1.0)).otherwise(F.round(sampled / pages, 4)).alias("completion"),
    )


def credit_budget(limit: int, budget: int) -> tuple[int, int]:
    """Queries that a credit budget allows and the credits they use: two credits for each started ten results."""
    each = max(2, -(-limit // 10) * 2)
    return budget // each, budget // each * each


def import_boards(records: DataFrame, providers: list[str] | None = None, only_validated: bool = False) -> DataFrame:
    """Registry records (with ord) as boards to import: of the wanted providers, validated if asked for, canonical, the last of a key."""
    found = records
    if providers:
        found = found.where(F.col("provider").isin(providers))
    if only_validated:
        found = found.where(F.get_json_object("validation", "$.status") == "active")
    found = with_board(found, "board_url", "__b")
    for c in ("key", "provider", "identifier", "region", "board_url", "api_url"):
        found = found.withColumn(f"__{c}", F.coalesce(F.col("__b")[c], F.col(c)))
    last = F.row_number().over(Window.partitionBy("__key").orderBy(F.desc("ord")))
    found = found.withColumn("__rn", last).where("__rn = 1 and __key is not null")
    return found.select(*[F.col(f"__{c}").alias(c) for c in ("key", "provider", "identifier", "region", "board_url", "api_url")])


def upsert_pages(state: DataFrame, pages: DataFrame) -> DataFrame:
    """Discovery pages (id, status, url_count, updated_at) after newer ones: the newest row of an id replaces the others."""
    both = state.withColumn("__new", F.lit(0)).unionByName(pages.withColumn("__new", F.lit(1)))
    rn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__new"), F.desc("updated_at")))
    return both.withColumn("__rn", rn).where("__rn = 1").drop("__rn", "__new")


def only_new(boards: DataFrame, known: DataFrame) -> DataFrame:
    """The boards that the state does not hold yet, by key; null keys are new."""
    return boards.join(known.select("key").distinct(), "key", "left_anti")
