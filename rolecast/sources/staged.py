"""Readers of staged files: snapshots, registries, URL lists, crawl-index pages, ledgers."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOB_PATHS = {
    "key": "key", "source_id": "sourceId", "board_key": "boardKey", "provider": "provider", "company_identifier": "companyIdentifier",
    "company_name": "companyName", "company_logo_url": "companyLogoUrl", "title": "title", "location": "location", "country": "country",
    "city": "city", "role_family": "roleFamily", "company_industry": "companyIndustry", "workplace": "workplace",
    "employment_type": "employmentType", "department": "department", "category": "category", "description_plain": "descriptionPlain",
    "published_at": "publishedAt", "url": "url", "apply_url": "applyUrl", "synced_at": "syncedAt",
}
BOARD_PATHS = {"key": "key", "provider": "provider", "identifier": "identifier", "status": "status", "synced_at": "syncedAt", "error": "error"}
STATUSES = ("active", "empty", "invalid", "error")


def missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)


def read_if_exists(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A Parquet table; without the path an empty one of the schema. Other errors are raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not missing(error):
            raise
        return spark.createDataFrame([], schema)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents, one row each, as (path, document)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("document"))


def elements(frame: DataFrame, document: str, *paths: str) -> DataFrame:
    """(ord, value): the elements, as JSON text, of the first of the paths that holds an array; '$' is the document itself."""
    arrays = []
    for p in paths:
        raw = F.get_json_object(F.col(document), p)
        arrays.append(F.when(F.ltrim(raw).startswith("["), F.from_json(raw, T.ArrayType(T.StringType()))))
    return frame.select(F.posexplode(F.coalesce(*arrays)).alias("ord", "value"))


def compensation_text(value: Column) -> Column:
    """JSON text of an item's compensation: null if the path is missing, the text `null` for a JSON null."""
    found = F.try_variant_get(F.try_parse_json(value), "$.compensation", "variant")
    return F.when(F.is_variant_null(found), F.lit("null")).when(found.isNotNull(), F.coalesce(F.to_json(found), F.lit("null")))


def snapshot_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The postings of a snapshot file, with ord, their place in it."""
    rows = elements(documents(spark, path), "document", "$.jobs")
    get = lambda p: F.get_json_object("value", f"$.{p}")
    return rows.select("ord", *[get(p).alias(c) for c, p in JOB_PATHS.items()], compensation_text(F.col("value")).alias("compensation_json"))


def snapshot_boards(spark: SparkSession, path: str) -> DataFrame:
    """The boards of a sync file, with ord, their place in it."""
    rows = elements(documents(spark, path), "document", "$.boards")
    get = lambda p: F.get_json_object("value", f"$.{p}")
    return rows.select("ord", *[get(p).alias(c) for c, p in BOARD_PATHS.items()], F.coalesce(get("jobCount").cast("bigint"), F.lit(0)).alias("job_count"))


def run_summary(frame: DataFrame, document: str) -> DataFrame:
    """One row for each document: synced_at and its counts, 0 where it names none."""
    count = lambda p: F.coalesce(F.get_json_object(F.col(document), f"$.summary.{p}").cast("bigint"), F.lit(0))
    return frame.select(
        F.get_json_object(F.col(document), "$.syncedAt").alias("synced_at"), count("boardCount").alias("board_count"), count("jobCount").alias("job_count"),
        *[count(f"statuses.{s}").alias(f"{s}_boards") for s in STATUSES],
    )


def registry_shard(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): board records of a shard, an array or an object with boards; anything else is an error."""
    shards = documents(spark, path)
    raw = F.coalesce(F.get_json_object("document", "$.boards"), F.get_json_object("document", "$"))
    sound = shards.select("path", F.when(F.ltrim(raw).startswith("["), F.col("document")).otherwise(F.raise_error(F.concat(F.lit("no board array in "), "path"))).alias("document"))
    return elements(sound, "document", "$.boards", "$")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): the lines of a text file, trimmed, without blank ones and comments; or the strings of a JSON array or of its urls."""
    found = documents(spark, path)
    json = F.col("document").rlike(r"^\s*[\[{]")
    raw = F.coalesce(F.get_json_object("document", "$.urls"), F.get_json_object("document", "$"))
    listed = F.when(json, F.from_json(raw, T.ArrayType(T.StringType()))).otherwise(F.split("document", r"\r?\n"))
    return found.select(F.explode(listed).alias("url")).select(F.trim("url").alias("url")).where("url <> '' and url not like '#%'")


def crawl_index(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(url): the URLs of NDJSON crawl-index pages; blank and malformed lines are skipped."""
    urls = spark.read.text(path).select(F.get_json_object("value", "$.url").alias("url")).where("url is not null")
    return urls if most is None else urls.limit(most)


def coverage_ledger(frame: DataFrame, document: str) -> DataFrame:
    """(target, index_id, provider, pattern, total_pages, sampled_pages, completed) of ledger documents; defaults where a field is missing."""
    entry = "struct<indexId:string,provider:string,pattern:string,totalPages:bigint,sampledPages:array<bigint>,completed:boolean,lastSampledAt:string>"
    rows = frame.select(F.explode(F.from_json(F.get_json_object(F.col(document), "$.coverage"), f"map<string,{entry}>")).alias("target", "c"))
    return rows.select(
        "target", F.col("c.indexId").alias("index_id"), "c.provider", "c.pattern", F.coalesce("c.totalPages", F.lit(0).cast("bigint")).alias("total_pages"),
        F.coalesce("c.sampledPages", F.array().cast("array<bigint>")).alias("sampled_pages"), F.coalesce("c.completed", F.lit(False)).alias("completed"), F.col("c.lastSampledAt").alias("sampled_at"),
    )


def valid_payload(body: Column, path: str | None = None) -> Column:
    """Whether a body is JSON, and holds an array at the path."""
    raw = F.get_json_object(body, f"$.{path}" if path else "$")
    return F.try_parse_json(body).isNotNull() & F.coalesce(F.ltrim(raw).startswith("["), F.lit(False))


def logo_candidates(html: Column, base: Column) -> Column:
    """The best logo of a board page: a square icon before a share image, an employer's before a vendor's. Null without one."""
    tag = r"(?i)<(?:meta|link)[^>]*?(?:property|name|rel)=[\"']([^\"']+)[\"'][^>]*?(?:content|href)=[\"']([^\"']+)[\"'][^>]*>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(tag), 1).alias("kind"), F.regexp_extract_all(html, F.lit(tag), 2).alias("raw"))
    order = ["apple-touch-icon", "icon", "shortcut icon", "og:image"]
    # hosts of the providers' own pictures
    vendors = r"(?i)(^|\.)ashbyprd\.com$|(^|\.)ashbyhq\.com$|^www\.bamboohr\.com$|(^|\.)lever\.co$|(^|\.)gem\.com$|(^|\.)comeet\.com$|(^|\.)getro\.com$|^cdn\.paylocity\.com$"

    def entry(p: Column) -> Column:
        kind = F.lower(F.trim(p["kind"]))
        rank = F.array_position(F.array(*[F.lit(x) for x in order]), kind)
        rank = F.when(rank > 0, rank).when(kind.contains("icon"), 2)
        raw = F.trim(p["raw"])
        for pattern, to in (("(?i)&amp;", "&"), ("(?i)&#x26;", "&"), ("&#38;", "&"), ("(?i)&quot;", '"'), ("(?i)&#x2F;", "/")):
            raw = F.regexp_replace(raw, pattern, to)
        return F.struct(rank.cast("int").alias("rank"), resolve(raw, base).alias("url"), F.startswith(raw, F.lit("data:")).alias("inline"))

    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    usable = F.filter(
        F.transform(pairs, entry), lambda e: e["rank"].isNotNull() & ~e["inline"] & F.coalesce(e["url"].rlike("^https?://[^/]"), F.lit(False)) & ~host(e["url"]).rlike(vendors)
    )
    return F.coalesce(*[F.get(_of_rank(usable, rank), F.lit(0))["url"] for rank in range(1, len(order) + 1)])


def _of_rank(entries: Column, rank: int) -> Column:
    return F.filter(entries, lambda e: e["rank"] == rank)


def resolve(raw: Column, base: Column) -> Column:
    """A reference resolved against a base URL: absolute, scheme-relative, rooted or relative."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    parts = F.filter(F.split(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_extract(raw, r"^([^?#]*)", 1)), "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(
        parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    )
    relative = F.concat(origin, F.lit("/"), F.array_join(walked, "/"), F.regexp_extract(raw, r"^[^?#]*(.*)$", 1))
    bare = F.when(raw.rlike(r"^https?://[^/?#]+$"), F.concat(raw, F.lit("/"))).otherwise(raw)
    return F.when(raw == "", F.lit(None).cast("string")).when(raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), bare).when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw)).when(raw.startswith("/"), F.concat(origin, raw)).otherwise(relative)
