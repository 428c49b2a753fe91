"""A content-addressed WARC archive.

An archive is two tables. `payloads` holds every distinct payload once, under its SHA-256.
`records` holds the exact header bytes of every record and the digest of its payload.
Records are put together again by a join on the digest; a payload that is missing, or whose
bytes do not hash to its key, stops the read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecast.llm.common import spread_join

CRLF = "\r\n"
#: Payloads of fewer bytes are always written as responses.
LEAST_REVISIT = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a header line cannot hold, and the mark itself; a second header line tells that a URL was written so.
ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))
ESCAPED = "X-Target-URI-Escaped"


def _field(name: str, value: Column) -> Column:
    """A header line; none if the value is null."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))


def _target(url: Column) -> Column:
    """The header lines of a URL, which say whether its line ends were escaped; none for a null."""
    safe = url
    for plain, written in ESCAPES:
        safe = F.replace(safe, F.lit(plain), F.lit(written))
    told = F.concat(_field("WARC-Target-URI", safe), F.lit(f"{ESCAPED}: percent{CRLF}"))
    return F.coalesce(F.when(url.rlike("[\r\n]"), told).otherwise(_field("WARC-Target-URI", url)), F.lit(""))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2000-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> None:
    """Writes a record for every row of pages.

    Null payloads count as empty. Of equal payloads of at least `least` bytes the row with
    the smallest key is a response (null keys come last; of repeated rows, one) and the
    others are revisits of it; all smaller ones are responses. A null url has no header line.
    Record ids are made of key, digest and a number among rows equal in both.
    """
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    light = rows.select("key", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"))
    firsts = light.groupBy("digest").agg(F.min("key").alias("first"))
    turn = F.row_number().over(Window.partitionBy("digest", "key").orderBy(F.col("url").asc_nulls_last()))
    told = spread_join(light.withColumn("turn", turn), firsts, "digest", "key")
    response = (F.col("bytes") < least) | (F.col("key").eqNullSafe(F.col("first")) & (F.col("turn") == 1))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF)
    )
    block = F.octet_length(http) + F.when(response, F.col("bytes")).otherwise(F.lit(0))
    record = lambda k, n: F.concat(F.lit("<urn:page:"), F.coalesce(k.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(":"), n.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(response, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit(CRLF),
        _field("WARC-Record-ID", record(F.col("key"), F.col("turn"))),
        _field("WARC-Date", F.lit(date)),
        _target(F.col("url").cast("string")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(response, F.lit("")).otherwise(F.concat(_field("WARC-Profile", F.lit(REVISIT_PROFILE)), _field("WARC-Refers-To", record(F.col("first"), F.lit(1))))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _field("Content-Length", block),
        F.lit(CRLF),
        http,
    )
    told.select(F.encode(header, "UTF-8").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/records")
    # every copy of a payload in a task but one is gone before the shuffle
    once = rows.select("digest", "payload").dropDuplicates(["digest"])
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of an archive; an error if a payload does not hash to its digest."""
    found = spark.read.parquet(f"{path}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary"))
    return found.select("digest", verified.alias("payload"))


def headers(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """The fields of every record: key, url, record_type, digest, refers_to, content_length, and its header bytes."""
    found = spark.read.parquet(f"{path}/records")
    text = F.decode("header", "UTF-8")
    field = lambda name, pattern: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {pattern}\r\n", 1), F.lit(""))
    url = F.when(text.contains(f"{CRLF}WARC-Target-URI: "), F.regexp_extract(text, r"\r\nWARC-Target-URI: ([^\r]*)\r\n", 1))
    plain = url
    for was, written in ESCAPES[::-1]:
        plain = F.replace(plain, F.lit(written), F.lit(was))
    return found.select(
        field("WARC-Record-ID", r"<urn:page:([^\r]*?):[0-9a-f]{64}:\d+>").cast(key_type).alias("key"),
        F.when(text.contains(f"{CRLF}{ESCAPED}: percent{CRLF}"), plain).otherwise(url).alias("url"),
        field("WARC-Type", r"([^\r]*)").alias("record_type"),
        field("WARC-Payload-Digest", r"sha256:([0-9a-f]{64})").alias("digest"),
        field("WARC-Refers-To", r"<urn:page:([^\r]*?):[0-9a-f]{64}:\d+>").cast(key_type).alias("refers_to"),
        field("Content-Length", r"(\d+)").cast("long").alias("content_length"),
        "header",
    )


def _met(records: DataFrame, stored: DataFrame) -> DataFrame:
    """records with what is stored under their digest; an error where nothing is."""
    found = spread_join(records, stored.withColumn("__there", F.lit(True)), "digest", "key", "left")
    known = F.when(F.col("__there"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("missing payload "), F.col("digest"))).cast("string"))
    return found.withColumn("digest", known).drop("__there")


def records(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """Every original record's bytes: its headers, the payload of a response, and the closing line ends."""
    whole = _met(headers(spark, path, key_type).select("key", "record_type", "digest", "header"), payloads(spark, path))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return whole.select("key", "record_type", "digest", F.concat("header", body, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))


def catalogue(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """Per record: key, payload_bytes and payload_digest of the full verified payload, record_type, refers_to."""
    stored = payloads(spark, path).select(F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    found = _met(headers(spark, path, key_type).select("key", "digest", "record_type", "refers_to"), stored)
    return found.select("key", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
