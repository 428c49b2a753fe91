"""The faceted job query: a request turned into predicates, two plans and a cursor.

The page and the count share one filtered parent; the count never sees the cursor or the
display joins. Nothing here collects but the last page's final row, from which the next
cursor is made.
"""

import base64
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.classify import country_flag
from rolecast.functions.text import PROVIDER_LABELS, hash32, humanize_identifier, index_text, initials, provider_label, unaccented

SET_LIMIT, LIKE_LIMIT, TITLE_LIMIT = 12, 48, 60
#: Sets of a request: parameter -> column.
SETS = {
    "city": "city", "role_family": "role_family", "industry": "company_industry", "workplace": "workplace", "category": "category",
    "employment_type": "employment_type",
}
COLOURS = 8


@dataclass(frozen=True)
class JobQuery:
    """What a caller can ask for. search: "substring" (local) or "fts" (production); likes: "escaped" or "raw" (a caller's % and _ are wildcards)."""

    search: str | None = None
    location: str | None = None
    company: str | None = None
    title: str | None = None
    country: str | None = None
    city: str | None = None
    role_family: str | None = None
    industry: str | None = None
    provider: str | None = None
    workplace: str | None = None
    category: str | None = None
    employment_type: str | None = None
    posted_within: str | int | None = None
    sort: str = "newest"
    limit: str | int | None = None
    offset: str | int | None = None
    cursor: str | None = None
    search_mode: str = "substring"
    likes: str = "escaped"
    now: str | None = field(default=None, compare=False)


def clamp(value: str | int | None, fallback: int, least: int, most: int) -> int:
    """The integer that a text begins with, within bounds; the fallback without one."""
    import re

    found = re.match(r"\s*([+-]?\d+)", str(value if value is not None else ""))
    return min(most, max(least, int(found[1]))) if found else fallback


def set_values(text: str | None, normalise=lambda v: v) -> list[str]:
    """At most twelve values of a comma-separated list, trimmed, blanks dropped."""
    parts = [p.strip() for p in str(text if text is not None else "").split(",")]
    return [normalise(p) for p in [p for p in parts if p][:SET_LIMIT]]


def contains(column: Column, term: str) -> Column:
    """Case-blind substring match of a literal term."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def like_raw(column: Column, term: str | None) -> Column | None:
    """Match of a trimmed term of at most 48 characters whose % and _ are wildcards."""
    wanted = (term or "").strip().lower()[:LIKE_LIMIT]
    return F.lower(column).like("%" + wanted.replace("\\", "\\\\") + "%") if wanted else None


def fts_match(query: str, *columns: Column) -> Column | None:
    """Whether every search token begins some run of words: tokens that hold marks are phrases, the last word a prefix."""
    import re

    tokens = re.findall(r"[^\W_][\w.+#-]*", unaccented(query.strip()))[:8]
    if not tokens:
        return None
    found = None
    for token in tokens:
        words = " " + " ".join(re.findall(r"[^\W_]+", token))
        if words == " ":
            continue
        in_any = None
        for column in columns:
            hit = F.contains(index_text(F.coalesce(column, F.lit(""))), F.lit(words))
            in_any = hit if in_any is None else in_any | hit
        found = in_any if found is None else found & in_any
    return found


def company_name() -> Column:
    return F.coalesce("company_name", "company_identifier")


def predicates(q: JobQuery) -> list[Column]:
    """The request as a conjunction."""
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = [F.col("is_active") == 1]
    if q.search and q.search_mode == "fts":
        out.append(fts_match(q.search, F.col("title"), F.col("company_identifier"), F.col("company_name"), F.col("location")))
    elif q.search:
        out.append(contains(F.concat("title", F.lit(" "), "company_identifier", F.lit(" "), col("company_name"), F.lit(" "), col("department")), q.search))
    for value, column in ((q.location, col("location")), (q.company, company_name()), (q.title, F.col("title"))):
        if value:
            out.append(contains(column, value) if q.likes == "escaped" else like_raw(column, value))
    if q.country == "anywhere":
        out.append(F.col("country").isNull() & (F.col("workplace") == "Remote"))
    elif found := set_values(q.country, str.lower):
        out.append(F.col("country").isin(found))
    labels = {v.lower(): k for k, v in PROVIDER_LABELS.items()}
    if found := set_values(q.provider, lambda v: labels.get(v.lower(), "".join(v.lower().split()))):
        out.append(F.col("provider").isin(found))
    for name, column in SETS.items():
        if found := set_values(getattr(q, name)):
            out.append(F.col(column).isin(found))
    days = clamp(q.posted_within, 0, 0, 3650)
    if days > 0:
        now = F.to_timestamp(F.lit(q.now)) if q.now else F.current_timestamp()
        # dates are ISO texts and the bound is not, so the whole day of the bound passes
        out.append(F.col("published_at") >= F.date_format(now - F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd HH:mm:ss"))
    return [p for p in out if p is not None]


def sort_key(sort: str) -> Column:
    return F.lower(company_name()) if sort == "company" else F.coalesce("published_at", F.lit(""))


def ordering(sort: str) -> list[Column]:
    key = sort_key(sort)
    return [key.desc() if sort not in ("oldest", "company") else key.asc(), F.col("key").asc()]


def after(sort: str, value: str, key: str) -> Column:
    """Rows behind a keyset cursor."""
    mine = sort_key(sort)
    beyond = mine < F.lit(value) if sort not in ("oldest", "company") else mine > F.lit(value)
    return beyond | ((mine == F.lit(value)) & (F.col("key") > F.lit(key)))


def encode_cursor(**parts) -> str:
    return base64.b64encode(json.dumps(parts, separators=(",", ":"), ensure_ascii=False).encode()).decode()


def decode_cursor(text: str | None) -> dict:
    """The parts of a cursor; none if it is not one."""
    try:
        found = json.loads(base64.b64decode(text or "", validate=False).decode())
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def filtered(jobs: DataFrame, q: JobQuery) -> DataFrame:
    return jobs.where(reduce(lambda a, b: a & b, predicates(q)))


def total(jobs: DataFrame, q: JobQuery) -> DataFrame:
    """One row: how many postings match, whatever the page."""
    return filtered(jobs, q).agg(F.count("*").alias("total"))


def page(jobs: DataFrame, q: JobQuery, mode: str = "offset") -> DataFrame:
    """The page of matching postings. mode: "offset" or "keyset"; a cursor that is none is ignored."""
    found, cursor = filtered(jobs, q), decode_cursor(q.cursor)
    if mode == "keyset":
        if isinstance(cursor.get("value"), str) and isinstance(cursor.get("key"), str):
            found = found.where(after(q.sort, cursor["value"], cursor["key"]))
        return found.orderBy(*ordering(q.sort)).limit(clamp(q.limit, 100, 1, 100))
    start = cursor.get("offset")
    start = start if isinstance(start, int) and start >= 0 else clamp(q.offset, 0, 0, 1_000_000)
    return found.orderBy(*ordering(q.sort)).offset(start).limit(clamp(q.limit, 50, 1, 100))


def next_cursor(rows: DataFrame, q: JobQuery) -> str | None:
    """The keyset cursor behind a full page."""
    limit = clamp(q.limit, 100, 1, 100)
    last = rows.select(sort_key(q.sort).alias("value"), "key").collect()
    return encode_cursor(value=last[-1].value, key=last[-1].key) if len(last) == limit else None


def with_logos(rows: DataFrame, boards: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings with their own logo, else their company's. The joins keep every posting; Spark picks how, by size."""
    b = boards.select(F.col("key").alias("board_key"), "company_key")
    c = companies.select(F.col("key").alias("company_key"), F.col("logo_url").alias("__logo"))
    joined = rows.join(b, "board_key", "left").join(c, "company_key", "left")
    return joined.withColumn("company_logo_url", F.coalesce("company_logo_url", "__logo")).drop("__logo", "company_key")


def public_jobs(rows: DataFrame, categories: list[str] | None = None, description: bool = True) -> DataFrame:
    """Postings as callers see them. categories: any other is shown as Other."""
    company = F.coalesce(F.nullif("company_name", F.lit("")), humanize_identifier(F.col("company_identifier"), F.col("provider")))
    category = F.col("category") if categories is None else F.when(F.col("category").isin(categories), F.col("category")).otherwise("Other")
    return rows.select(
        F.col("key").alias("id"), "title", company.alias("company"), initials(company).alias("company_mark"),
        F.nullif("company_logo_url", F.lit("")).alias("company_logo_url"), (hash32(company) % COLOURS).alias("company_colour"),
        F.coalesce(F.nullif("location", F.lit("")), F.lit("Location not specified")).alias("location"), "country", "city", "role_family",
        "company_industry", country_flag(F.col("country")).alias("country_flag"), "workplace", "employment_type", category.alias("category"),
        provider_label(F.col("provider")).alias("source"), "published_at",
        (F.coalesce("description_plain", F.lit("")) if description else F.lit("")).alias("description"),
        F.array().cast("array<string>").alias("skills"), "url",
    )


def title_counts(jobs: DataFrame) -> DataFrame:
    """Active postings by title, without null and empty titles."""
    return jobs.where("is_active = 1 and title is not null and title <> ''").groupBy("title").agg(F.count("*").alias("job_count"))


def suggest_titles(counts: DataFrame, query: str | None, limit: int = 8) -> DataFrame:
    """Titles that hold the query, those that begin with it first, then the commonest, then by title."""
    term = (query or "").strip().lower()[:TITLE_LIMIT]
    if len(term) < 2:
        return counts.limit(0)
    begins = F.when(F.startswith(F.lower("title"), F.lit(term)), 0).otherwise(1)
    return counts.where(contains(F.col("title"), term)).orderBy(begins, F.desc("job_count"), "title").limit(min(20, max(1, limit)))


def stats(jobs: DataFrame, boards: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: active_jobs, closed_jobs, active_boards, last_synced_at."""
    j = jobs.agg(F.count_if(F.col("is_active") == 1).alias("active_jobs"), F.count_if(F.col("is_active") == 0).alias("closed_jobs"))
    b = boards.agg(F.count_if(F.col("status") == "active").alias("active_boards"))
    return j.join(b).join(runs.agg(F.max("synced_at").alias("last_synced_at")))

