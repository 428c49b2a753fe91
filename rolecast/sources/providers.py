"""Provider payloads normalised into one posting schema.

Input rows are staged responses: a board (key, provider, identifier, region, board_url,
api_url), the response body and synced_at. A provider is an envelope, which cuts a body
into items, and a mapping of an item's fields; what they share is one projection. A body
that is not what its provider sends makes the board invalid instead of yielding items.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecast.functions import classify, text
from rolecast.functions.text import clean_string, first_text, from_millis, from_seconds, iso_timestamp, join_present, last_path_segment, url_encode_component

BOARD = ["key", "provider", "identifier", "region", "board_url", "api_url"]


def field(item: Column, path: str) -> Column:
    return F.get_json_object(item, f"$.{path}")


def names(item: Column, path: str, part: str = "name") -> Column:
    """A part of every object of an array, joined."""
    found = F.from_json(field(item, path), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    return F.nullif(join_present(F.transform(found, lambda x: x[part])), F.lit(""))


def strings(item: Column, *paths: str) -> Column:
    """An array of strings, joined, or a plain string; the first of the paths that is there."""
    raw = F.coalesce(*[field(item, p) for p in paths])
    listed = F.from_json(raw, T.ArrayType(T.StringType()))
    return F.when(raw.startswith("["), join_present(listed)).otherwise(raw)


def number(item: Column, *paths: str) -> Column:
    """A JSON number; null for anything else."""
    return F.coalesce(*[field(item, p).try_cast("double") for p in paths])


def items_at(body: Column, path: str | None) -> Column:
    """The elements of the array at a path of a JSON body, as JSON; null if there is no such array."""
    valid = F.try_parse_json(body).isNotNull()
    raw = F.when(valid, F.get_json_object(body, f"$.{path}" if path else "$"))
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, T.ArrayType(T.StringType())))


def with_script_data(frame: DataFrame) -> DataFrame:
    """frame with __company and __positions: two script variables of a page, whose literals end where their brackets match, which no regular expression can tell."""
    fields = T.StructType([*frame.schema.fields, T.StructField("__company", T.StringType()), T.StructField("__positions", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            found = [pa.array([text.assigned_json(b, name) for b in bodies], pa.string()) for name in ("COMPANY_DATA", "COMPANY_POSITIONS_DATA")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=fields.names)

    return frame.mapInArrow(run, fields)


def icims_items(body: Column) -> Column:
    """The jobs of a sitemap: their URLs hold id and title."""
    blocks = F.regexp_extract_all(body, F.lit(r"(?i)<url>([\s\S]*?)</url>"), 1)

    def entry(block: Column) -> Column:
        url = text.decode_xml(F.regexp_extract(block, r"(?i)<loc>([\s\S]*?)</loc>", 1))
        segments = text.path_segments(url)
        at = F.array_position(F.transform(segments, lambda s: F.lower(s)), "jobs").cast("int")
        job = F.struct(
            F.get(segments, at).alias("id"),
            text.title_from_slug(F.get(segments, at + 1)).alias("title"),
            url.alias("url"),
            text.decode_xml(F.regexp_extract(block, r"(?i)<lastmod>([\s\S]*?)</lastmod>", 1)).alias("updatedAt"),
        )
        wanted = url.rlike("(?i)/jobs/") & ~url.rlike(r"(?i)/jobs/(?:intro)?/?$") & (at > 0) & (F.get(segments, at) != "") & (F.get(segments, at + 1) != "")
        return F.when(wanted, F.to_json(job))

    found = F.filter(F.transform(blocks, entry), lambda x: x.isNotNull())
    return F.when(body.rlike(r"(?i)<(?:urlset|sitemapindex)(?:\s|>)"), found)


def paylocity_items(body: Column) -> Column:
    strict = F.nullif(F.regexp_extract(body, r"(?i)window\.pageData\s*=\s*(\{[\s\S]*?\})\s*;</script>", 1), F.lit(""))
    loose = F.nullif(F.regexp_extract(body, r"(?i)window\.pageData\s*=\s*(\{[\s\S]*?\})\s*;", 1), F.lit(""))
    return items_at(F.coalesce(strict, loose), "Jobs")


def sparkhire_items(body: Column) -> Column:
    """Positions, each with its company's name and logo."""
    company = F.col("__company")
    logo = F.coalesce(field(company, "logos.small.url"), field(company, "logos.medium.url"))
    extra = F.to_json(F.struct(field(company, "name").alias("__company"), logo.alias("__logo")))
    found = items_at(F.col("__positions"), None)
    return F.when(company.isNotNull(), F.transform(found, lambda p: F.concat(F.substring(extra, F.lit(1), F.length(extra) - 1), F.when(extra == "{}", F.lit("")).otherwise(F.lit(",")), F.ltrim(F.substring(F.trim(p), F.lit(2), F.length(p))))))


@dataclass(frozen=True)
class Provider:
    items: Callable[[Column], Column]
    fields: Callable[[Column, Callable[[str], Column]], dict[str, Column]]
    #: Distinguishes repeated items of paged bodies; null: not told apart.
    same: Callable[[Column], Column] | None = None


def _lever(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    return {
        "source_id": f("id"), "title": f("text"), "location": f("categories.location"), "workplace": classify.workplace(f("workplaceType")),
        "employment_type": f("categories.commitment"), "department": first_text(f("categories.department"), f("categories.team")),
        "description": first_text(f("descriptionPlain"), f("descriptionBodyPlain"), f("openingPlain")), "published_at": from_millis(number(i, "createdAt").cast("bigint")),
        "url": f("hostedUrl"), "apply_url": f("applyUrl"), "compensation": F.coalesce(f("salaryRange"), f("salaryDescriptionPlain")),
    }


def _greenhouse(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    meta = F.from_json(f("metadata"), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    told = lambda pattern: F.get(F.filter(meta, lambda m: m["name"].rlike(pattern)), F.lit(0))["value"]
    return {
        "source_id": f("id"), "title": f("title"), "location": f("location.name"), "workplace": classify.workplace(_plain(told("(?i)workplace"))),
        "employment_type": _plain(told("(?i)employment|commitment")), "department": names(i, "departments"), "description": text.strip_html(f("content")),
        "published_at": f("updated_at"), "url": f("absolute_url"), "apply_url": f("absolute_url"),
    }


def _plain(value: Column) -> Column:
    """A string, or the elements of a JSON array of strings with spaces between."""
    return F.when(value.startswith("["), F.array_join(F.from_json(value, T.ArrayType(T.StringType())), " ")).otherwise(value)


def _ashby(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    remote = F.when(f("isRemote") == "true", F.lit("Remote"))
    return {
        "source_id": first_text(f("id"), last_path_segment(f("jobUrl")), last_path_segment(f("applyUrl"))), "title": f("title"), "location": f("location"),
        "workplace": classify.workplace(first_text(f("workplaceType"), remote)), "employment_type": text.employment_type(f("employmentType")),
        "department": first_text(f("department"), f("team")), "description": f("descriptionPlain"), "published_at": f("publishedAt"),
        "url": f("jobUrl"), "apply_url": f("applyUrl"), "compensation": f("compensation"),
    }


def _gem(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    offices = F.from_json(f("offices"), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    places = F.nullif(join_present(F.transform(offices, lambda o: first_text(F.get_json_object(o["location"], "$.name"), o["name"]))), F.lit(""))
    location = first_text(f("location.name"), places)
    return {
        "source_id": first_text(f("id"), f("internal_job_id"), last_path_segment(f("absolute_url"))), "title": f("title"), "location": location,
        "workplace": classify.workplace(F.concat(F.coalesce(f("location_type"), F.lit("")), F.lit(" "), F.coalesce(location, F.lit("")))),
        "employment_type": text.employment_type(f("employment_type")), "department": names(i, "departments"),
        "description": first_text(f("content_plain"), text.strip_html(f("content"))), "published_at": first_text(f("first_published_at"), f("updated_at"), f("created_at")),
        "url": f("absolute_url"), "apply_url": f("absolute_url"),
    }


def _getro(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    slug, job = clean_string(f("organization.slug")), clean_string(f("slug"))
    origin = F.regexp_extract(b("board_url"), r"^(https?://[^/]+)", 1)
    built = F.concat(origin, F.lit("/companies/"), url_encode_component(slug), F.lit("/jobs/"), url_encode_component(job))
    url = first_text(f("url"), built, b("board_url"))
    least, most = number(i, "compensation_amount_min_cents", "compensationAmountMinCents"), number(i, "compensation_amount_max_cents", "compensationAmountMaxCents")
    paid = F.to_json(
        F.struct(
            F.coalesce(f("compensation_currency"), f("compensationCurrency")).alias("currency"),
            F.coalesce(f("compensation_period"), f("compensationPeriod")).alias("interval"),
            _whole(least / 100).alias("min"), _whole(most / 100).alias("max"),
        )
    )
    shown = (F.coalesce(f("compensation_public"), f("compensationPublic")) == "true") & (least.isNotNull() | most.isNotNull())
    return {
        "source_id": first_text(f("id"), job, f("url")), "company_name": f("organization.name"), "company_logo_url": first_text(f("organization.logo_url"), f("organization.logoUrl")),
        "title": f("title"), "location": strings(i, "locations", "searchable_locations", "searchableLocations"), "workplace": classify.workplace(first_text(f("work_mode"), f("workMode"))),
        "employment_type": text.employment_type(first_text(f("employment_type"), f("employmentType"))), "department": strings(i, "job_functions", "jobFunctions"),
        "published_at": from_seconds(number(i, "created_at", "createdAt")), "url": url, "apply_url": url, "compensation": F.when(shown, paid),
    }


def _whole(value: Column) -> Column:
    """A number as JSON text writes it: no point for whole ones."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def _sparkhire(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    details = F.from_json(f("custom_fields.details"), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    html = F.nullif(F.array_join(F.filter(F.transform(details, lambda d: d["value"]), lambda v: v.isNotNull() & (v != "")), "\n"), F.lit(""))
    remote = F.when(f("location.is_remote") == "true", F.lit("Remote"))
    return {
        "source_id": first_text(f("uid"), last_path_segment(f("url_comeet_hosted_page"))), "company_name": first_text(f("company_name"), f("__company")), "company_logo_url": f("__logo"),
        "title": f("name"), "location": first_text(f("location.display_name"), f("location.name")), "workplace": classify.workplace(first_text(f("workplace_type"), remote)),
        "employment_type": text.employment_type(f("employment_type")), "department": f("department"), "description": text.strip_html(html), "published_at": f("time_updated"),
        "url": first_text(f("url_comeet_hosted_page"), f("url_recruit_hosted_page"), f("url_active_page")), "apply_url": first_text(f("url_active_page"), f("url_comeet_hosted_page")),
    }


def _beside(*values: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(v, F.lit("")) for v in values])


def _bamboohr(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    parts = F.nullif(F.array_join(F.filter(F.array(f("location.city"), f("location.state"), f("location.country")), lambda v: v.isNotNull() & (v != "")), ", "), F.lit(""))
    location = F.when(f("location").startswith("{"), parts).otherwise(f("location"))
    url = F.concat(F.lit("https://"), b("identifier"), F.lit(".bamboohr.com/careers/"), url_encode_component(F.coalesce(f("id"), F.lit("undefined"))))
    return {
        "source_id": f("id"), "title": f("jobOpeningName"), "location": location, "workplace": classify.workplace(_beside(location, f("jobOpeningName"))),
        "employment_type": f("employmentStatusLabel"), "department": f("departmentLabel"), "description": f("description"), "published_at": f("datePosted"), "url": url, "apply_url": url,
    }


def _workday(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    base, path = F.regexp_replace(b("board_url"), "/$", ""), F.coalesce(clean_string(f("externalPath")), F.lit(""))
    url = F.concat(base, F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("/")), path)
    return {
        "source_id": first_text(last_path_segment(url), path), "title": f("title"), "location": f("locationsText"), "workplace": classify.workplace(_beside(f("locationsText"), f("title"))),
        "employment_type": f("timeType"), "department": f("jobFamily"), "published_at": text.relative_date(f("postedOn"), b("synced_at")), "url": url, "apply_url": url,
        "company_logo_url": F.concat(base, F.lit("/assets/logo")),
    }


def _rippling(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    location = clean_string(f("workLocation.label"))
    return {
        "source_id": f("uuid"), "title": f("name"), "location": location, "workplace": classify.workplace(_beside(location, f("name"))),
        "employment_type": f("employmentType.label"), "department": f("department.label"),
        "url": first_text(f("url"), F.concat(b("board_url"), F.lit("/"), url_encode_component(F.coalesce(f("uuid"), F.lit("undefined"))))), "apply_url": f("url"),
    }


def _smartrecruiters(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    location = text.join_distinct(f("location.city"), f("location.region"), F.upper(f("location.country")))
    place = F.when(f("location.remote") == "true", F.lit("Remote")).when(f("location.hybrid") == "true", F.lit("Hybrid")).otherwise(classify.workplace(location))
    return {
        "source_id": f("id"), "title": f("name"), "company_name": f("company.name"), "location": location, "workplace": place,
        "employment_type": f("typeOfEmployment.label"), "department": F.coalesce(f("department.label"), f("function.label")), "native_industry": F.coalesce(f("industry.id"), f("industry.label")),
        "published_at": f("releasedDate"), "url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), url_encode_component(b("identifier")), F.lit("/"), url_encode_component(F.coalesce(f("id"), F.lit("undefined")))),
    }


def _icims(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    return {"source_id": f("id"), "title": f("title"), "workplace": F.lit("Unspecified"), "published_at": f("updatedAt"), "url": f("url"), "apply_url": f("url")}


def _paylocity(i: Column, b) -> dict[str, Column]:
    f = lambda p: field(i, p)
    parts = F.nullif(F.array_join(F.filter(F.array(f("JobLocation.City"), f("JobLocation.State")), lambda v: v.isNotNull() & (v != "")), ", "), F.lit(""))
    location, job = first_text(parts, f("LocationName")), first_text(f("JobId"))
    url = F.coalesce(F.concat(F.lit("https://recruiting.paylocity.com/recruiting/Jobs/Details/"), url_encode_component(job)), b("board_url"))
    return {
        "source_id": F.coalesce(job, F.concat(F.coalesce(f("JobTitle"), F.lit("undefined")), F.lit("|"), F.coalesce(location, F.lit("undefined")))), "title": text.decode_html(f("JobTitle")),
        "location": text.decode_html(location), "workplace": F.when(f("IsRemote") == "true", F.lit("Remote")).otherwise(classify.workplace(_beside(location, f("JobTitle")))),
        "employment_type": f("EmploymentType"), "department": text.decode_html(f("HiringDepartment")), "published_at": f("PublishedDate"), "url": url, "apply_url": url,
    }


def _listed(body: Column) -> Column:
    return F.filter(items_at(body, "jobs"), lambda i: F.coalesce(field(i, "isListed"), F.lit("true")) != "false")


def _at(path: str | None) -> Callable[[Column], Column]:
    return lambda body: items_at(body, path)


PROVIDERS = {
    "lever": Provider(_at(None), _lever),
    "greenhouse": Provider(_at("jobs"), _greenhouse),
    "ashby": Provider(_listed, _ashby),
    "gem": Provider(_at(None), _gem),
    "getro": Provider(_at("results.jobs"), _getro, lambda i: first_text(clean_string(field(i, "id")), clean_string(field(i, "slug")), clean_string(field(i, "url")))),
    "sparkhire": Provider(sparkhire_items, _sparkhire),
    "rippling": Provider(_at(None), _rippling),
    "smartrecruiters": Provider(_at("content"), _smartrecruiters),
    "bamboohr": Provider(_at("result"), _bamboohr),
    "workday": Provider(
        _at("jobPostings"), _workday, lambda i: F.coalesce(clean_string(field(i, "externalPath")), F.concat(F.coalesce(clean_string(field(i, "title")), F.lit("")), F.lit("|"), F.coalesce(clean_string(field(i, "locationsText")), F.lit(""))))
    ),
    "icims": Provider(icims_items, _icims),
    "paylocity": Provider(paylocity_items, _paylocity),
}


def compensation(value: Column) -> Column:
    """A payload's compensation as JSON text: a summary of at most 500 units, or what it has of currency, interval, min and max."""
    kind = F.substring(F.ltrim(value), 1, 1)
    summary = first_text(field(value, "compensationTierSummary"), field(value, "scrapeableCompensationSalarySummary"))
    numeric = lambda c: F.when(F.schema_of_variant(F.try_parse_json(F.coalesce(F.get_json_object(value, f"$.{c}"), F.lit("null")))).isin("VOID"), F.lit(None).cast("string")).otherwise(F.get_json_object(value, f"$.{c}"))
    parts = F.struct(*[numeric(c).alias(c) for c in ("currency", "interval", "min", "max")])
    text_of = F.to_json(parts)
    subset = F.regexp_replace(F.when(text_of != "{}", text_of), r'"(min|max)":"(-?[0-9.eE+]+)"', '"$1":$2')
    return F.when(first_text(value).isNull(), F.lit(None).cast("string")).when(kind != "{", F.to_json(F.array(text.truncate(value, 500)))).when(summary.isNotNull(), F.to_json(F.array(text.truncate(summary, 500)))).otherwise(subset)


def _assemble(items: DataFrame, name: str) -> DataFrame:
    """The projection that all providers share."""
    own = PROVIDERS[name].fields(F.col("item"), lambda c: F.col(f"__{c}"))
    v = lambda c: own.get(c, F.lit(None).cast("string"))
    raw = items.select(
        "__key", "__provider", "__identifier", "__synced_at",
        *[v(c).alias(f"v_{c}") for c in ("source_id", "company_name", "company_logo_url", "title", "location", "workplace", "employment_type", "department", "native_industry", "description", "published_at", "url", "apply_url", "compensation")],
    )
    c = lambda name: clean_string(F.col(f"v_{name}"))
    base = raw.withColumn("source_id", F.coalesce(c("source_id"), text.stable_fallback_id(F.col("v_title"), F.col("v_location"), F.col("v_url"))))
    base = base.withColumn("title", F.coalesce(c("title"), F.lit("Untitled role"))).withColumn("role_family", classify.role_family(F.col("title"))).withColumn("url", F.coalesce(c("url"), c("apply_url")))
    bare = F.col("v_compensation")
    listed = compensation(bare)
    return base.select(
        F.concat("__key", F.lit(":"), "source_id").alias("key"), "source_id", F.col("__key").alias("board_key"), F.col("__provider").alias("provider"), F.col("__identifier").alias("company_identifier"),
        c("company_name").alias("company_name"), c("company_logo_url").alias("company_logo_url"), "title", c("location").alias("location"),
        classify.location_country(F.col("v_location")).alias("country"), classify.location_city(F.col("v_location")).alias("city"), "role_family",
        classify.industry(F.coalesce(c("company_name"), F.col("__identifier")), F.col("role_family"), F.col("v_native_industry")).alias("company_industry"),
        F.coalesce(F.nullif("v_workplace", F.lit("")), F.lit("Unspecified")).alias("workplace"), c("employment_type").alias("employment_type"), c("department").alias("department"),
        classify.category(F.col("title"), c("department")).alias("category"), text.truncate(c("description"), 4000).alias("description_plain"),
        iso_timestamp(F.col("v_published_at")).alias("published_at"), "url", F.coalesce(c("apply_url"), F.col("url")).alias("apply_url"),
        F.when(listed.startswith("["), F.regexp_replace(listed, r"^\[|\]$", "")).otherwise(listed).alias("compensation_json"), F.col("__synced_at").alias("synced_at"),
    )


def _items(staged: DataFrame, name: str) -> DataFrame:
    held = [F.col(c).alias(f"__{c}") for c in (*BOARD, "synced_at")]
    page = F.col("page") if "page" in staged.columns else F.lit(0)
    mine = staged.where(F.col("provider") == name)
    mine = with_script_data(mine) if name == "sparkhire" else mine
    return mine.select(*held, page.alias("__page"), PROVIDERS[name].items(F.col("body")).alias("items"))


def normalise(staged: DataFrame, provider: str) -> DataFrame:
    """The postings in a provider's staged responses. Items that pages repeat count once; those that cannot be told apart by anything are dropped where the provider tells them apart."""
    # an outer generator gets no inferred filter on its array, which would parse each body again
    found = _items(staged, provider).select("*", F.posexplode_outer("items").alias("__at", "item")).drop("items").where("__at is not null")
    same = PROVIDERS[provider].same
    if same is not None:
        from rolecast.operators.snapshots import keep_first

        found = keep_first(found.withColumn("__same", same(F.col("item"))).where("__same is not null"), ["__key", "__same"], "__page", "__at").drop("__same")
    return _assemble(found, provider)


def normalise_all(staged: DataFrame, providers: list[str] | None = None) -> DataFrame:
    out = None
    for name in providers or PROVIDERS:
        one = normalise(staged, name)
        out = one if out is None else out.unionByName(one)
    return out


def board_results(staged: DataFrame, providers: list[str] | None = None) -> DataFrame:
    """Per board of staged responses: status, job_count and sample titles. A wrong body is invalid, unless the request failed for now.

    staged may have http_status; a failed request has no body.
    """
    code = F.col("http_status") if "http_status" in staged.columns else F.lit(200)
    out = None
    for name in providers or PROVIDERS:
        cut = _items(staged, name).withColumn("n", F.size("items"))
        codes = staged.where(F.col("provider") == name).groupBy(F.col("key").alias("__key")).agg(F.max(code).alias("__code"))
        one = cut.groupBy("__key", "__provider", "__identifier", "__synced_at").agg(F.sum(F.when(F.col("items").isNotNull(), F.col("n")).otherwise(0)).alias("job_count"), F.max(F.col("items").isNull()).alias("wrong")).join(codes, "__key")
        failed = F.col("wrong") | (F.col("__code") >= 400)
        status = classify.board_status(F.col("job_count"), F.col("__code"), F.col("wrong") & (F.col("__code") < 400), failed)
        one = one.select(F.col("__key").alias("key"), F.col("__provider").alias("provider"), F.col("__identifier").alias("identifier"), status.alias("status"), F.when(failed, 0).otherwise(F.col("job_count")).cast("bigint").alias("job_count"), F.col("__synced_at").alias("synced_at"), F.when(failed, F.concat(F.lit("HTTP "), F.col("__code").cast("string"))).alias("error"))
        out = one if out is None else out.unionByName(one)
    return out
