"""Board grammar: which board of which applicant-tracking provider a URL belongs to.

Every provider is one Column expression from the URL's host and path to a struct, null
where the URL is none of its boards; a URL's board is the first that is not null.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.text import path_segments, url_encode_component, url_host, url_path

# Names below shared hosts and domains that are not boards.
RESERVED = {
    "lever": ["robots.txt"],
    "greenhouse": ["embed", "jobs", "privacy"],
    "ashby": ["embed", "jobs"],
    "gem": ["api", "favicon.ico", "job_board", "robots.txt", "sitemap.xml"],
    "getro": ["api", "cdn", "cdn-customers", "developers", "help", "talkto", "www"],
    "rippling": ["jobs", "api", "static", "assets", "favicon.ico", "robots.txt"],
    "smartrecruiters": ["api", "static", "assets", "search", "favicon.ico", "robots.txt"],
    "bamboohr": ["api", "app", "blog", "documentation", "help", "partners", "support", "www"],
    "workday": ["job", "jobs", "search", "robots.txt"],
    "icims": ["api", "app", "developer", "help", "login", "support", "www"],
}
#: Crawl targets of the providers: (provider, pattern, query, match type, region).
TARGETS = [
    ("lever", "jobs.lever.co/*", None, None, "global"),
    ("lever", "jobs.eu.lever.co/*", None, None, "eu"),
    ("greenhouse", "*.greenhouse.io/*", "greenhouse.io", "domain", "global"),
    ("ashby", "jobs.ashbyhq.com/*", None, None, "global"),
    ("gem", "jobs.gem.com/*", None, None, "global"),
    ("getro", "*.getro.com/jobs/*", "getro.com", "domain", "global"),
    ("getro", "getro.org/jobs/*", "getro.org", "domain", "global"),
    ("sparkhire", "*.comeet.com/jobs/*", "comeet.com", "domain", "global"),
    ("rippling", "ats.rippling.com/*", None, None, "global"),
    ("smartrecruiters", "jobs.smartrecruiters.com/*", None, None, "global"),
    ("smartrecruiters", "careers.smartrecruiters.com/*", None, None, "global"),
    ("bamboohr", "*.bamboohr.com/careers/*", "bamboohr.com", "domain", "global"),
    ("workday", "*.myworkdayjobs.com/*", "myworkdayjobs.com", "domain", "global"),
    ("workday", "*.myworkdaysite.com/*", "myworkdaysite.com", "domain", "global"),
    ("icims", "*.icims.com/jobs/*", "icims.com", "domain", "global"),
    ("paylocity", "recruiting.paylocity.com/*", None, None, "global"),
]
PROVIDERS = list(dict.fromkeys(t[0] for t in TARGETS))
#: Providers whose identifiers are the same in any case.
CASELESS = ["ashby", "gem", "getro", "sparkhire", "workday"]
SHARED_ID = r"(?i)^[a-z0-9][a-z0-9._-]{0,99}$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def board(provider: str, identifier: Column, board_url: Column, api_url: Column, region: Column | str = "global") -> Column:
    where = region if isinstance(region, Column) else F.lit(region)
    same = F.lower(identifier) if provider in CASELESS else identifier
    return F.struct(
        F.concat_ws(":", F.lit(provider), where, same).alias("key"),
        F.lit(provider).alias("provider"),
        identifier.alias("identifier"),
        where.alias("region"),
        board_url.alias("board_url"),
        api_url.alias("api_url"),
    )


def _at(segments: Column, i: int) -> Column:
    return F.get(segments, F.lit(i))


def _shared(provider: str, hosts: list[str], host: Column, segments: Column, board_url: str, api_url: str, lower: bool = False, region: Column | str = "global") -> Column:
    """A board named by the first path segment of a shared host; {} in the URLs is its identifier."""
    name = F.trim(_at(segments, 0))
    name = F.lower(name) if lower else name
    ok = host.isin(hosts) & name.rlike(SHARED_ID) & ~F.lower(name).isin(RESERVED[provider])
    made = [F.concat(*[x for x in (F.lit(u.split("{}")[0]), url_encode_component(name), F.lit(u.split("{}")[1]))]) for u in (board_url, api_url)]
    return F.when(ok, board(provider, name, *made, region))


def _lever(host: Column, path: Column, s: Column) -> Column:
    world = _shared("lever", ["jobs.lever.co"], host, s, "https://jobs.lever.co/{}", "https://api.lever.co/v0/postings/{}?mode=json")
    europe = _shared("lever", ["jobs.eu.lever.co"], host, s, "https://jobs.eu.lever.co/{}", "https://api.eu.lever.co/v0/postings/{}?mode=json", region="eu")
    return F.coalesce(world, europe)


def _getro(host: Column, path: Column, s: Column) -> Column:
    sub = F.nullif(F.regexp_extract(host, r"^([a-z0-9][a-z0-9-]*)\.getro\.com$", 1), F.lit(""))
    org = host.isin("getro.org", "www.getro.org")
    url = F.concat(F.lit("https://"), F.when(org, F.lit("www.getro.org")).otherwise(host), F.lit("/jobs"))
    name = F.when(org, F.lit("getro.org")).otherwise(sub)
    return F.when(name.isNotNull() & ~name.isin(RESERVED["getro"]), board("getro", name, url, url))


def _sparkhire(host: Column, path: Column, s: Column) -> Column:
    slug, uid = F.lower(_at(s, 1)), _at(s, 2)
    url = F.concat(F.lit("https://www.comeet.com/jobs/"), url_encode_component(slug), F.lit("/"), url_encode_component(uid))
    ok = host.isin("comeet.com", "www.comeet.com") & (F.lower(_at(s, 0)) == "jobs") & (slug != "") & uid.rlike(r"(?i)^[a-z0-9.]+$")
    return F.when(ok, board("sparkhire", F.concat(slug, F.lit("|"), uid), url, url))


def _bamboohr(host: Column, path: Column, s: Column) -> Column:
    name = F.nullif(F.regexp_extract(host, r"^([a-z0-9][a-z0-9-]*)\.bamboohr\.com$", 1), F.lit(""))
    base = F.concat(F.lit("https://"), name, F.lit(".bamboohr.com/careers"))
    return F.when(name.isNotNull() & ~name.isin(RESERVED["bamboohr"]), board("bamboohr", name, base, F.concat(base, F.lit("/list"))))


def _workday(host: Column, path: Column, s: Column) -> Column:
    locale = F.coalesce(_at(s, 0).rlike(r"(?i)^[a-z]{2}-[a-z]{2}$"), F.lit(False))
    # the tenant in the path
    center = F.nullif(F.regexp_extract(host, r"^(wd\d+)\.myworkdaysite\.com$", 1), F.lit(""))
    rest = F.when(locale, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1)))).otherwise(s)
    tenant, site = F.lower(_at(rest, 1)), _at(rest, 2)
    ok = center.isNotNull() & (F.lower(_at(rest, 0)) == "recruiting") & (tenant != "") & (site != "") & ~F.lower(site).isin(RESERVED["workday"])
    base, tail = F.concat(F.lit("https://"), host), F.concat(url_encode_component(tenant), F.lit("/"), url_encode_component(site))
    by_path = F.when(
        ok, board("workday", F.concat_ws("|", tenant, center, site), F.concat(base, F.lit("/recruiting/"), tail), F.concat(base, F.lit("/wday/cxs/"), tail, F.lit("/jobs")))
    )
    # the tenant in the host
    company = F.nullif(F.regexp_extract(host, r"^([^.]+)\.(wd\d+)\.myworkdayjobs\.com$", 1), F.lit(""))
    center = F.regexp_extract(host, r"^([^.]+)\.(wd\d+)\.myworkdayjobs\.com$", 2)
    api = (F.lower(_at(s, 0)) == "wday") & (F.lower(_at(s, 1)) == "cxs")
    site = F.when(F.coalesce(api, F.lit(False)), _at(s, 3)).when(locale, _at(s, 1)).otherwise(_at(s, 0))
    ok = company.isNotNull() & (site != "") & ~F.lower(site).isin(RESERVED["workday"])
    by_host = F.when(
        ok,
        board(
            "workday",
            F.concat_ws("|", company, center, site),
            F.concat(base, F.lit("/"), url_encode_component(site)),
            F.concat(base, F.lit("/wday/cxs/"), url_encode_component(company), F.lit("/"), url_encode_component(site), F.lit("/jobs")),
        ),
    )
    return F.coalesce(by_path, by_host)


def _icims(host: Column, path: Column, s: Column) -> Column:
    name = F.nullif(F.regexp_extract(host, r"^([^.]+)\.icims\.com$", 1), F.lit(""))
    base = F.concat(F.lit("https://"), host)
    ok = name.isNotNull() & F.lower(path).contains("/jobs/") & ~name.isin(RESERVED["icims"])
    return F.when(ok, board("icims", name, F.concat(base, F.lit("/jobs/intro")), F.concat(base, F.lit("/sitemap.xml"))))


def _paylocity(host: Column, path: Column, s: Column) -> Column:
    lower = F.transform(s, lambda x: F.lower(x))
    after = F.get(s, F.when(F.array_position(lower, "all") > 0, F.array_position(lower, "all").cast("int")))
    name = F.coalesce(after, F.get(F.filter(s, lambda x: x.rlike(UUID)), F.lit(0)))
    url = F.concat(F.lit("https://recruiting.paylocity.com/recruiting/jobs/All/"), url_encode_component(name), F.lit("/"))
    return F.when((host == "recruiting.paylocity.com") & name.rlike(UUID), board("paylocity", F.lower(name), url, url))


def _shared_hosts(provider: str, hosts: list[str], board_url: str, api_url: str, lower: bool = False):
    return lambda host, path, s: _shared(provider, hosts, host, s, board_url, api_url, lower)


GRAMMAR = {
    "lever": _lever,
    "greenhouse": _shared_hosts("greenhouse", ["boards.greenhouse.io", "job-boards.greenhouse.io"], "https://job-boards.greenhouse.io/{}", "https://boards-api.greenhouse.io/v1/boards/{}/jobs"),
    "ashby": _shared_hosts("ashby", ["jobs.ashbyhq.com"], "https://jobs.ashbyhq.com/{}", "https://api.ashbyhq.com/posting-api/job-board/{}"),
    "gem": _shared_hosts("gem", ["jobs.gem.com"], "https://jobs.gem.com/{}", "https://api.gem.com/job_board/v0/{}/job_posts/", True),
    "getro": _getro,
    "sparkhire": _sparkhire,
    "rippling": _shared_hosts("rippling", ["ats.rippling.com"], "https://ats.rippling.com/{}/jobs", "https://api.rippling.com/platform/api/ats/v1/board/{}/jobs"),
    "smartrecruiters": _shared_hosts("smartrecruiters", ["jobs.smartrecruiters.com", "careers.smartrecruiters.com"], "https://jobs.smartrecruiters.com/{}", "https://api.smartrecruiters.com/v1/companies/{}/postings"),
    "bamboohr": _bamboohr,
    "workday": _workday,
    "icims": _icims,
    "paylocity": _paylocity,
}


def parse_board(url: Column, hint: str | None = None) -> Column:
    """The board that a URL belongs to, as a struct; null if it is none. hint: look for this provider only."""
    if hint is not None and hint not in GRAMMAR:
        raise ValueError(f"unsupported provider: {hint}")
    host, path, segments = url_host(url), url_path(url), path_segments(url)
    names = [hint] if hint else list(GRAMMAR)
    return F.coalesce(*[GRAMMAR[n](host, path, segments) for n in names])


def with_board(frame: DataFrame, url: str, name: str = "board", hint: str | None = None) -> DataFrame:
    """frame with the board of a URL column; host, path and segments are made once for all providers."""
    if hint is not None and hint not in GRAMMAR:
        raise ValueError(f"unsupported provider: {hint}")
    u, parts = F.col(url), ("__host", "__path", "__segments")
    cut = frame.withColumns(dict(zip(parts, (url_host(u), url_path(u), path_segments(u)))))
    found = F.coalesce(*[GRAMMAR[n](*map(F.col, parts)) for n in ([hint] if hint else GRAMMAR)])
    return cut.withColumn(name, found).drop(*parts)
