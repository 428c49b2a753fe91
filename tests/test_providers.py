import json

import pytest
from pyspark.sql import functions as F

from rolecast.functions import text
from rolecast.functions.grammar import parse_board
from rolecast.sources import paged, providers

AT = "2026-07-20T12:00:00.000Z"


def staged(spark, *rows):
    schema = "key string, provider string, identifier string, region string, board_url string, api_url string, page int, body string, http_status int, synced_at string"
    return spark.createDataFrame([(f"{p}:global:{i}", p, i, "global", url, url, page, body if body is None or isinstance(body, str) else json.dumps(body), code, AT) for p, i, url, page, body, code in rows], schema)


def one(spark, provider, body, identifier="example", url="https://boards.test/example"):
    return [r.asDict() for r in providers.normalise(staged(spark, (provider, identifier, url, 0, body, 200)), provider).collect()]


def test_ashby_keeps_listed_jobs(spark):
    job = {"title": "Engineer", "location": "Remote", "workplaceType": "Remote", "employmentType": "FullTime", "department": "R&D", "descriptionPlain": "Build", "publishedAt": "2026-07-20T10:00:00.000Z", "jobUrl": "https://jobs.ashbyhq.com/example/job-123", "applyUrl": "https://jobs.ashbyhq.com/example/job-123/apply", "isListed": True}
    found = one(spark, "ashby", {"jobs": [job, job | {"isListed": False, "jobUrl": "https://jobs.ashbyhq.com/example/other"}]})
    assert [f["key"] for f in found] == ["ashby:global:example:job-123"]
    assert (found[0]["employment_type"], found[0]["category"], found[0]["workplace"], found[0]["published_at"]) == ("Full-Time", "Engineering", "Remote", "2026-07-20T10:00:00.000Z")


def test_gem(spark):
    job = {"id": 7, "title": "Designer", "first_published_at": "2026-07-20", "content_plain": "text", "departments": [{"id": 1, "name": "Design"}, {"name": None}, {"name": "Brand"}], "offices": [{"name": "HQ", "location": {"name": "Paris"}}, {"name": "Lyon"}], "location_type": "remote", "employment_type": "full_time", "absolute_url": "https://jobs.gem.com/a/7"}
    (found,) = one(spark, "gem", [job])
    assert (found["employment_type"], found["workplace"], found["department"], found["location"], found["country"], found["source_id"]) == ("full time", "Remote", "Design · Brand", "Paris · Lyon", "fr", "7")


def test_getro_pages_money_and_missing_urls(spark):
    jobs = [{"id": i, "title": "Lead", "organization": {"name": "Acme", "slug": "acme", "logo_url": "l.png"}, "locations": ["Berlin", "", "Remote"], "work_mode": "on_site", "created_at": 1784505600, "slug": f"lead-{i}", "compensation_public": True, "compensation_amount_min_cents": 15000000, "compensation_amount_max_cents": 20000050, "compensation_currency": "USD", "compensation_period": "year"} for i in range(3)]
    rows = staged(spark, ("getro", "hv", "https://hv.getro.com/jobs", 0, {"results": {"jobs": jobs[:2], "count": 3}}, 200), ("getro", "hv", "https://hv.getro.com/jobs", 1, {"results": {"jobs": [*jobs[1:], {"title": "keyless"}], "count": 3}}, 200))
    found = sorted(providers.normalise(rows, "getro").collect(), key=lambda r: r.source_id)
    assert [r.source_id for r in found] == ["0", "1", "2"]
    assert found[0].published_at == "2026-07-20T00:00:00.000Z" and found[0].workplace == "On-site" and found[0].location == "Berlin · Remote"
    assert found[0].url == "https://hv.getro.com/companies/acme/jobs/lead-0"
    assert json.loads(found[0].compensation_json) == {"currency": "USD", "interval": "year", "min": 150000, "max": 200000.5}


def test_sparkhire_reads_script_literals(spark):
    page = 'x = 1; COMPANY_DATA = {"name": "Fluent; \\"Tech\\" }", "logos": {"small": {"url": "s.png"}}}; COMPANY_POSITIONS_DATA = [{"uid": "D0.A6B", "name": "Dev", "location": {"name": "Rome", "is_remote": true}, "employment_type": "FullTime", "custom_fields": {"details": [{"value": "<p>a</p>"}, {"value": null}, {"value": "b"}]}, "time_updated": "2026-07-20T00:00:00Z", "url_comeet_hosted_page": "https://c.test/D0.A6B"}];'
    (found,) = one(spark, "sparkhire", page, "fluenttech|E5.00E")
    assert (found["source_id"], found["company_name"], found["company_logo_url"], found["workplace"], found["description_plain"]) == ("D0.A6B", 'Fluent; "Tech" }', "s.png", "Remote", "a\nb")
    assert text.assigned_json("COMPANY_DATA = {1", "COMPANY_DATA") is None


def test_lever_greenhouse_bamboo_paylocity_and_the_rest(spark):
    (lever,) = one(spark, "lever", [{"id": "x", "text": "SRE", "createdAt": 1784505600000, "categories": {"location": "Austin, TX", "team": "Ops"}, "hostedUrl": "h", "salaryRange": {"currency": "USD", "min": 1, "max": None}}])
    assert (lever["published_at"], lever["department"], lever["country"], lever["compensation_json"], lever["apply_url"]) == ("2026-07-20T00:00:00.000Z", "Ops", "us", '{"currency":"USD","min":1}', "h")
    (green,) = one(spark, "greenhouse", {"jobs": [{"id": 5, "title": " Engineer ", "content": "&lt;p&gt;a &amp;amp; b", "absolute_url": "u", "metadata": [{"name": "Workplace Type", "value": "Hybrid"}], "departments": [{"name": "Eng"}], "updated_at": "2026-07-20T08:00:00-04:00"}]})
    assert (green["title"], green["workplace"], green["published_at"], green["description_plain"]) == ("Engineer", "Hybrid", "2026-07-20T12:00:00.000Z", "<p>a &amp; b")
    (bamboo,) = one(spark, "bamboohr", {"result": [{"id": "42", "jobOpeningName": "Chief Officer", "location": {"city": "Austin", "state": "TX"}}]}, "acme")
    assert (bamboo["location"], bamboo["url"], bamboo["workplace"]) == ("Austin, TX", "https://acme.bamboohr.com/careers/42", "On-site")
    (pay,) = one(spark, "paylocity", '<script>window.pageData = {"Jobs": [{"JobId": 9, "JobTitle": "R&amp;D", "IsRemote": true, "JobLocation": {"City": "A", "State": "B"}, "PublishedDate": "/Date(1784505600000)/"}]};</script>')
    assert (pay["source_id"], pay["title"], pay["workplace"], pay["location"], pay["published_at"]) == ("9", "R&D", "Remote", "A, B", "2026-07-20T00:00:00.000Z")
    (rip,) = one(spark, "rippling", [{"uuid": "u1", "name": "Dev", "workLocation": {"label": "Remote (US)"}}], url="https://ats.rippling.com/x/jobs")
    assert (rip["url"], rip["workplace"], rip["published_at"]) == ("https://ats.rippling.com/x/jobs/u1", "Remote", None)
    (smart,) = one(spark, "smartrecruiters", {"content": [{"id": "1", "name": "Dev", "company": {"name": "X"}, "location": {"city": "Poland", "region": "Poland", "country": "pl", "hybrid": True}, "industry": {"id": "computer_software"}}]})
    assert (smart["location"], smart["workplace"], smart["company_industry"]) == ("Poland, PL", "Hybrid", "Technology & Software")
    (work,) = one(spark, "workday", {"jobPostings": [{"title": "Dev", "externalPath": "/job/X/Dev_R1", "locationsText": "Dublin", "postedOn": "Posted 2 Days Ago"}], "total": 1}, "a|wd5|External", "https://a.wd5.myworkdayjobs.com/External")
    assert (work["source_id"], work["published_at"], work["company_logo_url"], work["country"]) == ("Dev_R1", "2026-07-18T12:00:00.000Z", "https://a.wd5.myworkdayjobs.com/External/assets/logo", "ie")


def test_board_results(spark):
    rows = staged(spark, ("lever", "a", "", 0, [{"id": 1}], 200), ("lever", "b", "", 0, [], 200), ("lever", "c", "", 0, "<html>", 200), ("lever", "d", "", 0, None, 422), ("lever", "e", "", 0, None, 503))
    found = {r.identifier: (r.status, r.job_count) for r in providers.board_results(rows, ["lever"]).collect()}
    assert found == {"a": ("active", 1), "b": ("empty", 0), "c": ("invalid", 0), "d": ("invalid", 0), "e": ("error", 0)}


def send(url, method="GET", body=None, **_):
    """A transport from memory."""
    if "crawl" in url:
        return (404, "", {}) if "page=9" in url else (200, '{"url": "https://jobs.lever.co/a"}\n\nnot json\n{"url": "https://x.test"}', {})
    if "lever" in url:
        skip = int(url.split("skip=")[1].split("&")[0])
        return 200, json.dumps([{"id": skip + i, "text": "Dev", "hostedUrl": "u"} for i in range(100 if skip == 0 else 2)]), {}
    if "repeat" in url:
        offset = min(20, json.loads(body)["offset"])
        return 200, json.dumps({"total": 100, "jobPostings": [{"title": str(offset + i), "externalPath": f"/{offset + i}"} for i in range(20)]}), {}
    return 404, "", {}


def test_paging_stops_where_it_should():
    assert [p for p, _ in paged.pages(send, "lever", "https://api.lever.co/v0/postings/x?mode=json")] == [0, 1]
    assert [p for p, _ in paged.pages(send, "workday", "https://repeat/jobs")] == [0, 1, 2]
    waits, calls = [], iter([(503, "", {}), (429, "", {"retry-after": "2"}), (200, "ok", {})])
    assert paged.request(lambda u, **_: next(calls), "u", sleep=waits.append) == "ok" and 0.15 <= waits[0] <= 0.45 and waits[1] == 2
    with pytest.raises(paged.RequestFailed):
        paged.request(lambda u, **_: (404, "", {}), "u")


def test_sources_read_through_spark(spark):
    paged.register(spark)
    boards = [{"key": "lever:global:x", "provider": "lever", "identifier": "x", "board_url": "b", "api_url": "https://api.lever.co/v0/postings/x"}, {"key": "gem:global:y", "provider": "gem", "identifier": "y", "board_url": "b", "api_url": "https://none"}]
    rows = spark.read.format("boards").option("boards", json.dumps(boards)).option("transport", "tests.test_providers:send").option("synced_at", AT).load()
    assert providers.normalise(rows, "lever").count() == 102
    found = {r.key: r.status for r in providers.board_results(rows, ["lever", "gem"]).collect()}
    assert found == {"lever:global:x": "active", "gem:global:y": "invalid"}
    targets = [{"provider": "lever", "pattern": "jobs.lever.co/*", "pages": [0, 9]}]
    urls = spark.read.format("crawl").option("targets", json.dumps(targets)).option("transport", "tests.test_providers:send").option("index", "https://crawl/index").load()
    keys = urls.select(parse_board(F.col("url"))["key"].alias("k"), "page").where("k is not null").collect()
    assert [(r.k, r.page) for r in keys] == [("lever:global:a", 0)]
