"""Named queries over one staged response of each provider, with the postings that must come of it."""

import json

from pyspark.sql import DataFrame, SparkSession

from rolecast.plans.queries import query
from rolecast.plans.text_queries import sql_values, values
from rolecast.sources import providers

AT = "2026-07-20T12:00:00.000Z"
COLUMNS = "source_id, title, location, country, workplace, employment_type, department, category, published_at, url, description_plain, compensation_json"
STAGED = "key string, provider string, identifier string, region string, board_url string, api_url string, page int, body string, http_status int, synced_at string"

LEVER = [{"id": "x", "text": "SRE", "createdAt": 1784505600000, "categories": {"location": "Austin, TX", "team": "Ops", "commitment": "Full-time"}, "hostedUrl": "https://l.test/x", "descriptionPlain": "Run it", "salaryRange": {"currency": "USD", "min": 1, "max": None}}, {"id": "y", "text": None, "categories": {}, "hostedUrl": "https://l.test/y"}]
GREENHOUSE = {"jobs": [{"id": 5, "title": " Engineer ", "content": "&lt;p&gt;a &amp;amp; b", "absolute_url": "https://g.test/5", "location": {"name": "Berlin, Germany"}, "metadata": [{"name": "Workplace Type", "value": "Hybrid"}], "departments": [{"name": "Eng"}], "updated_at": "2026-07-20T08:00:00-04:00"}]}
ASHBY = {"jobs": [{"title": "Engineer", "location": "Remote", "workplaceType": "Remote", "employmentType": "FullTime", "department": "R&D", "descriptionPlain": "Build", "publishedAt": "2026-07-20T10:00:00.000Z", "jobUrl": "https://jobs.ashbyhq.com/example/job-123", "isListed": True}, {"title": "Hidden", "jobUrl": "https://jobs.ashbyhq.com/example/other", "isListed": False}]}
GEM = [{"id": 7, "title": "Designer", "first_published_at": "2026-07-20", "content_plain": "text", "departments": [{"id": 1, "name": "Design"}, {"name": None}, {"name": "Brand"}], "offices": [{"name": "HQ", "location": {"name": "Paris"}}, {"name": "Lyon"}], "location_type": "remote", "employment_type": "full_time", "absolute_url": "https://jobs.gem.com/a/7"}]
GETRO = {"results": {"jobs": [{"id": 1, "title": "Lead", "organization": {"name": "Acme", "slug": "acme", "logo_url": "l.png"}, "locations": ["Berlin", "", "Remote"], "work_mode": "on_site", "created_at": 1784505600, "slug": "lead-1", "compensation_public": True, "compensation_amount_min_cents": 15000000, "compensation_amount_max_cents": 20000050, "compensation_currency": "USD", "compensation_period": "year"}, {"title": "no key"}], "count": 2}}
SPARKHIRE = 'x = 1; COMPANY_DATA = {"name": "Fluent; \\"Tech\\" }", "logos": {"small": {"url": "s.png"}}}; COMPANY_POSITIONS_DATA = [{"uid": "D0.A6B", "name": "Dev", "location": {"name": "Rome", "is_remote": true}, "employment_type": "FullTime", "custom_fields": {"details": [{"value": "<p>a</p>"}, {"value": null}, {"value": "b"}]}, "time_updated": "2026-07-20T00:00:00Z", "url_comeet_hosted_page": "https://c.test/D0.A6B"}];'
RIPPLING = [{"uuid": "u1", "name": "Dev", "workLocation": {"label": "Remote (US)"}, "employmentType": {"label": "Salaried, full-time"}, "department": {"label": "R&D"}}]
SMARTRECRUITERS = {"content": [{"id": "1", "name": "Dev", "company": {"name": "X"}, "location": {"city": "Poland", "region": "Poland", "country": "pl", "hybrid": True}, "typeOfEmployment": {"label": "Full-time"}, "industry": {"id": "computer_software"}, "releasedDate": "2026-07-19T00:00:00.000Z"}], "totalFound": 1}
BAMBOOHR = {"result": [{"id": "42", "jobOpeningName": "Chief Financial Officer", "departmentLabel": "Finance", "employmentStatusLabel": "Full-Time", "location": {"city": "Austin", "state": "TX"}}]}
WORKDAY = {"jobPostings": [{"title": "Dev", "externalPath": "/job/X/Dev_R1", "locationsText": "Dublin", "postedOn": "Posted 2 Days Ago"}, {"title": "Dev", "externalPath": "/job/X/Dev_R1", "locationsText": "Dublin", "postedOn": "Posted Today"}], "total": 2}
ICIMS = '<urlset><url><loc>https://careers-acme.icims.com/jobs/123/support-engineer/job</loc><lastmod>2026-07-19</lastmod></url><url><loc>https://careers-acme.icims.com/jobs/search</loc></url></urlset>'
PAYLOCITY = '<script>window.pageData = {"Jobs": [{"JobId": 9, "JobTitle": "R&amp;D", "IsRemote": true, "JobLocation": {"City": "A", "State": "B"}, "PublishedDate": "/Date(1784505600000)/"}]};</script>'


def _register(provider: str, identifier: str, url: str, body, *expected: tuple) -> None:
    """A query over one response, beside the rows that are expected of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = body if isinstance(body, str) else json.dumps(body)
        rows = values(spark, STAGED, (f"{provider}:global:{identifier}", provider, identifier, "global", url, url, 0, text, 200, AT))
        return providers.normalise(rows, provider).select(*COLUMNS.split(", "))

    run.__name__ = f"payload_{provider}"
    run.__doc__ = f"The postings of a response of {provider}."
    query(f"SELECT {COLUMNS} FROM {sql_values('v', COLUMNS, *expected)}")(run)


_register("lever", "acme", "https://jobs.lever.co/acme", LEVER, ('x', 'SRE', 'Austin, TX', 'us', 'Unspecified', 'Full-time', 'Ops', 'Engineering', '2026-07-20T00:00:00.000Z', 'https://l.test/x', 'Run it', '{"currency":"USD","min":1}'), ('y', 'Untitled role', None, None, 'Unspecified', None, None, 'Other', None, 'https://l.test/y', None, None))
_register("greenhouse", "acme", "https://g.test", GREENHOUSE, ('5', 'Engineer', 'Berlin, Germany', 'de', 'Hybrid', None, 'Eng', 'Engineering', '2026-07-20T12:00:00.000Z', 'https://g.test/5', '<p>a &amp; b', None))
_register("ashby", "example", "https://jobs.ashbyhq.com/example", ASHBY, ('job-123', 'Engineer', 'Remote', None, 'Remote', 'Full-Time', 'R&D', 'Engineering', '2026-07-20T10:00:00.000Z', 'https://jobs.ashbyhq.com/example/job-123', 'Build', None))
_register("gem", "agora", "https://jobs.gem.com/a", GEM, ('7', 'Designer', 'Paris · Lyon', 'fr', 'Remote', 'full time', 'Design · Brand', 'Product & Design', '2026-07-20T00:00:00.000Z', 'https://jobs.gem.com/a/7', 'text', None))
_register("getro", "hv", "https://hv.getro.com/jobs", GETRO, ('1', 'Lead', 'Berlin · Remote', 'de', 'On-site', None, None, 'Other', '2026-07-20T00:00:00.000Z', 'https://hv.getro.com/companies/acme/jobs/lead-1', None, '{"currency":"USD","interval":"year","min":150000,"max":200000.5}'))
_register("sparkhire", "fluenttech|E5.00E", "https://www.comeet.com/jobs/fluenttech/E5.00E", SPARKHIRE, ('D0.A6B', 'Dev', 'Rome', 'it', 'Remote', 'Full-Time', None, 'Other', '2026-07-20T00:00:00.000Z', 'https://c.test/D0.A6B', 'a\nb', None))
_register("rippling", "x", "https://ats.rippling.com/x/jobs", RIPPLING, ('u1', 'Dev', 'Remote (US)', 'us', 'Remote', 'Salaried, full-time', 'R&D', 'Other', None, 'https://ats.rippling.com/x/jobs/u1', None, None))
_register("smartrecruiters", "X", "https://jobs.smartrecruiters.com/X", SMARTRECRUITERS, ('1', 'Dev', 'Poland, PL', 'pl', 'Hybrid', 'Full-time', None, 'Other', '2026-07-19T00:00:00.000Z', 'https://jobs.smartrecruiters.com/X/1', None, None))
_register("bamboohr", "acme", "https://acme.bamboohr.com/careers", BAMBOOHR, ('42', 'Chief Financial Officer', 'Austin, TX', 'us', 'On-site', 'Full-Time', 'Finance', 'Operations', None, 'https://acme.bamboohr.com/careers/42', None, None))
_register("workday", "a|wd5|External", "https://a.wd5.myworkdayjobs.com/External", WORKDAY, ('Dev_R1', 'Dev', 'Dublin', 'ie', 'Unspecified', None, None, 'Other', '2026-07-18T12:00:00.000Z', 'https://a.wd5.myworkdayjobs.com/External/job/X/Dev_R1', None, None))
_register("icims", "careers-acme", "https://careers-acme.icims.com", ICIMS, ('123', 'Support Engineer', None, None, 'Unspecified', None, None, 'Engineering', '2026-07-19T00:00:00.000Z', 'https://careers-acme.icims.com/jobs/123/support-engineer/job', None, None))
_register("paylocity", "12345678-abcd-1234-abcd-123456789abc", "https://recruiting.paylocity.com/x", PAYLOCITY, ('9', 'R&D', 'A, B', None, 'Remote', None, None, 'Other', '2026-07-20T00:00:00.000Z', 'https://recruiting.paylocity.com/recruiting/Jobs/Details/9', None, None))
