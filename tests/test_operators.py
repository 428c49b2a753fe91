import gzip
import json
import os

from pyspark.sql import functions as F

from rolecast.functions import classify, text
from rolecast.operators import ops, registry, snapshots
from rolecast.plans import jobs as j
from rolecast.sources import sinks, staged
from rolecast.streaming.rules import next_time


def test_two_snapshots_end_to_end(spark, tmp_path):
    """A posting changes, one closes; a failed board closes nothing, a returning posting reopens."""

    def job(key, title):
        return {"key": f"ashby:global:x:{key}", "sourceId": key, "boardKey": "ashby:global:x", "provider": "ashby", "companyIdentifier": "x", "title": title, "url": "u", "compensation": None}

    def files(at, jobs, status):
        (tmp_path / "jobs.json").write_text(json.dumps({"syncedAt": at, "jobs": [x | {"syncedAt": at} for x in jobs]}))
        (tmp_path / "sync.json").write_text(json.dumps({"syncedAt": at, "summary": {"boardCount": 1, "statuses": {status: 1}}, "boards": [{"key": "ashby:global:x", "provider": "ashby", "identifier": "x", "status": status, "jobCount": len(jobs), "syncedAt": at, "error": None}]}))
        return staged.snapshot_jobs(spark, str(tmp_path / "jobs.json")), staged.snapshot_boards(spark, str(tmp_path / "sync.json"))

    empty = snapshots.JOB_FIELDS
    state = spark.createDataFrame([], ", ".join([f"{c} string" for c in ["key", *empty, "first_seen_at", "last_seen_at", "closed_at"]]) + ", is_active int")
    boards = spark.createDataFrame([], "key string, provider string, identifier string, status string, job_count bigint, first_seen_at string, last_synced_at string, last_success_at string, error string")
    seen = []
    for at, jobs, status in (("t0", [job("1", "Platform Engineer"), job("2", "Product Manager"), job("1", "Copy")], "active"), ("t1", [job("1", "Staff Platform Engineer")], "active"), ("t2", [], "error"), ("t3", [job("2", "Product Manager")], "active"), ("t4", [], "invalid")):
        new, results = files(at, jobs, status)
        folded = snapshots.apply_snapshot(state, snapshots.stage_jobs(new), results, snapshots.LOCAL).drop("change")
        state = spark.createDataFrame(folded.collect(), state.schema)
        boards = spark.createDataFrame(snapshots.apply_boards(boards, results).collect(), boards.schema)
        found = {r.source_id: (r.title, r.is_active, r.first_seen_at, r.closed_at) for r in state.collect()}
        seen.append((found, boards.first().last_success_at, j.total(state, j.JobQuery(search="platform")).first().total))
    assert seen[0] == ({"1": ("Platform Engineer", 1, "t0", None), "2": ("Product Manager", 1, "t0", None)}, "t0", 1)
    assert seen[1][0] == {"1": ("Staff Platform Engineer", 1, "t0", None), "2": ("Product Manager", 0, "t0", "t1")} and seen[1][2] == 1
    assert seen[2][0] == seen[1][0] and seen[2][1] == "t1"
    assert seen[3][0]["2"] == ("Product Manager", 1, "t0", None) and seen[3][0]["1"][1] == 0
    assert all(v[1] == 0 for v in seen[4][0].values())
    assert state.first().compensation_json == "null"


def test_registry_merges_and_sampling(spark):
    urls = spark.createDataFrame([("https://jobs.lever.co/acme/1", "crawl-a", "2026-02-01", 0), ("jobs.lever.co/acme", "crawl-b", "2026-01-01", 1), ("https://jobs.ashbyhq.com/G2", "crawl-a", "2026-01-01", 2), ("https://jobs.ashbyhq.com/g2", None, "2026-01-02", 3), ("https://x.test", "crawl-a", "2026", 4)], "url string, discovery_source string, discovered_at string, ord int")
    found = {r.key: r for r in registry.merge_registry(registry.discovered_records(urls)).collect()}
    assert sorted(found) == ["ashby:global:g2", "lever:global:acme"]
    lever = found["lever:global:acme"]
    assert (lever.discovery_sources, lever.first_discovered_at, len(lever.sample_urls)) == (["crawl-a", "crawl-b"], "2026-01-01", 2)
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(registry.even_pages(lit(101), lit(5))) == [0, 25, 50, 75, 100] and one(registry.even_pages(lit(100), lit(1))) == [49] and one(registry.even_pages(lit(0), lit(5))) == []
    assert one(registry.rotating_pages(lit(20), lit(5), lit(1))) == [1, 5, 9, 13, 17]
    seen = F.array(*[lit(x).cast("bigint") for x in (0, 3, 6)])
    assert one(registry.unseen_pages(lit(10), lit(3), seen, lit(0))) == [1, 4, 7]
    assert one(registry.unseen_pages(lit(3), lit(2), F.array(*[lit(x).cast("bigint") for x in (0, 1, 2)]), lit(0))) == []
    assert registry.credit_budget(20, 8) == (2, 8)
    boards = spark.createDataFrame([("a1", "a", 0), ("a2", "a", 1), ("a3", "a", 2), ("g1", "g", 3), ("g2", "g", 4), ("l1", "l", 5), ("l2", "l", 6)], "k string, p string, o int")
    assert [r.k for r in registry.round_robin(boards, "p", "o", 6).collect()] == ["a1", "g1", "l1", "a2", "g2", "l2"]


def test_scalar_edges(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(text.clean_string(F.lit("  a b﻿"))) == "a b" and one(text.clean_string(F.lit(" "))) is None
    assert one(text.url_decode(F.lit("a+b%20c"))) == "a+b c" and one(text.url_decode(F.lit("%zz"))) == "%zz"
    assert one(text.stable_fallback_id(F.lit("a b"), F.lit(None).cast("string"), F.lit("!~(x)"))) == "a%20b%7C!~(x)" and one(text.stable_fallback_id(F.lit(""))) == "unknown"
    long = "a" * 3998 + "😀 after"
    short = one(text.truncate(F.lit(long), 4000))
    assert len(short.encode("utf-16-le")) // 2 == 3999 and short.endswith("…")
    assert one(text.humanize_identifier(F.lit("acme|wd5|External"), F.lit("workday"))) == "Acme"
    assert one(classify.location_city(F.lit("São Paulo, Brazil"))) == "SÃO Paulo" and one(classify.location_country(F.lit("Indianapolis, Indiana"))) is None
    assert next_time("error", 1, "2026-07-21T00:00:00.000Z") == "2026-07-21T00:30:00.000Z"


def test_cursors_and_clamps():
    assert j.decode_cursor(j.encode_cursor(value="é", key="k")) == {"value": "é", "key": "k"} and j.decode_cursor("%%%") == {} and j.decode_cursor(None) == {}
    assert (j.clamp("12px", 5, 1, 100), j.clamp("x", 5, 1, 100), j.clamp(None, 5, 1, 100), j.clamp(-4, 5, 1, 100)) == (12, 5, 5, 1)
    assert j.set_values(" a,, b ,") == ["a", "b"] and len(j.set_values(",".join(map(str, range(30))))) == 12


def test_search_phrases(spark):
    docs = spark.createDataFrame([("front end developer",), ("end front",), ("frontend",), ("C++ dev",), ("cobol dev",), ("c",), ("Málaga",)], "t string")
    hits = lambda q: sorted(r.t for r in docs.where(j.fts_match(q, F.col("t"))).collect())
    assert hits("front-end") == ["front end developer"] and hits("c++") == ["C++ dev", "c", "cobol dev"] and hits("malaga") == ["Málaga"]
    names = spark.createDataFrame([("Nguyễn Văn kỹ sư",), ("Senior Nguyen",), ("Mehmet Doğan, İzmir",), ("Știință",), ("cafe\u0301",), ("Ørsted",), ("naïve ộ ả",)], "t string")
    found = lambda q: sorted(r.t for r in names.where(j.fts_match(q, F.col("t"))).collect())
    assert found("Nguyễn") == found("nguyen") == found("nguye\u0302\u0303n") == ["Nguyễn Văn kỹ sư", "Senior Nguyen"]
    assert found("ky") == ["Nguyễn Văn kỹ sư"] and found("DOGAN izmir") == ["Mehmet Doğan, İzmir"] and found("stiinta") == ["Știință"] and found("café") == ["cafe\u0301"]
    assert found("ørsted") == ["Ørsted"] and found("orsted") == [] and found("naive o a") == ["naïve ộ ả"]


def test_sinks(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "2026-01-01T00:00:00.000Z", 0, "2026-01-02"), ("b", "2026-07-01T00:00:00.000Z", 0, None), ("c", None, 1, "2026-01-03")], "key string, closed_at string, is_active int, published_at string")
    left = ops.archive(jobs, str(tmp_path / "archive"), "2026-07-20T00:00:00.000Z")
    assert sorted(r.key for r in left.collect()) == ["b", "c"]
    (day,) = [d for d in os.listdir(tmp_path / "archive") if d.startswith("day=")]
    (part,) = [f for f in os.listdir(tmp_path / "archive" / day) if f.endswith(".gz")]
    assert json.loads(gzip.open(tmp_path / "archive" / day / part).read())["key"] == "a"
    assert staged.read_if_exists(spark, str(tmp_path / "none"), jobs.schema).count() == 0
    sinks.export_document(jobs, str(tmp_path / "doc"), syncedAt="t")
    (name,) = [f for f in os.listdir(tmp_path / "doc") if f.startswith("part-")]
    assert [x["key"] for x in json.loads((tmp_path / "doc" / name).read_text())["jobs"]] == ["c", "a", "b"]
    assert "| Provider |" in ops.report(spark.createDataFrame([("p", "active", 3), ("p", None, None)], "provider string, status string, job_count bigint"))


def test_staged_lists(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# c\n a \n\nb\r\n")
    assert sorted(r.url for r in staged.url_list(spark, str(tmp_path / "urls.txt")).collect()) == ["a", "b"]
    (tmp_path / "urls.json").write_text('{"urls": ["x", ""]}')
    assert [r.url for r in staged.url_list(spark, str(tmp_path / "urls.json")).collect()] == ["x"]
    (tmp_path / "i.ndjson").write_text('{"url": "u"}\n\nbad\n{"a": 1}')
    assert [r.url for r in staged.crawl_index(spark, str(tmp_path / "i.ndjson")).collect()] == ["u"]
    ledger = spark.createDataFrame([('{"coverage": {"i|p|x": {"indexId": "i", "totalPages": 5, "sampledPages": [0, 2]}, "j": {}}}',)], "d string")
    rows = staged.coverage_ledger(ledger, "d")
    assert registry.coverage_summary(rows).first().asDict() == {"targets": 2, "completed": 1, "total_pages": 5, "sampled_pages": 2, "completion": 0.4}
    (tmp_path / "shard.json").write_text('{"boards": [{"key": "k"}]}')
    assert staged.registry_shard(spark, str(tmp_path / "shard.json")).count() == 1
