from rolecast.engine import Engine
from rolecast.operators.snapshots import JOB_FIELDS
from rolecast.plans.jobs import JobQuery


def jobs(spark, at, *rows):
    schema = ", ".join(f"{c} string" for c in ["key", *JOB_FIELDS, "synced_at"]) + ", ord long"
    made = []
    for i, (key, title, name) in enumerate(rows):
        one = dict.fromkeys(["key", *JOB_FIELDS]) | {"key": f"b1:{key}", "source_id": key, "board_key": "b1", "provider": "lever", "company_identifier": "acme", "company_name": name, "title": title, "url": "u", "published_at": at}
        made.append((*one.values(), at, i))
    return spark.createDataFrame(made, schema)


def result(spark, at, status, n):
    return spark.createDataFrame([("b1", "lever", "acme", status, n, at, "boom" if status == "error" else None)], "key string, provider string, identifier string, status string, job_count bigint, synced_at string, error string")


def test_production_life_of_a_board(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"))
    t = [f"2026-07-2{i}T00:00:00.000Z" for i in range(6)]
    found = spark.createDataFrame([("b1", "lever", "acme", None, "https://b", "https://a", 0)], "key string, provider string, identifier string, region string, board_url string, api_url string, ord long")
    engine.upsert_discovered(found, t[0])
    assert [b["key"] for b in engine.schedule_due(t[0])] == ["b1"] and engine.schedule_due(t[0]) == []
    assert engine.apply_snapshot(jobs(spark, t[0], ("1", "Engineer", "Acme"), ("2", "Manager", None)), result(spark, t[0], "active", 2)) == {"inserted": 2}
    # equal postings are not rewritten, even with another date
    assert engine.apply_snapshot(jobs(spark, t[1], ("1", "Engineer", "Acme"), ("2", "Manager", None)), result(spark, t[1], "active", 2)) == {"kept": 2}
    assert engine.apply_snapshot(jobs(spark, t[2], ("1", "Staff Engineer", None)), result(spark, t[2], "active", 1)) == {"updated": 1, "closed": 1}
    assert engine.apply_snapshot(jobs(spark, t[3]), result(spark, t[3], "error", 0)) == {"kept": 2}
    board = engine.table("boards").first()
    assert (board.status, board.failure_count, board.next_sync_at, board.last_error, board.job_count) == ("error", 1, "2026-07-23T00:30:00.000Z", "boom", 1)
    assert engine.table("companies").first().name == "Acme"
    health = engine.table("health").first()
    assert (health.successful_runs, health.failed_runs, health.active_jobs) == (3, 1, 1)
    page, total = engine.query_jobs(JobQuery(search="engineer"))
    assert [(r.title, r.company) for r in page.collect()] == [("Staff Engineer", "Acme")]
    assert total.first().total == 1 and engine.stats().first().asDict() == {"active_jobs": 1, "closed_jobs": 1, "active_boards": 0, "last_synced_at": t[3]}
    tasks = spark.createDataFrame([(None, "lever", "b1", "{}", "boom", 3)], "type string, provider string, board_key string, payload string, error string, attempts int")
    engine.record_dead_letters(tasks, t[3])
    assert engine.failures().count() == 1 and engine.health(t[3]).first().unresolved_failures == 1
    assert engine.apply_snapshot(jobs(spark, t[4], ("1", "Staff Engineer", None), ("2", "Manager", None)), result(spark, t[4], "active", 2), "http") == {"updated": 1, "reopened": 1}
    assert engine.failures().count() == 0
    assert [r.title for r in engine.suggest_titles("man").collect()] == ["Manager"]
    engine.run_maintenance("2026-09-30T00:00:00.000Z")
    assert engine.table("runs").count() == 0 and engine.table("titles").count() == 2 and engine.table("failures").count() == 0
