import json

from rolecast import __main__ as cli


def test_discover_sync_search_report(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "urls.txt").write_text("https://jobs.lever.co/acme/1\n# none\nhttps://x.test\n")
    cli.main(["discover", "--urls", str(tmp_path / "urls.txt"), "--output", str(tmp_path / "boards"), "--now", "2026-07-20"])
    boards = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "boards")).collect()]
    assert [b["key"] for b in boards] == ["lever:global:acme"]
    cli.main(["sync", "--boards", str(tmp_path / "boards"), "--state", str(tmp_path / "state"), "--transport", "tests.test_providers:send", "--now", "2026-07-20T12:00:00.000Z"])
    capsys.readouterr()
    cli.main(["search", "--state", str(tmp_path / "state"), "--search", "dev", "--limit", "2"])
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 3 and json.loads(out[-1]) == {"total": 102}
    # the provider is chosen before the limit
    mixed = [{"key": f"ashby:global:x{i}", "provider": "ashby", "identifier": f"x{i}"} for i in range(5)] + boards
    (tmp_path / "mixed").write_text("\n".join(map(json.dumps, mixed)))
    for more, want in ((["--provider", "lever", "--limit", "1"], 102), (["--provider", "lever", "--only-new"], 0)):
        where = str(tmp_path / ("state" if want == 0 else "other"))
        before = cli.state(spark, where)[0].count()
        cli.main(["sync", "--boards", str(tmp_path / "mixed"), "--state", where, "--transport", "tests.test_providers:send", "--now", "2026-07-20T12:00:00.000Z", *more])
        assert cli.state(spark, where)[0].count() - before == want
    capsys.readouterr()
    cli.main(["report", "--state", str(tmp_path / "state")])
    assert "| lever | 1 | 1 | 102 |" in capsys.readouterr().out
    cli.main(["merge", "--output", str(tmp_path / "merged"), str(tmp_path / "shard.json")]) if (tmp_path / "shard.json").write_text(json.dumps([{"key": "k", "provider": "lever", "discoverySources": ["a"]}, {"key": "k", "discoverySources": ["b"]}])) else None
    assert json.loads(spark.read.text(str(tmp_path / "merged")).first().value)["discovery_sources"] == ["a", "b"]
