"""Paged web sources as a Python data source: one partition for each board or crawl page.

The transport is given as an import path to a function (url, method, body, headers) ->
(status, text, headers), so that tests and offline runs read from memory. Nothing is
fetched on the driver.
"""

import importlib
import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[..., tuple[int, str, dict]]
RETRIED = {408, 429}


class InvalidPayload(Exception):
    """A body that is not what the provider sends: the board is no longer one."""


class RequestFailed(Exception):
    def __init__(self, status: int, url: str):
        super().__init__(f"HTTP {status} for {url}")
        self.status = status


def transport(name: str) -> Transport:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def request(send: Transport, url: str, retries: int = 2, sleep: Callable[[float], None] = time.sleep, **how) -> str:
    """A response's text. 408, 429, server and network errors are tried again after 0.3 s doubled each time, times 0.5 to 1.5."""
    for attempt in range(retries + 1):
        try:
            status, text, headers = send(url, **how)
        except OSError:
            if attempt == retries:
                raise
            status, headers = 0, {}
        if 200 <= status < 300:
            return text
        if status and not (status in RETRIED or status >= 500) or attempt == retries:
            raise RequestFailed(status, url)
        sleep(float(headers["retry-after"]) if str(headers.get("retry-after", "")).isdigit() else 0.3 * 2**attempt * random.uniform(0.5, 1.5))
    raise AssertionError


def crawl_request(send: Transport, url: str, missing_ok: bool = False, **how) -> str:
    """As request; a 404 is an empty page where that is allowed, and a proxy's 400 is tried again."""

    def patient(target: str, **more) -> tuple[int, str, dict]:
        status, text, headers = send(target, **more)
        return (503 if status == 400 and "proxy" in text.lower() else status), text, headers

    try:
        return request(patient, url, **how)
    except RequestFailed as error:
        if missing_ok and error.status == 404:
            return ""
        raise


def parsed(text: str, *path: str) -> list:
    """The array at a path of a JSON body."""
    try:
        found = json.loads(text)
        for part in path:
            found = found[part]
    except (ValueError, KeyError, TypeError, IndexError):
        raise InvalidPayload("expected a JSON body with a job array") from None
    if not isinstance(found, list):
        raise InvalidPayload("expected a job array")
    return found


@dataclass(frozen=True)
class Paging:
    """How a provider's pages follow one another: by offset, until a short page, no news or the total is reached."""

    size: int
    most: int
    path: tuple[str, ...]
    total: tuple[str, ...] = ()
    post: bool = False
    #: url, page number, page size -> url, body
    address: Callable[[str, int, int], tuple[str, dict | None]] = lambda url, page, size: (url, None)
    same: Callable[[dict], str | None] | None = None
    stop_short: bool = True


def _query(base: str, /, **values) -> str:
    from urllib.parse import urlencode

    return f"{base}{'&' if '?' in base else '?'}{urlencode(values)}"


def _workday_key(job: dict) -> str:
    return (job.get("externalPath") or "").strip() or f"{(job.get('title') or '').strip()}|{(job.get('locationsText') or '').strip()}"


PAGING = {
    "lever": Paging(100, 1000, (), address=lambda u, p, n: (_query(u.split("?")[0], mode="json", skip=p * n, limit=n), None)),
    "smartrecruiters": Paging(100, 200, ("content",), ("totalFound",), address=lambda u, p, n: (_query(u, limit=n, offset=p * n), None), stop_short=False),
    "workday": Paging(20, 5000, ("jobPostings",), ("total",), True, lambda u, p, n: (u, {"appliedFacets": {}, "limit": n, "offset": p * n, "searchText": ""}), _workday_key),
    "getro": Paging(100, 10_000, ("results", "jobs"), ("results", "count"), True, lambda u, p, n: (u, {"hits_per_page": n, "page": p, "filters": "", "query": ""}), lambda j: str(j.get("id") or j.get("slug") or j.get("url") or "") or None),
}


def pages(send: Transport, provider: str, url: str, **how) -> Iterator[tuple[int, str]]:
    """(page number, body) of a board, as far as there are postings that have not been seen."""
    rule = PAGING.get(provider)
    if rule is None:
        yield 0, request(send, url, **how)
        return
    seen: set[str] = set()
    count = 0
    for page in range(rule.most):
        target, body = rule.address(url, page, rule.size)
        text = request(send, target, method="POST" if rule.post else "GET", body=json.dumps(body) if body else None, **how)
        jobs = parsed(text, *rule.path)
        total = None
        if rule.total:
            total = json.loads(text)
            for part in rule.total:
                total = total.get(part) if isinstance(total, dict) else None
            if not isinstance(total, int | float):
                raise InvalidPayload("expected a total")
        if jobs or not page:
            yield page, text
        keys = [rule.same(j) for j in jobs] if rule.same else [f"{page}:{i}" for i in range(len(jobs))]
        news = {k for k in keys if k and k not in seen}
        seen |= news
        count += len(news)
        if not news or (rule.stop_short and len(jobs) < rule.size) or (total is not None and count >= total):
            return
    raise InvalidPayload(f"{provider} board exceeded {rule.most * rule.size} jobs")


def getro_endpoint(html: str) -> str:
    """Where a Getro board's postings are, from the script of its page."""
    import re

    found = re.search(r"<script[^>]+id=[\"']__NEXT_DATA__[\"'][^>]*>([\s\S]*?)</script>", html, re.I)
    try:
        collection = json.loads(found[1])["props"]["pageProps"]["network"]["id"] if found else None
    except (ValueError, KeyError, TypeError):
        collection = None
    if not collection:
        raise InvalidPayload("expected a network id")
    return f"https://api.getro.com/api/v2/collections/{collection}/search/jobs"


@dataclass
class BoardPartition(InputPartition):
    board: dict


class BoardReader(DataSourceReader):
    def __init__(self, boards: list[dict], send: str, synced_at: str):
        self.boards, self.send, self.synced_at = boards, send, synced_at

    def partitions(self) -> list[InputPartition]:
        return [BoardPartition(b) for b in self.boards]

    def read(self, partition: BoardPartition | None) -> Iterator[tuple]:
        if partition is None:  # no board at all
            return
        b, send = partition.board, transport(self.send)
        head = (b["key"], b["provider"], b["identifier"], b.get("region", "global"), b["board_url"], b["api_url"])
        try:
            url = getro_endpoint(request(send, b["board_url"])) if b["provider"] == "getro" else b["api_url"]
            for page, body in pages(send, b["provider"], url):
                yield (*head, page, body, 200, self.synced_at)
        except InvalidPayload:
            yield (*head, 0, None, 200, self.synced_at)
        except RequestFailed as error:
            yield (*head, 0, None, error.status or 503, self.synced_at)
        except OSError:
            yield (*head, 0, None, 503, self.synced_at)


class BoardSource(DataSource):
    """spark.read.format("boards") with options boards (JSON array), transport and synced_at: staged responses."""

    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return "key string, provider string, identifier string, region string, board_url string, api_url string, page int, body string, http_status int, synced_at string"

    def reader(self, schema) -> DataSourceReader:
        return BoardReader(json.loads(self.options["boards"]), self.options["transport"], self.options["synced_at"])


@dataclass
class PagePartition(InputPartition):
    target: dict
    page: int


class CrawlReader(DataSourceReader):
    def __init__(self, targets: list[dict], send: str, index: str):
        self.targets, self.send, self.index = targets, send, index

    def partitions(self) -> list[InputPartition]:
        return [PagePartition(t, p) for t in self.targets for p in t["pages"]]

    def read(self, partition: PagePartition | None) -> Iterator[tuple]:
        if partition is None:  # no page at all
            return
        t = partition.target
        query = {"url": t.get("query") or t["pattern"], "output": "json", "fl": "url", "filter": "status:200", "collapse": "urlkey", "page": partition.page}
        if t.get("match_type"):
            query["matchType"] = t["match_type"]
        for line in crawl_request(transport(self.send), _query(self.index, **query), missing_ok=True).splitlines():
            try:
                url = json.loads(line).get("url") if line.strip() else None
            except (ValueError, AttributeError):
                continue
            if url:
                yield t["provider"], t["pattern"], partition.page, url


class CrawlSource(DataSource):
    """spark.read.format("crawl") with options targets (JSON array, each with its pages), transport and index: discovered URLs."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return "provider string, pattern string, page int, url string"

    def reader(self, schema) -> DataSourceReader:
        return CrawlReader(json.loads(self.options["targets"]), self.options["transport"], self.options["index"])


def crawl_indexes(text: str, most: int = 4) -> list[str]:
    """The addresses of the newest crawl snapshots."""
    return [x["cdx-api"] for x in parsed(text)[: max(1, most)] if isinstance(x, dict) and x.get("cdx-api")]


def page_count(text: str) -> int:
    """The number of pages that a crawl index tells."""
    try:
        return max(0, int(json.loads(text).get("pages", 0)))
    except (ValueError, AttributeError):
        raise InvalidPayload("expected a page count") from None


def register(spark) -> None:
    spark.dataSource.register(BoardSource)
    spark.dataSource.register(CrawlSource)


def search_urls(send: Transport, endpoint: str, queries: list[str], limit: int = 20, budget: int = 10, key: str = "") -> tuple[list[str], int]:
    """URLs that a paid web search finds, each once, and the credits used; a budget of credits bounds the queries, two credits for each started ten results."""
    each = max(2, -(-limit // 10) * 2)
    found: dict[str, None] = {}
    wanted = queries[: budget // each]
    for query in wanted:
        text = request(send, endpoint, method="POST", body=json.dumps({"query": query, "limit": limit}), headers={"authorization": f"Bearer {key}"} if key else {})
        try:
            data = json.loads(text).get("data") or []
        except (ValueError, AttributeError):
            raise InvalidPayload("expected search results") from None
        results = data.get("web", []) if isinstance(data, dict) else data
        found |= dict.fromkeys(r["url"] for r in results if isinstance(r, dict) and r.get("url"))
    return list(found), each * len(wanted)


def board_logo(send: Transport, board: dict) -> str | None:
    """A board's page, from which sources.staged.logo_candidates picks a logo; null without an address."""
    url = board.get("board_url") or board.get("api_url")
    return request(send, url) if url else None


#: Requests to a provider at a time.
CONCURRENCY = {"default": 8}


def by_provider(frame, most: dict[str, int] | None = None):
    """frame dealt so that at most so many tasks read from a provider at once."""
    from pyspark.sql import functions as F

    caps = {**CONCURRENCY, **(most or {})}
    slots = F.coalesce(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col("provider")], F.lit(caps["default"]))
    return frame.repartition("provider", F.pmod(F.xxhash64("key"), slots))
