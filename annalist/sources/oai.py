"""Harvesting of records by OAI-PMH, as a batch and a stream data source."""

from __future__ import annotations

import datetime
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from annalist.functions.markup import attribute, elements, first_text, span

SCHEMA = "identifier string, datestamp string, deleted boolean, title string, creator string, date_text string, language string, address string"
MOST_TRIES, DEFAULT_WAIT, MOST_WAIT = 5, 5, 120


@dataclass
class Response:
    status: int
    body: str
    retry_after: int = 0


class Fetcher(Protocol):
    """What harvests need of HTTP; tests hand in a scripted one."""

    def get(self, url: str) -> Response: ...

    def sleep(self, seconds: int) -> None: ...


MOST_REDIRECTS = 5


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = MOST_REDIRECTS
    max_repeats = MOST_REDIRECTS


class HttpFetcher:
    def __init__(self, timeout: int = 60) -> None:
        self.timeout = timeout

    def get(self, url: str) -> Response:
        try:
            with urllib.request.build_opener(_Redirects).open(url, timeout=self.timeout) as r:
                return Response(r.status, r.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as e:
            wait = e.headers.get("Retry-After", "")
            return Response(e.code, "", int(wait) if wait.isdigit() else 0)

    def sleep(self, seconds: int) -> None:
        time.sleep(seconds)


def escape(value: str) -> str:
    return urllib.parse.quote(value, safe="-._~")


def list_url(base: str, prefix: str = "oai_dc", set_: str = "", from_: str = "", until: str = "", token: str = "") -> str:
    """A request carries a resumption token and nothing else, or what it asks for."""
    if token:
        return f"{base}?verb=ListRecords&resumptionToken={escape(token)}"
    more = [(k, v) for k, v in (("set", set_), ("from", from_), ("until", until)) if v]
    return f"{base}?verb=ListRecords&metadataPrefix={escape(prefix)}" + "".join(f"&{k}={escape(v)}" for k, v in more)


def parse_record(body: str) -> tuple:
    """One record; the first value of a field counts, and an address is a fetchable identifier."""
    header = span(body, "header") or (0, 0)
    head = body[header[0] : header[1]]
    status = next((attribute(e.tag, "status") for e in elements(body) if e.name == "header"), None)
    identifier = first_text(head, "identifier")
    metadata = span(body, "metadata")
    inner = body[metadata[0] : metadata[1]] if metadata else ""
    address, at = None, 0
    while (found := span(inner, "identifier", at)) is not None:
        value = inner[found[0] : found[1]].strip()
        if address is None and value.startswith(("http://", "https://", "doi:", "urn:")):
            address = value
        at = found[1] + 1
    return (identifier, first_text(head, "datestamp"), status == "deleted", first_text(inner, "title"), first_text(inner, "creator"), first_text(inner, "date"), first_text(inner, "language"), address or identifier)


def parse_page(body: str) -> tuple[list[tuple], str, str | None]:
    """Records, resumption token (empty at the end) and error code of a page; refuses what is no OAI-PMH."""
    if not any(e.name == "OAI-PMH" for e in elements(body)):
        raise ValueError("no OAI-PMH page")
    error = next((attribute(e.tag, "code") or "unknown" for e in elements(body) if e.name == "error"), None)
    if error:
        return [], "", error
    records, at = [], 0
    while (found := span(body, "record", at)) is not None:
        records.append(parse_record(body[found[0] : found[1]]))
        at = found[1] + 1
    return records, first_text(body, "resumptionToken") or "", None


def fetch_page(fetcher: Fetcher, url: str) -> tuple[list[tuple], str, str | None]:
    """A page, waiting as told while the server is busy."""
    for _ in range(MOST_TRIES):
        answer = fetcher.get(url)
        if answer.status != 503:
            break
        fetcher.sleep(min(answer.retry_after or DEFAULT_WAIT, MOST_WAIT))
    if answer.status != 200:
        raise OSError(f"status {answer.status}")
    return parse_page(answer.body)


def harvest(fetcher: Fetcher, base: str, token: str = "", most_pages: int = 0, **request: str) -> Iterator[tuple[list[tuple], str]]:
    """Pages of records with the token that follows; ends at an empty or a repeated token, or when pages run out."""
    pages = 0
    while True:
        records, following, error = fetch_page(fetcher, list_url(base, token=token, **request))
        if error and error != "noRecordsMatch":
            raise OSError(error)
        pages += 1
        again = bool(following) and following == token
        yield records, "" if again else following
        if not following or again or (most_pages and pages >= most_pages):
            return
        token = following


class OaiSource(DataSource):
    """spark.read.format("oai").option("base", ...): options prefix, set, from, until, pages; as a stream, one page a step.

    A harvest is a chain of pages, each named by the one before, so one task. `set` takes several sets and `cuts` dates
    between `from` and `until`, both separated by commas; each set and stretch of dates is a task of its own.
    """

    fetcher: type = HttpFetcher

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, self.fetcher)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options, self.fetcher)


def _request(options) -> dict[str, str]:
    return {"prefix": options.get("prefix", "oai_dc"), "set_": options.get("set", ""), "from_": options.get("from", ""), "until": options.get("until", "")}


def _day_before(day: str) -> str:
    return (datetime.date.fromisoformat(day) - datetime.timedelta(days=1)).isoformat()


def stretches(options) -> list[dict[str, str]]:
    """One request for each set and stretch of dates; bounds are inclusive, so a stretch ends the day before the next."""
    whole = _request(options)
    sets = [s.strip() for s in whole["set_"].split(",")] or [""]
    cuts = sorted(c.strip() for c in options.get("cuts", "").split(",") if c.strip())
    begins, ends = [whole["from_"], *cuts], [*(_day_before(c) for c in cuts), whole["until"]]
    return [whole | {"set_": s, "from_": a, "until": b} for s in sets for a, b in zip(begins, ends)]


class _Reader(DataSourceReader):
    def __init__(self, options, fetcher) -> None:
        self.options, self.fetcher = dict(options), fetcher

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in stretches(self.options)]

    def read(self, partition):
        for records, _ in harvest(self.fetcher(), self.options["base"], self.options.get("token", ""), int(self.options.get("pages", 0)), **partition.value):
            yield from records


class _StreamReader(SimpleDataSourceStreamReader):
    """Offsets are tokens; a finished harvest asks again from the last datestamp it saw."""

    def __init__(self, options, fetcher) -> None:
        self.options, self.fetcher = dict(options), fetcher

    def initialOffset(self) -> dict:
        return {"token": "", "from": self.options.get("from", ""), "done": 0}

    def _page(self, start: dict) -> tuple[list[tuple], dict]:
        request = _request(self.options) | {"from_": start["from"]}
        records, token, error = fetch_page(self.fetcher(), list_url(self.options["base"], token=start["token"], **request))
        if error and error != "noRecordsMatch":
            raise OSError(error)
        if token == start["token"]:
            token = ""
        last = max([start["from"], *[r[1] or "" for r in records]])
        return records, {"token": token, "from": last if not token else start["from"], "done": start["done"] + 1}

    def read(self, start: dict):
        if start["done"] and not start["token"] and not self.options.get("follow"):
            return iter([]), start
        records, end = self._page(start)
        return iter(records), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._page(start)[0])

    def commit(self, end: dict) -> None:
        pass
