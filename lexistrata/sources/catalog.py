"""Catalog search pages as a Spark data source.

Pages follow a cursor, so that a read is one partition. The batch source stops at the wanted rows, at an empty page or at a
page without a cursor; a page that fails is asked for again and then fails the read, unless partial results are wanted. The
stream source's offset is the cursor: a page that fails leaves the offset where it is, so that nothing is passed over, and
what lies between two offsets is read again page by page.
"""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from lexistrata.sources.transport import Transport, http_get

SCHEMA = "ord long, record string"


def page_url(endpoint: str, query: str, per_page: int, after: str = "") -> str:
    """The address of a page; a query for everything is left out."""
    params = {"per_page": per_page} | ({"q": query} if query and query != "*:*" else {}) | ({"after": after} if after else {})
    return f"{endpoint}?{urlencode(params)}"


def get_page(url: str, get: Transport = http_get, timeout: int = 30) -> dict:
    """A page as an object; anything else is a ``RuntimeError`` that says what came."""
    try:
        body, _ = get(url, timeout, 1 << 62)
    except HTTPError as error:
        text = error.read()[:500].decode("utf-8", "replace").replace("\n", " ")
        raise RuntimeError(f"HTTP {error.code} from {url}: {text}") from error
    except (URLError, OSError) as error:
        raise RuntimeError(str(error)) from error
    try:
        page = json.loads(body)
    except ValueError as error:
        raise RuntimeError("invalid JSON response") from error
    if not isinstance(page, dict):
        raise RuntimeError("catalog response was not an object")
    return page


def page_results(page: dict) -> list[dict]:
    """The objects of ``results``, of the page or of its ``data`` or ``result``."""
    found = page.get("results")
    for name in ("data", "result"):
        if found is None and isinstance(page.get(name), dict):
            found = page[name].get("results")
    return [item for item in found if isinstance(item, dict)] if isinstance(found, list) else []


def canonical_record(result: dict) -> dict:
    """A search result with the members that later stages ask for; those that are there stay, even if null."""
    dcat = result.get("dcat") if isinstance(result.get("dcat"), dict) else {}
    places = (result, "distribution"), (result, "distributions"), (result, "resources"), (dcat, "distribution"), (dcat, "distributions")
    distributions = next((holder[name] for holder, name in places if holder.get(name)), [])
    made = {
        "id": result.get("id") or dcat.get("identifier") or result.get("identifier"),
        **{name: result.get(name) or dcat.get(name) for name in ("title", "description", "identifier", "keyword", "publisher")},
        "dcat": dcat,
        "distributions": distributions,
        "resources": result.get("resources") or distributions,
        "harvest_record": result.get("harvest_record"),
        "harvest_record_raw": result.get("harvest_record_raw"),
    }
    return made | result | {"raw_result": result}


def search_pages(
    endpoint: str,
    query: str = "",
    *,
    rows: int = 1000,
    per_page: int = 100,
    sleep: float = 0.2,
    after: str = "",
    get: Transport = http_get,
    partial: bool = True,
    attempts: int = 3,
    failed: Callable[[str], None] | None = None,
) -> Iterator[tuple[list[dict], str]]:
    """Results and the next cursor, page by page.

    A page is asked for up to ``attempts`` times. One that fails then ends the pages after ``failed`` was told why, or
    raises where ``partial`` results are not wanted.
    """
    wanted = rows
    while wanted > 0:
        size = min(per_page, wanted)
        for attempt in range(attempts):
            try:
                page = get_page(page_url(endpoint, query, size, after), get)
                break
            except RuntimeError as error:
                if attempt + 1 < attempts:
                    time.sleep(sleep * 2**attempt)
                    continue
                if not partial:
                    raise
                if failed:
                    failed(str(error))
                return
        results = page_results(page)[:size]
        cursor = page.get("after")
        after = cursor if isinstance(cursor, str) else ""
        if not results:
            return
        yield results, after
        wanted -= len(results)
        if not after:
            return
        time.sleep(sleep)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, get: Transport) -> None:
        self.options, self.get = dict(options), get

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:  # noqa: ARG002
        o, n = self.options, 0
        pages = search_pages(
            o["endpoint"], o.get("query", ""), rows=int(o.get("rows", 1000)), per_page=int(o.get("perPage", 100)),
            sleep=float(o.get("sleep", 0.2)), get=self.get, partial=o.get("partial", "false").lower() == "true",
        )
        for results, _ in pages:
            for result in results:
                n += 1
                yield n, json.dumps(canonical_record(result), ensure_ascii=False)


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, get: Transport) -> None:
        self.options, self.get = dict(options), get

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": "", "n": 0, "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """One page. A page that fails raises, so that the offset stays and the stream asks for it again."""
        if start["done"]:
            return iter([]), start
        o = self.options
        size = int(o.get("perPage", 100))
        asked = search_pages(
            o["endpoint"], o.get("query", ""), rows=size, per_page=size, sleep=float(o.get("sleep", 0.2)), after=start["after"], get=self.get, partial=False
        )
        pages = list(itertools.islice(asked, 1))
        rows = [(start["n"] + i + 1, json.dumps(canonical_record(r), ensure_ascii=False)) for i, r in enumerate(r for p, _ in pages for r in p)]
        after = pages[-1][1] if pages else ""
        return iter(rows), {"after": after, "n": start["n"] + len(rows), "done": not after}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """All pages from one offset to another."""
        while start != end and not start["done"]:
            rows, start = self.read(start)
            yield from rows


class CatalogSource(DataSource):
    """``spark.read.format("catalog_search").option("endpoint", ...)``, also as a stream."""

    transport: Transport = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "catalog_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return _Reader(self.options, type(self).transport)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802, ARG002
        return _StreamReader(self.options, type(self).transport)
