"""Sources by name: Python data sources for landing folders, and a run over many sources that one bad one doesn't stop.

Each source lists its files on the driver, a partition each (Parquet: one per row
group), and reads them in tasks.  Filters on ``ticker`` and ``doc_date`` are
pushed into it: files whose name tells that they can't match are not opened.
Folders are any that Arrow's file systems read.
"""

from __future__ import annotations

import datetime as dt
import html
import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from tidemark.operators.scratch import written
from tidemark.sources import readers

DOCUMENT = "ticker string, doc_type string, doc_date date, title string, source_url string, text string, source string"
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}


def visible_text(page: str) -> str:
    """Text of HTML without scripts, styles and tags, white space collapsed; entities stay."""
    page = re.sub(r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ", page)
    return re.sub(r"[ \t\r\n]+", " ", re.sub(r"<[^>]*>", " ", page)).strip(" ")


def day_of(text: str | None) -> dt.date | None:
    """The date of ``2 Jan 2025``, ``02-Jan-2025`` or ``2025-01-02`` anywhere in a text."""
    text = text or ""
    try:
        if m := re.search(r"(\d{4})-(\d{2})-(\d{2})", text):
            return dt.date(*map(int, m.groups()))
        if m := re.search(r"(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[ -](\d{4})", text):
            return dt.date(int(m[3]), MONTHS[m[2].lower()], int(m[1]))
    except (ValueError, KeyError):
        pass
    return None


@dataclass
class Piece(InputPartition):
    """A file, or one row group of it."""

    path: str
    group: int = -1


@dataclass
class Wanted:
    """What pushed filters ask for."""

    tickers: set[str] | None = None
    since: dt.date | None = None

    def take(self, f: Filter) -> bool:
        """Whether the filter is one that every row is held against here."""
        if isinstance(f, (EqualTo, In)) and f.attribute == ("ticker",):
            some = set(f.value) if isinstance(f, In) else {f.value}
            self.tickers = some if self.tickers is None else self.tickers & some
            return True
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("doc_date",) and isinstance(f.value, dt.date):
            first = f.value + dt.timedelta(days=isinstance(f, GreaterThan))
            self.since = first if self.since is None else max(self.since, first)
            return True
        return False

    def fits(self, ticker: str | None, day: dt.date | None) -> bool:
        return (self.tickers is None or ticker in self.tickers) and (self.since is None or (day is not None and day >= self.since))


@dataclass
class FolderReader(DataSourceReader):
    source: FolderSource
    wanted: Wanted = field(default_factory=Wanted)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.source.options["path"])
        found = store.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        named = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.endswith(self.source.suffix) and not f.base_name.startswith(("_", ".")))
        return [p for f in named if self.may_match(f) for p in self.source.pieces(store, f)]

    def may_match(self, path: str) -> bool:
        """Files named ``<TICKER>_..._<date>`` that can't match are not opened."""
        parts = path.rsplit("/", 1)[-1].removesuffix(self.source.suffix).split("_")
        if len(parts) < 3 or not self.source.by_name:
            return True
        day = day_of(parts[-1])
        return (self.wanted.tickers is None or parts[0].upper() in self.wanted.tickers) and (self.wanted.since is None or day is None or day >= self.wanted.since)

    def read(self, piece: Piece) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.source.options["path"])
        for row in self.source.rows(store, piece):
            if self.wanted.fits(row[0], row[2]):
                yield (*row, self.source.name().removeprefix("tidemark_"))


class FolderSource(DataSource):
    """Documents from the files under ``path``; ``ticker`` names their company where the files don't."""

    suffix, by_name = "", False

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema: Any) -> DataSourceReader:
        return FolderReader(self)

    def pieces(self, store: Any, path: str) -> list[Piece]:
        return [Piece(path)]

    def ticker(self, path: str) -> str:
        return (self.options.get("ticker") or path.rsplit("/", 1)[-1].split("_")[0].removesuffix(self.suffix)).upper()

    def content(self, store: Any, piece: Piece) -> str:
        with store.open_input_stream(piece.path) as f:
            return f.read().decode("utf-8", "replace")

    def rows(self, store: Any, piece: Piece) -> Iterator[tuple]:
        """(ticker, doc_type, doc_date, title, source_url, text) of a piece."""
        raise NotImplementedError


class Filings(FolderSource):
    """``<TICKER>_<form>_<date>.html``: the section between the patterns ``start`` and ``end`` if named, else all."""

    suffix, by_name = ".html", True

    @classmethod
    def name(cls) -> str:
        return "tidemark_filings"

    def rows(self, store: Any, piece: Piece) -> Iterator[tuple]:
        parts = piece.path.rsplit("/", 1)[-1].removesuffix(".html").split("_")
        text = html.unescape(visible_text(self.content(store, piece)))
        if start := self.options.get("start"):
            heads = [m.start() for m in re.finditer(start, text, re.I)]  # an earlier one is the table of contents
            text = text[heads[-1] :] if heads else text
            end = re.search(self.options.get("end", r"\Z"), text[readers.MDNA_LEAST :], re.I) if heads else None
            text = text[: readers.MDNA_LEAST + end.start()] if end else text
        if len(parts) >= 3 and (day := day_of(parts[-1])):
            yield parts[0].upper(), "_".join(parts[1:-1]), day, None, piece.path, text[: readers.MDNA_CHARS]


class Feed(FolderSource):
    """RSS files: the first ``items`` of each; an item without a date that can be read has none."""

    suffix = ".xml"

    @classmethod
    def name(cls) -> str:
        return "tidemark_feed"

    def rows(self, store: Any, piece: Piece) -> Iterator[tuple]:
        root = ElementTree.fromstring(self.content(store, piece))
        for item in list(root.iter("item"))[: int(self.options.get("items", readers.FEED_ITEMS))]:
            title, link, body, at = (item.findtext(c) for c in ("title", "link", "description", "pubDate"))
            yield self.ticker(piece.path), "news", day_of(at), title, link, "\n".join(x for x in (title, html.unescape(visible_text(body or ""))) if x is not None)


class Announcements(FolderSource):
    """JSON arrays of exchange announcements; entries with a bad date are left out."""

    suffix = ".json"

    @classmethod
    def name(cls) -> str:
        return "tidemark_announcements"

    def rows(self, store: Any, piece: Piece) -> Iterator[tuple]:
        for x in json.loads(self.content(store, piece)):
            if day := day_of(x.get("an_dt")):
                yield self.ticker(piece.path), "announcement", day, x.get("desc"), x.get("attchmntFile"), x.get("attchmntText")


class Pages(FolderSource):
    """Parquet of crawled pages (url, html): the ticker is the host's first label, the day that of ``fetched``."""

    suffix = ".parquet"

    @classmethod
    def name(cls) -> str:
        return "tidemark_pages"

    def pieces(self, store: Any, path: str) -> list[Piece]:
        import pyarrow.parquet as pq

        with store.open_input_file(path) as f:
            return [Piece(path, g) for g in range(pq.ParquetFile(f).num_row_groups)]

    def rows(self, store: Any, piece: Piece) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        day = day_of(self.options.get("fetched"))
        with store.open_input_file(piece.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(256, row_groups=[piece.group], columns=["url", "html"]):
                for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
                    host = re.sub(r"^[a-z]+://", "", url or "").split("/")[0]
                    yield host.split(".")[0].upper(), "page", day, None, url, visible_text(page or "")


SOURCES = (Filings, Feed, Announcements, Pages)


def register(spark: SparkSession) -> list[str]:
    """Makes all sources known to ``spark.read.format`` and lets Spark push filters into them; returns their names."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES:
        spark.dataSource.register(source)
    return [source.name() for source in SOURCES]


# --- many sources --------------------------------------------------------------


@dataclass(frozen=True)
class Request:
    """One source for one company; a source is a registered format or a reader of ``readers``."""

    source: str
    options: dict[str, Any]
    ticker: str | None = None


@dataclass(frozen=True)
class Failure:
    source: str
    ticker: str | None
    error: str


def _load(spark: SparkSession, request: Request) -> DataFrame | None:
    options = dict(request.options) | ({"ticker": request.ticker} if request.ticker else {})
    if request.source in readers.READERS:
        return readers.READERS[request.source](spark, **options)
    if request.source in {s.name() for s in SOURCES}:
        since = options.pop("since", None)
        rows = spark.read.format(request.source).options(**options).load()
        return rows if since is None else rows.where(rows["doc_date"] >= dt.date.fromisoformat(str(since)))
    return None


def _reason(error: Exception) -> str:
    """The line that says most: of a source's own traceback the last exception, else the first line."""
    lines = [x.strip() for x in str(error).split("\n")]
    own = [x for x in lines if re.match(r"[\w.]+(Error|Exception): ", x)]
    return (own[-1] if own else f"{type(error).__name__}: {lines[0]}")[:300]


def fetch_all(spark: SparkSession, requests: list[Request], retries: int = 2, wait: Callable[[int], None] = lambda attempt: time.sleep(2**attempt)) -> tuple[DataFrame | None, list[Failure]]:
    """The documents of all requests, and those that failed after their retries.

    Each request is read to its end and written by itself, so a source that
    breaks half way leaves nothing and stops no other.  Names that nobody knows
    are passed over.  None if there is nothing at all."""
    got, failures = None, []
    for request in requests:
        for attempt in range(retries + 1):
            try:
                rows = _load(spark, request)
                one = None if rows is None else written(rows)
                break
            except Exception as e:  # noqa: BLE001 - whatever a source raises, the others go on
                one = None
                if attempt == retries:
                    failures.append(Failure(request.source, request.ticker, _reason(e)))
                else:
                    wait(attempt)
        if one is not None:
            got = one if got is None else got.unionByName(one, allowMissingColumns=True)
    return got, failures
