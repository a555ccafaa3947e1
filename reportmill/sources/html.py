"""Report pages: index tables and detail pages, parsed in Arrow batches; there is no built-in DOM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels of a detail page.
LABELS = ("Occurred", "Reported", "Posted", "Location", "Shape", "Duration", "Characteristics")
INDEX_COLUMNS = ("occurred", "city", "state", "country", "shape", "summary", "reported", "media", "explanation")
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "table", "ul", "section", "article", "main", "td", "th"}


class _Table(HTMLParser):
    """Cells of the first table: text and first link of each."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[list[str]]] = []
        self.depth = self.tables = 0
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables += 1
            self.depth += 1
        if self.tables != 1 or not self.depth:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag == "td" and self.rows:
            self.cell = ["", ""]
            self.rows[-1].append(self.cell)
        elif tag == "a" and self.cell is not None and not self.cell[1]:
            self.cell[1] = dict(attrs).get("href") or ""

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "tr"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0] += data


class _Text(HTMLParser):
    """Text of a page, a line per block, without scripts, navigation and footers."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style", "nav", "footer", "header")
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style", "nav", "footer", "header") and self.skip > 0
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def page_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


def index_rows(html: str | None) -> list[tuple]:
    """(sighting_id, the index columns, is_tier1) of each row with at least nine cells and an id in its link."""
    parser = _Table()
    parser.feed(html or "")
    out = []
    for row in parser.rows:
        found = re.search(r"id=(\d+)", row[0][1]) if len(row) >= 9 else None
        if found:
            cells = [c[0].strip() for c in row[1:10]] + [""] * (10 - len(row))
            out.append((int(found.group(1)), *cells[:9], "!" in row[0][0]))
    return out


def detail_fields(html: str | None) -> dict[str, str]:
    """The labelled values (last of each) and the narrative after the last labelled line, without the footer."""
    lines = page_text(html).split("\n")
    out, last = dict.fromkeys((x.lower() for x in LABELS), ""), -1
    for k, line in enumerate(lines):
        found = re.match(rf"({'|'.join(LABELS)}):\s*(.*)$", line)
        if found:
            out[found.group(1).lower()] = found.group(2).strip()
            last = k
    return out | {"narrative": "\n".join(lines[last + 1 :]).strip()}


def parse_index(pages: DataFrame, column: str = "html") -> DataFrame:
    schema = "sighting_id long, " + ", ".join(f"{c} string" for c in INDEX_COLUMNS) + ", is_tier1 boolean"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for h in b[column] for r in index_rows(h)], columns=["sighting_id", *INDEX_COLUMNS, "is_tier1"])

    return pages.select(column).mapInPandas(parse, schema)


def parse_details(pages: DataFrame, key: str = "sighting_id", column: str = "html", stamp: bool = False) -> DataFrame:
    """(key, the labelled values, narrative) of each detail page; with ``stamp`` also ``scraped_at``, the time of the run as ISO-8601 in UTC."""
    names = [x.lower() for x in LABELS] + ["narrative"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [detail_fields(h) for h in b[column]]
            yield pd.DataFrame({key: b[key], **{n: [r[n] for r in rows] for n in names}})

    out = pages.select(key, column).mapInPandas(parse, f"{key} long, " + ", ".join(f"{n} string" for n in names))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.withColumn("scraped_at", now) if stamp else out
