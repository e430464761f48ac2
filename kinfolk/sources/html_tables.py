"""Tables of HTML pages as rows, and the table of each page that fits expected headers best.

A page is read once, tag by tag. Tables inside a cell of another are tables of their own and give that cell no text.
Cells that span rows or columns stand in every place they cover, so each row has a cell under each header.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.operators.matching import bounded

#: Most rows or columns that one cell is taken to span, as in browsers.
MOST_SPAN = 1000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_URL = re.compile(r"https?://[^\s)>\]\"']+")
_BREAKS = frozenset(("br", "p", "div"))


@dataclass
class Cell:
    rows: int = 1
    columns: int = 1
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).replace("\xa0", " ").split())

    def url(self) -> str | None:
        """The first absolute link, else the first address in the text."""
        absolute = [x for x in self.links if x.startswith(("http://", "https://"))]
        found = absolute[:1] or _URL.findall(self.text())[:1]
        return html.unescape(found[0]).strip().strip("<>").rstrip("/").removesuffix(".git") if found else None


@dataclass
class Table:
    rows: list[list[Cell]] = field(default_factory=list)
    row: list[Cell] | None = None
    cell: Cell | None = None

    def end_row(self) -> None:
        self.cell = None
        if self.row:
            self.rows.append(self.row)
        self.row = None


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _span(attributes: dict[str, str], name: str) -> int:
    value = attributes.get(name, "1").strip()
    return min(max(int(value), 1), MOST_SPAN) if value.isdigit() else 1


def page_tables(page: str) -> list[Table]:
    """All tables with a row, in the order in which they end."""
    done: list[Table] = []
    open_: list[Table] = []
    for m in _TOKEN.finditer(page):
        if m["text"]:
            if open_ and open_[-1].cell:
                open_[-1].cell.parts.append(m["text"])
            continue
        if not m["tag"]:
            continue
        tag, ending = m["tag"].lower(), bool(m["end"])
        if tag == "table" and not ending:
            open_.append(Table())
        elif not open_:
            continue
        elif tag == "table":
            open_[-1].end_row()
            if open_[-1].rows:
                done.append(open_[-1])
            open_.pop()
        elif tag == "tr":
            open_[-1].end_row()
            open_[-1].row = None if ending else []
        elif tag in ("td", "th"):
            open_[-1].cell = None
            if not ending and open_[-1].row is not None:
                attributes = _attributes(m["attrs"])
                open_[-1].cell = Cell(_span(attributes, "rowspan"), _span(attributes, "colspan"))
                open_[-1].row.append(open_[-1].cell)
        elif open_[-1].cell and not ending:
            if tag == "a" and (link := _attributes(m["attrs"]).get("href")):
                open_[-1].cell.links.append(link)
            if tag in _BREAKS:
                open_[-1].cell.parts.append("\n")
    for table in reversed(open_):  # pages that end inside a table
        table.end_row()
        done += [table] if table.rows else []
    return done


def grid(table: Table) -> list[list[Cell]]:
    """The rows of a table with a cell in every place that a span covers."""
    out: list[list[Cell]] = []
    held: dict[int, tuple[int, Cell]] = {}
    for row in table.rows:
        line: list[Cell] = []
        rest = list(row)
        while rest or len(line) in held:
            at = len(line)
            if at in held:
                left, cell = held.pop(at)
                line.append(cell)
                if left > 1:
                    held[at] = (left - 1, cell)
                continue
            cell = rest.pop(0)
            for _ in range(cell.columns):
                if len(line) in held:
                    break
                if cell.rows > 1:
                    held[len(line)] = (cell.rows - 1, cell)
                line.append(cell)
        # places held beyond the row's end wait for the rows below
        held = {k: (n - 1, c) if k >= len(line) else (n, c) for k, (n, c) in held.items()}
        held = {k: x for k, x in held.items() if x[0] > 0}
        out.append(line)
    return out


_CELL = pa.struct([("header", pa.string()), ("text", pa.string()), ("url", pa.string())])
CELLS = "array<struct<header:string,text:string,url:string>>"


def table_rows(pages: DataFrame, key: str, column: str = "html", spans: bool = True) -> DataFrame:
    """key, table_no, row_no (both from 0), cells of every row under a table's first one: the first row names the cells.

    Of two cells under one header the last counts; cells beyond the headers go. spans=False takes every cell for one place.
    Tables of one row, null pages and pages without tables give no rows.
    """
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[pages.schema[key].dataType.simpleString()]
    schema = pa.schema([(key, kind), ("table_no", pa.int32()), ("row_no", pa.int32()), ("cells", pa.list_(_CELL))])

    def rows_of(name: object, page: str | None) -> list[dict]:
        out = []
        for t, table in enumerate(page_tables(page or "")):
            lines = grid(table) if spans else table.rows
            heads = [c.text() for c in lines[0]]
            for r, line in enumerate(lines[1:]):
                cells = {h: {"header": h, "text": c.text(), "url": c.url()} for h, c in zip(heads, line)}
                out.append({key: name, "table_no": t, "row_no": r, "cells": list(cells.values())})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            found = [x for name, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in rows_of(name, page)]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return pages.select(key, column).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, table_no int, row_no int, cells {CELLS}")


def best_table(rows: DataFrame, key: str, weights: dict[str, int], with_url: int = 2) -> DataFrame:
    """The rows of the table of each key whose headers weigh most, with score; with_url is added where any cell has an
    address. The first of equals counts; tables without any weight are never chosen."""
    heads: Column = F.transform("cells", lambda c: c["header"])
    named = sum((F.when(F.array_contains(heads, h), n).otherwise(0) for h, n in weights.items()), F.lit(0))
    linked = F.exists("cells", lambda c: c["url"].isNotNull())
    # a table's first row has all of its headers; the window has one narrow row per table
    scored = rows.groupBy(key, "table_no").agg(F.max(F.when(F.col("row_no") == 0, named)).alias("n"), F.max(F.when(linked, with_url).otherwise(0)).alias("u"))
    ranked = scored.withColumn("score", F.col("n") + F.col("u")).filter("score > 0").withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "table_no")))
    return rows.join(ranked.filter("_r = 1").select(key, "table_no", "score"), [key, "table_no"])


def cell(name: str, part: str = "text") -> Column:
    """The text (or url) under a header; null without it."""
    return F.try_element_at(F.transform(F.filter("cells", lambda c: c["header"] == name), lambda c: c[part]), F.lit(-1))
