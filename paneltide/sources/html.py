"""Stored HTML pages as a source: one page -> many rows (``mapInPandas``).

Each output row is a text block (title, heading, paragraph, list item) or a
table row (its cells).  ``select_tables`` keeps the tables whose header row
holds every required column name (the "first table / tables having W and L"
selection), with a semi join on (page, table).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = {"title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li"}
SKIP_TAGS = {"script", "style"}
ROW_SCHEMA = ("page_id long, block_no int, tag string, text string, "
              "table_no int, row_no int, cells array<string>")
_WS = re.compile(r"\s+")


#: the largest spans that HTML allows
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534


def _span(attrs, name: str, most: int) -> int:
    value = (dict(attrs).get(name) or "").strip()
    return min(max(int(value), 1), most) if value.isdecimal() else 1


class _Table:
    """State of one open table: nested tables have their own."""

    def __init__(self, number: int):
        self.number = number
        self.row_no = -1
        self.row = None          # [(text, colspan, rowspan)] of the open row
        self.cell = None         # text pieces of the open cell
        self.span = (1, 1)
        self.carried = {}        # column -> (text, rows it still covers)

    def open_row(self):
        self.row, self.row_no = [], self.row_no + 1

    def close_cell(self):
        if self.cell is not None and self.row is not None:
            self.row.append((_WS.sub(" ", "".join(self.cell)).strip(), *self.span))
        self.cell = None

    def close_row(self) -> list[str] | None:
        """The cells of the row, spans expanded: a cell stands in every column and row it covers."""
        self.close_cell()
        row, self.row = self.row, None
        if not row:
            return None
        out, below = [], {}

        def fill():
            while (got := self.carried.pop(len(out), None)) is not None:
                if got[1] > 1:
                    below[len(out)] = (got[0], got[1] - 1)
                out.append(got[0])

        for text, cols, rows in row:
            fill()
            for _ in range(cols):
                if rows > 1:
                    below[len(out)] = (text, rows - 1)
                out.append(text)
        fill()
        self.carried = below
        return out


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows = []          # (block_no, tag, text, table_no, row_no, cells)
        self.skip = 0
        self.block_tag = None
        self.buf = []
        self.n_tables = 0
        self.open = []          # open tables, the innermost last

    @property
    def table(self):
        return self.open[-1] if self.open else None

    def _close_block(self):
        if self.block_tag is not None:
            text = _WS.sub(" ", "".join(self.buf)).strip()
            if text:
                self.rows.append((len(self.rows), self.block_tag, text, None, None, None))
        self.block_tag, self.buf = None, []

    def _close_row(self):
        t = self.table
        cells = t.close_row() if t else None
        if cells:
            self.rows.append((len(self.rows), "tr", " | ".join(cells), t.number, t.row_no, cells))

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TAGS:
            self.skip += 1
            return
        t = self.table
        if tag == "table":
            self.open.append(_Table(self.n_tables))
            self.n_tables += 1
        elif tag == "tr" and t:
            self._close_row()
            t.open_row()
        elif tag in ("td", "th") and t and t.row is not None:
            t.close_cell()
            t.cell, t.span = [], (_span(attrs, "colspan", MAX_COLSPAN), _span(attrs, "rowspan", MAX_ROWSPAN))
        elif tag in BLOCK_TAGS and not (t and t.cell is not None):
            self._close_block()
            self.block_tag = tag
        elif tag == "br":
            self._data(" ")

    def handle_endtag(self, tag):
        t = self.table
        if tag in SKIP_TAGS:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th"):
            if t:
                t.close_cell()
        elif tag == "tr":
            self._close_row()
        elif tag == "table":
            self._close_row()
            if self.open:
                self.open.pop()
        elif tag == self.block_tag:
            self._close_block()

    def _data(self, data):
        t = self.table
        if t and t.cell is not None:
            t.cell.append(data)
        elif self.block_tag is not None:
            self.buf.append(data)

    def handle_data(self, data):
        if not self.skip:
            self._data(data)

    def close(self):
        super().close()
        while self.open:
            self._close_row()
            self.open.pop()
        self._close_block()


def parse_page(html: str):
    p = _Blocks()
    p.feed(html or "")
    p.close()
    return p.rows


def _extract(batches):
    for b in batches:
        out = {"page_id": [], "block_no": [], "tag": [], "text": [], "table_no": [], "row_no": [], "cells": []}
        for pid, html in zip(b["page_id"].to_numpy(), b["html"].to_numpy()):
            for block_no, tag, text, table_no, row_no, cells in parse_page(html):
                out["page_id"].append(int(pid))
                out["block_no"].append(block_no)
                out["tag"].append(tag)
                out["text"].append(text)
                out["table_no"].append(table_no)
                out["row_no"].append(row_no)
                out["cells"].append(cells)
        df = pd.DataFrame(out)
        for c in ("block_no", "table_no", "row_no"):
            df[c] = df[c].astype("Int32")
        yield df


def html_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every text block and table row of every page (pages are parsed where
    they are stored; only the rows travel)."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return src.mapInPandas(_extract, ROW_SCHEMA)


def select_tables(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows of the tables whose header row (row 0) contains all ``required`` names.
    ``rows`` is read twice (headers, then rows): it is materialised once so
    pages are not parsed twice."""
    from ..session import materialize
    rows = materialize(rows)
    need = F.array(*[F.lit(c) for c in required])
    headers = rows.where((F.col("tag") == "tr") & (F.col("row_no") == 0)) \
        .where(F.size(F.array_except(need, F.col("cells"))) == 0).select("page_id", "table_no")
    return rows.where(F.col("tag") == "tr").join(headers, ["page_id", "table_no"], "left_semi")


def first_table(rows: DataFrame) -> DataFrame:
    """Rows of each page's first table (the ``read_html(...)[0]`` choice)."""
    return rows.where((F.col("tag") == "tr") & (F.col("table_no") == 0))


def standings_from_rows(rows: DataFrame, dictionary: DataFrame, win_col: str = "W", loss_col: str = "L",
                        name: str = "name", code: str = "code") -> DataFrame:
    """Win/loss table from scraped standings: tables whose header has both
    outcome columns, first column = team name with its marker stripped,
    name -> code through the dictionary (unmapped rows dropped), first
    occurrence per (page, code) kept in (table, row) order, counts as int."""
    from ..functions.nulls import try_number
    from ..operators.joins import dim_lookup
    from ..operators.panel import dedup_first
    tables = select_tables(rows, [win_col, loss_col])
    header = tables.where(F.col("row_no") == 0).select(
        "page_id", "table_no",
        F.array_position("cells", win_col).cast("int").alias("_wi"),
        F.array_position("cells", loss_col).cast("int").alias("_li"))
    body = tables.where(F.col("row_no") > 0).join(header, ["page_id", "table_no"])
    parsed = body.select(
        "page_id", "table_no", "row_no",
        F.trim(F.replace(F.try_element_at("cells", F.lit(1)), F.lit("*"), F.lit(""))).alias("_name"),
        try_number(F.try_element_at("cells", F.col("_wi")), "int").alias("wins"),
        try_number(F.try_element_at("cells", F.col("_li")), "int").alias("losses"))
    mapped = dim_lookup(parsed, dictionary.select(F.col(name).alias("_name"), F.col(code).alias("team")),
                        "_name", "_name", "team").where(F.col("team").isNotNull())
    first = dedup_first(mapped.select("page_id", "team", "table_no", "row_no", "wins", "losses"),
                        ["page_id", "team"], ["table_no", "row_no"])
    return first.select("page_id", "team", "wins", "losses").orderBy("page_id", "team")
