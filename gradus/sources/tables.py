"""Tables inside text: HTML and Markdown tables as cells."""

from __future__ import annotations

import csv
import io
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

_INTS = [StructField(n, IntegerType()) for n in ("row", "col", "rowspan", "colspan")]
CELLS = ArrayType(StructType([*_INTS, StructField("header", BooleanType()), StructField("text", StringType())]))


#: Elements without content, and elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class _Table(HTMLParser):
    """Rows and cells of the first table, those of tables within its cells included, each row after all before it.

    Open elements are a stack, which an end tag closes down to its own element. A cell belongs to a row if it lies directly
    in it; its text is that of all pieces within, stripped, with a space between.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, object]] = []  # an element's name, and its row or cell if it is one
        self.rows: list[list[dict]] = []
        self.piece: list[str] = []
        self.began = self.over = False

    def end_piece(self):
        text = "".join(self.piece).strip()
        self.piece = []
        if text and not any(name in SILENT for name, _ in self.stack):
            for _, own in self.stack:
                if isinstance(own, dict):
                    own["text"].append(text)

    def handle_starttag(self, tag, attrs):
        self.end_piece()
        if self.over or tag in VOID:
            return
        own = None
        if tag == "table":
            self.began = True
        elif self.began and tag == "tr":
            own = []
            self.rows.append(own)
        elif tag in ("td", "th") and self.stack and isinstance(self.stack[-1][1], list):
            own = {"tag": tag, "attrs": dict(attrs), "text": []}
            self.stack[-1][1].append(own)
        if self.began:
            self.stack.append((tag, own))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.end_piece()
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if at is not None and not self.over:
            del self.stack[at:]
            self.over = not self.stack

    def handle_data(self, data):
        self.piece.append(data)

    def handle_comment(self, data):
        self.end_piece()


def _span(value: str | None) -> int:
    try:
        return max(1, int(value))
    except (TypeError, ValueError):
        return 1


def html_cells(html: str | None) -> list | None:
    """Cells of the first table, on a grid that knows of spans; a bad span counts as 1; null without a table.

    Rows of a table within a cell follow as rows of their own, and the cell holds their text too.
    """
    if not html or "<table" not in html.lower():
        return None
    p = _Table()
    p.feed(html)
    p.close()
    p.end_piece()
    cells, taken = [], set()
    for r, row in enumerate(p.rows):
        col = 0
        for cell in row:
            while (r, col) in taken:
                col += 1
            down, across = _span(cell["attrs"].get("rowspan")), _span(cell["attrs"].get("colspan"))
            taken |= {(r + i, col + j) for i in range(down) for j in range(across)}
            cells.append((r, col, down, across, cell["tag"] == "th", " ".join(" ".join(cell["text"]).split())))
            col += across
    return cells


_CELL = re.compile(r"((?:\\.|[^\\|]|\\$)*)(\||$)")  # a backslash takes the next character with it
_BAR = re.compile(r":?-{3,}:?")


def split_row(line: str) -> list[str]:
    """Cells of a pipe row; an escaped pipe belongs to its cell, an escaped backslash escapes nothing."""
    line = line.strip()
    parts = [(m[1], m[2]) for m in _CELL.finditer(line)]
    while len(parts) > 1 and parts[-1] == ("", "") and parts[-2][1] == "":
        parts.pop()  # the scan's empty match after the last cell
    cells = [c.strip().replace("\\|", "|") for c, _ in parts]
    return cells[line.startswith("|") : len(cells) - (len(parts) > 1 and parts[-1][0] == "" and parts[-2][1] == "|")]


def pipe_tables(text: str | None):
    """Pipe tables of a text, each a list of rows without the separator.

    Lines are told apart as bars, rows and others, and tables are found in the string of their kinds: a row, a bar of as
    many columns, and rows or bars up to the first other line.
    """
    lines = (text or "").splitlines()
    rows = [split_row(x) for x in lines]
    kinds = "".join("b" if r and all(map(_BAR.fullmatch, r)) else "r" if "|" in x else "." for x, r in zip(lines, rows))
    at = 0
    while m := re.compile("[rb]b[rb]*").search(kinds, at):
        i, j = m.span()
        if "|" in lines[i] and len(rows[i]) == len(rows[i + 1]):
            j = next((k for k in range(i + 2, j) if "|" not in lines[k]), j)
            yield [rows[i], *rows[i + 2 : j]]
            at = j
        else:
            at = i + 1


def as_cells(rows: list[list[str]], pad: bool = False) -> list[tuple]:
    """Rows as cells, the first row as header; padded to the longest row if asked."""
    wide = max(map(len, rows), default=0) if pad else 0
    return [(r, c, 1, 1, r == 0, t) for r, row in enumerate(rows) for c, t in enumerate(row + [""] * (wide - len(row)))]


def markdown_cells(text: str | None) -> list | None:
    """Cells of the first pipe table; ragged rows stay so."""
    return next(map(as_cells, pipe_tables(text)), None)


def all_markdown_cells(text: str | None) -> list[list]:
    """Cells of every pipe table of a text, each padded to its longest row."""
    return [as_cells(t, pad=True) for t in pipe_tables(text)]


def loose_markdown_cells(text: str | None) -> list | None:
    """Cells of all pipe rows of a text as one padded table, separators left out; null without a row."""
    rows = [r for x in (text or "").splitlines() if "|" in x and not all(map(_BAR.fullmatch, r := split_row(x)))]
    return as_cells(rows, pad=True) if rows else None


def csv_cells(text: str | None) -> list | None:
    """Cells of a delimited file's text, padded to its longest row."""
    rows = list(csv.reader(io.StringIO((text or "").lstrip("\ufeff"))))
    return as_cells(rows, pad=True) if rows else None


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)


def text_of(html: str | None) -> str | None:
    """Text of a piece of HTML, its parts apart by one space."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return " ".join(" ".join(p.parts).split())


@F.pandas_udf(StringType())
def html_text(s: pd.Series) -> pd.Series:
    return s.map(text_of, na_action="ignore")


def _udf(parse):
    @F.pandas_udf(CELLS)
    def cells(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if (c := parse(x)) is None else [dict(zip(("row", "col", "rowspan", "colspan", "header", "text"), t)) for t in c])

    return cells


html_table, markdown_table, loose_markdown_table, csv_table = map(_udf, (html_cells, markdown_cells, loose_markdown_cells, csv_cells))


@F.pandas_udf(ArrayType(CELLS))
def markdown_tables(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [[dict(zip(("row", "col", "rowspan", "colspan", "header", "text"), c)) for c in t] for t in all_markdown_cells(x)])
