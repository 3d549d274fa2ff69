"""Tables of HTML pages, however broken: a tokenising reader in Arrow batches.

Tags need not be closed: a new cell ends the open one, a new row the open row, a section its rows, and the end of the
page everything. Scripts, styles and comments are no text; entities are characters. A table inside a cell is a table of
its own, after the one around it, and its text is in that cell, too.

colspan and rowspan repeat a cell's text (in their section; 0 rows: to its end); the format's own bounds, 1,000 columns
and 65,534 rows, hold. Header rows are those of thead, or else the first rows with th cells alone. A column's name is
its header texts from above, joined by a space where there are several rows and nothing is repeated; without one it is
Col_i, and without header rows its number. Columns and then rows without any text in the body go.
"""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

COLUMNS, ROWS = 1000, 65534
SECTIONS = {"thead": 0, "tbody": 1, "tfoot": 2}
#: Cells in a batch of results.
BATCH = 20_000


class Table:
    """Rows of (is th, columns, rows, text parts) cells by section."""

    def __init__(self):
        self.rows: list[tuple[int, list]] = []
        self.section, self.row, self.cell = 1, None, None

    def open_row(self) -> None:
        self.row, self.cell = [], None
        self.rows.append((self.section, self.row))


def span(attrs: dict, name: str, most: int) -> int:
    digits = (attrs.get(name) or "").strip()
    return min(int(digits), most) if digits.isascii() and digits.isdigit() and len(digits) < 10 else most if digits.isascii() and digits.isdigit() else 1


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[Table] = []
        self.open: list[Table] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent = 1
        elif tag == "table":
            self.open.append(Table())
            self.tables.append(self.open[-1])
        elif not self.open:
            return
        elif tag in SECTIONS:
            self.open[-1].section, self.open[-1].row, self.open[-1].cell = SECTIONS[tag], None, None
        elif tag == "tr":
            self.open[-1].open_row()
        elif tag in ("td", "th"):
            own, given = self.open[-1], dict(attrs)
            if own.row is None:
                own.open_row()
            own.cell = (tag == "th", max(1, span(given, "colspan", COLUMNS)), span(given, "rowspan", ROWS), [])
            own.row.append(own.cell)
        elif tag in ("br", "p", "div", "li"):
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = 0
        elif not self.open:
            return
        elif tag == "table":
            self.open.pop()
        elif tag in ("td", "th"):
            self.open[-1].cell = None
        elif tag == "tr":
            self.open[-1].row = self.open[-1].cell = None
        elif tag in SECTIONS:
            self.open[-1].section, self.open[-1].row, self.open[-1].cell = 1, None, None

    def handle_data(self, data):
        if not self.silent:
            for table in self.open:
                if table.cell is not None:
                    table.cell[3].append(data)


def laid_out(rows: list[list]):
    """For each row of a section the texts of its cells, each in all places that it spans."""
    above: dict[int, tuple[int, str]] = {}  # column -> rows that its cell still spans, its text
    for i, row in enumerate(rows):
        line, below = [], {}

        def put(text, high, line=line, below=below):
            if high > 1:
                below[len(line)] = (high - 1, text)
            line.append(text)

        def spanned(line=line, above=above, put=put):
            while len(line) in above:
                high, text = above.pop(len(line))
                put(text, high)

        spanned()
        for _, wide, high, parts in row:
            text = " ".join("".join(parts).split())
            for _ in range(wide):
                put(text, min(high or ROWS, len(rows) - i))
                spanned()
        for at in sorted(above):  # spans beyond the row's own cells
            if at in above:
                line += [""] * (at - len(line))
                spanned()
        above = below
        yield line


def parsed(html: str):
    """(table, row, column, header, value) of a page's cells with text."""
    reader = Reader()
    reader.feed(html)
    reader.close()
    for number, table in enumerate(reader.tables):
        parts = [[row for at, row in table.rows if at == section and row] for section in range(3)]
        if not parts[0]:
            while parts[1] and all(cell[0] for cell in parts[1][0]):
                parts[0].append(parts[1].pop(0))
        head = list(laid_out(parts[0]))
        head = [line for line in head if any(line)] or head[:1]
        body = lambda: chain(laid_out(parts[1]), laid_out(parts[2]))  # noqa: B023, E731
        used = sorted({at for line in body() for at, text in enumerate(line) if text})
        names = {}
        for at in used:
            levels = [line[at] for line in head if at < len(line) and line[at]]
            levels = [x for i, x in enumerate(levels) if i == 0 or x != levels[i - 1]]
            names[at] = " ".join(levels) or (f"Col_{at}" if head else str(at))
        for i, line in enumerate(body()):
            for at, text in enumerate(line):
                if text:
                    yield number, i, at, names[at], text


def tables(df: DataFrame, row: str, html: str) -> DataFrame:
    """(row, table, line, at, header, value): the cells with text of all tables; null and table-less pages have none. A task holds one page's cells and a batch."""
    kind = df.schema[row].dataType.simpleString()
    names = [row, "table", "line", "at", "header", "value"]
    types = [pa.int32()] * 3 + [pa.string()] * 2

    def run(batches):
        for b in batches:
            origin, cells = [], []

            def batch(b=b, origin=origin, cells=cells):
                columns = list(zip(*cells, strict=True)) or [()] * 5
                out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(origin, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)
                origin.clear()
                cells.clear()
                return out

            for i, page in enumerate(b.column(1)):
                for cell in parsed(page.as_py() or ""):
                    origin.append(i)
                    cells.append(cell)
                    if len(cells) == BATCH:
                        yield batch()
            yield batch()

    return df.select(row, html).mapInArrow(run, f"{row} {kind}, table int, line int, at int, header string, value string")
