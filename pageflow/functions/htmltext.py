"""HTML as text, by the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# What stands between the cells of a row, within a table and outside one.
CELL_GAP, LOOSE_GAP = "    ", " | "
_TABLE_PART = re.compile(r"<\s*(?:table|tr|td|th)\b", re.I)


class _Text(HTMLParser):
    """Collects text; tables become lines of filled cells, and cells outside a table are parted by bars."""

    def __init__(self, tables: bool):
        super().__init__(convert_charrefs=True)
        self.tables = tables
        self.out: list[str] = []
        self.rows: list[list[str]] | None = None  # of the table that is open
        self.cell: list[str] | None = None
        self.loose = False  # a cell outside a table has just ended

    def handle_starttag(self, tag: str, attrs: list) -> None:
        target = self.out if self.cell is None else self.cell
        if tag == "br":
            target.append("\n")
        elif not self.tables:
            return
        elif tag == "table" and self.rows is None:
            self.rows, self.kept = [], len(self.out)
        elif tag == "tr":
            self.rows.append([]) if self.rows is not None else self.out.append("\n")
        elif tag in ("td", "th"):
            if self.rows is not None:
                self.cell = []
            elif self.loose:
                while self.out and not self.out[-1].strip():  # the space between two cells
                    self.out.pop()
                self.out.append(LOOSE_GAP)
        self.loose = False

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            (self.out if self.cell is None else self.cell).append("\n")
        if not self.tables:
            return
        if tag in ("td", "th"):
            if self.cell is not None:
                self._end_cell()
            self.loose = self.rows is None
        elif tag == "tr" and self.rows is None:
            self.out.append("\n")
        elif tag == "table":
            self._end_table()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.loose = False
        (self.out if self.cell is None else self.cell).append(data)

    def _end_cell(self) -> None:
        text = re.sub(r"[ \t\r\f\v]+", " ", "".join(self.cell or [])).strip()
        if text and self.rows is not None:
            (self.rows or self.rows.append([]) or self.rows)[-1].append(text)
        self.cell = None

    def _end_table(self) -> None:
        if self.rows is None:
            return
        lines = [CELL_GAP.join(row) for row in self.rows if row]
        if lines:
            del self.out[self.kept :]
            self.out.append("\n".join(lines))
        self.rows = self.cell = None

    def text(self, source: str) -> str:
        self.feed(source)
        self.close()
        if self.cell is not None:
            self._end_cell()
        self._end_table()
        return "".join(self.out).strip()


def html_to_text(text: str | None) -> str | None:
    """HTML as text: line and paragraph ends kept, tags dropped, entities read."""
    return None if text is None else _Text(False).text(text)


def tables_to_text(text: str | None) -> str | None:
    """A text with tables: each row a line of its filled cells, other tags dropped; a text without any is unchanged."""
    return _Text(True).text(text) if text and _TABLE_PART.search(text) else text
