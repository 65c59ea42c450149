"""Plain pages, many at once: their tables are cut out and split by columns, and what is left of them is read by its shape."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The pattern of plain tables in pages.py, as RE2 reads it.
TABLE = r'<table>(?:<tbody>)?(?:<tr>(?:<td>(?:[^<]|<br>|<a href="[^"<>&]*">[^<]*</a>)*</td>)+</tr>)*(?:</tbody>)?</table>'
EDGES = r"\A<table>(?:<tbody>)?<tr><td>|</td></tr>(?:</tbody>)?</table>\z"
#: What str.split() takes as blanks, and the tags of plain cells.
GAPS = r'(?:[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<br>|<a href="[^"]*">|</a>)+'
CUT, EMPTY = "\x01", "<table></table>"
_TAGS = re.compile("(<[^>]*>)")

#: Shapes that are remembered by a task.
SHAPES = 2_000


class Shape(NamedTuple):
    """What pages of the same tags have in common; texts are numbers of the runs between tags."""

    blocks: list[tuple]  #: (section, tag, class, tables before, ix without their links, texts, href)
    tables: list[tuple]  #: (number, section, texts of the heading)
    links: list[int]  #: tables whose links would be blocks


def squeezed(texts: list[str]) -> str:
    return " ".join(" ".join([unescape(t) if "&" in t else t for t in texts]).split())


class Many:
    """The blocks and table rows of the plain pages of a batch; others are left to the parser.

    A page is left too if no page of its shape was seen before, so pages that
    are all of different shapes cost no second reading.
    """

    def __init__(self, shape_of: Callable[[str], Shape | None], links: str):
        self.shape_of, self.linked, self.known = shape_of, re.compile(links or "<a ").search, {}

    def shape(self, tags: str) -> Shape | None:
        if tags not in self.known:
            if len(self.known) >= SHAPES:
                self.known.clear()
            self.known[tags] = None
        elif self.known[tags] is None:
            self.known[tags] = self.shape_of(tags) or ()
        return self.known[tags] or None

    def read(self, html: pa.Array) -> tuple[list[int], tuple[list, list], tuple[list, list, pa.Array]]:
        """Places of the pages left; (page, block) lists; (page, (section, heading, number), table) of the tables."""
        whole = pc.invert(pc.fill_null(pc.match_substring_regex(html, CUT), True)).to_pylist()
        left = [page for page, is_whole in enumerate(whole) if not is_whole]
        marked = pc.replace_substring_regex(html, TABLE, rf"{CUT}\0{CUT}").to_pylist()
        block_pages, blocks, table_pages, heads, wanted = [], [], [], [], []
        for page, cut in enumerate(marked):
            if not whole[page]:
                continue
            pieces = cut.split(CUT)
            runs = _TAGS.split(EMPTY.join(pieces[::2]))
            # The last run must end where the page does; all else that isn't plain is in the tags.
            shape = None if "<" in runs[-1] or "&" in runs[-1] else self.shape("".join(runs[1::2]))
            if shape is None or (shape.links and self.linked("".join(pieces[1::2]))):
                left.append(page)
                continue
            for section, tag, css, before, ix, texts, href in shape.blocks:
                if before:
                    ix += sum(t.count("<a ") for t in pieces[1 : 2 * before : 2])
                block_pages.append(page)
                blocks.append((section, tag, css, ix, squeezed([runs[2 * t] for t in texts]), href))
            for number, section, texts, table in shape.tables:
                table_pages.append(page)
                heads.append((section, squeezed([runs[2 * t] for t in texts]) if texts else "", number))
                wanted.append(pieces[1 + 2 * table])
        return left, (block_pages, blocks), (table_pages, heads, pa.array(wanted, pa.string()))


def rows(tables: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Rows of plain tables: the table's place, the row's number in it, texts, links of each cell, and the count of cells."""
    some = np.flatnonzero(pc.match_substring(tables, "<tr>").to_numpy(zero_copy_only=False))
    bodies = pc.replace_substring_regex(tables.take(pa.array(some)), EDGES, "")
    raw = pc.split_pattern(bodies, "</td></tr><tr><td>")
    at = raw.offsets.to_numpy()
    sizes = np.diff(at)
    number = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
    cells = pc.split_pattern(raw.values, "</td><td>")
    shown = pc.split_pattern(pc.split_pattern(pc.replace_substring_regex(bodies, GAPS, " "), "</td></tr><tr><td>").values, "</td><td>")
    texts = pc.ascii_trim(shown.values, characters=" ")
    coded = pc.match_substring(texts, "&")
    if pc.any(coded).as_py():
        texts = pc.replace_with_mask(texts, coded, pa.array([squeezed([t]) for t in texts.filter(coded).to_pylist()], texts.type))
    links = pc.split_pattern(cells.values, '<a href="')
    links_at = links.offsets.to_numpy()
    after = np.ones(links_at[-1], bool)
    after[links_at[:-1]] = False
    hrefs = pc.replace_substring_regex(links.values.filter(pa.array(after)), '(?s)".*', "")
    of_cell = pa.ListArray.from_arrays(pa.array(links_at - np.arange(len(links_at)), pa.int32()), hrefs)
    return np.repeat(some, sizes), number, pa.ListArray.from_arrays(shown.offsets, texts), pa.ListArray.from_arrays(cells.offsets, of_cell), np.diff(cells.offsets.to_numpy())
