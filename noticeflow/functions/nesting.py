"""Nesting of the tags of a page: one walk over their names, which column expressions can't do.

All that depends on one tag alone (names, attributes, styles, addresses) is
worked out by expressions in ``markup``; this walk only sees codes.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .. import settings as S

#: An open element that is met again ends, unless one of the others is in between.
_PEERS = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol"))), **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))), **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    "tr": (("tr",), ("table",)), **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "caption"), ("table",))), "a": (("a",), ("td", "th", "caption")),
}
_CELLS = ("td", "th", "caption", "table")
_IN_TABLES = ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption")
_ENDS_PARAGRAPH = frozenset(S.BLOCK_TAGS)
_BLANKABLE = ("p", "div")
_IMAGE = -2


class _Walk:
    """Open elements, and what is kept: at (place of the tag or text), close, size and setter of each."""

    def __init__(self):
        self.kept: list[list] = []
        self.open: list[tuple[str, int, int, int]] = []  # name, entry, letters and content before it
        self.names: Counter[str] = Counter()
        self.letters = self.content = 0
        self.gap = self.ran = False  # whether a run of text goes on, and ended in white space

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            name, entry, letters, content = self.open.pop()
            self.names[name] -= 1
            if name in _BLANKABLE and self.content == content:
                self.kept[entry:] = [x for x in self.kept[entry:] if x[3] == _IMAGE]  # they are counted, though not shown
                continue
            self.kept[entry][2] = self.letters - letters
            self.kept.append([self.kept[entry][0], True, 0, -1])
            self.ran = False

    def nearest(self, names: tuple[str, ...], borders: tuple[str, ...]) -> int:
        """Place among the open elements of the innermost of ``names``, -1 if there is none inside the borders."""
        if not any(self.names[n] for n in names):
            return -1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                return k
            if self.open[k][0] in borders:
                break
        return -1

    def start(self, at: int, name: str, mark: bool) -> None:
        if name in _ENDS_PARAGRAPH and (k := self.nearest(("p",), _CELLS)) >= 0:
            self.pop_to(k)
        if name in _PEERS and (k := self.nearest(*_PEERS[name])) >= 0:
            self.pop_to(k)
        prose = name in S.PROSE_TAGS
        over = self.kept[self.open[-1][1]][3] if self.open else -1
        self.open.append((name, len(self.kept), self.letters, self.content))
        self.names[name] += 1
        self.content += name not in _BLANKABLE
        self.kept.append([at, False, 0, len(self.kept) if prose and mark else over])
        self.ran = False

    def end(self, name: str) -> None:
        if (k := self.nearest((name,), () if name in _IN_TABLES else _CELLS)) >= 0:
            self.pop_to(k)

    def text(self, at: int, size: int, edges: int) -> None:
        """``size`` letters with single spaces; edges: 1 if it begins, 2 if it ends with white space, 4 if nothing but that."""
        if size:
            self.letters += size + (self.ran and (self.gap or bool(edges & 1)))
        self.gap = bool(edges & 2) or (self.gap and not size)
        self.ran = self.ran or size > 0
        self.content += not edges & 4
        self.kept.append([at, False, 0, -1])


def walk(codes, sizes, edges, marks) -> list[list]:
    """What is kept of a page, balanced: see ``nested``."""
    w, gone, depth = _Walk(), "", 0
    for at, code in enumerate(codes):
        kind, name = code[0], code[1:]
        if gone:
            if name == gone and kind in "+-":
                depth += 1 if kind == "+" else -1
                gone = gone if depth else ""
                continue
            if not (kind == "-" and w.names[name] or gone == "head" and code == "+body"):
                continue
            gone = ""  # it was never closed, so it ends with what holds it
        if kind == ".":
            w.text(at, sizes[at], edges[at])
        elif kind == "-":
            w.end(name)
        elif name in S.REMOVED_TAGS:
            if kind == "+" and name not in S.REMOVED_ALONE:
                gone, depth = name, 1
        elif name in S.VOID_TAGS and name in S.ALLOWED_TAGS:
            if name == "hr" and (k := w.nearest(("p",), _CELLS)) >= 0:
                w.pop_to(k)
            w.content += name not in ("br", "img")
            w.kept.append([at, False, 0, _IMAGE if name == "img" else -1])
            w.ran = False
        elif name in S.ALLOWED_TAGS:
            w.start(at, name, bool(marks[at]))
    w.pop_to(0)
    return w.kept


_KEPT = StructType([StructField(name, ArrayType(kind)) for name, kind in (("at", IntegerType()), ("close", BooleanType()), ("size", IntegerType()), ("setter", IntegerType()))])


@F.pandas_udf(_KEPT)
def nested(codes: pd.Series, sizes: pd.Series, edges: pd.Series, marks: pd.Series) -> pd.DataFrame:
    """The kept tags and texts of a page in order, so that every element is closed inside the one that holds it.

    codes: ``.`` a text, ``+name`` a start, ``-name`` an end, ``/name`` a start that closes itself, ``!`` nothing.
    at: the place in codes, for an end that of its start; size: the letters inside; setter: the entry of the
    innermost prose element around or at a start whose mark is set, -1 if none.  Elements that aren't allowed go,
    some with all they hold, and so do paragraphs and divisions with nothing in them.
    """
    found = [walk(*row) for row in zip(codes, sizes, edges, marks, strict=True)]
    return pd.DataFrame({name: [[x[k] for x in kept] for kept in found] for k, name in enumerate(_KEPT.names)})
