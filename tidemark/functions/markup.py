"""Where the anchors of a page and the elements around them begin and end: a fold over its tags, without a DOM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is no reading matter, and those that count as the container of a link.
DROPPED = frozenset(("script", "style", "noscript", "svg", "nav", "footer", "header", "form", "aside"))
CONTAINERS = frozenset(("article", "li", "section", "div"))

RAW = frozenset(("script", "style"))
LISTS = frozenset(("ul", "ol"))
COMMENT = re.compile(r"<!--.*?-->", re.S)
TAG = re.compile(r"<(/?)([a-z][a-z0-9]*)\b([^>]*)>", re.I)

ANCHOR = T.StructType().add("attributes", T.StringType()).add("inner", T.StringType()).add("around", T.IntegerType()).add("until", T.IntegerType())
PARTS = T.StructType().add("bare", T.StringType()).add("anchors", T.ArrayType(ANCHOR))


def readable(html: str) -> str:
    """The page without comments and dropped elements, nested ones of a kind included; one that never ends loses its tag alone."""
    html = COMMENT.sub(" ", html)
    last_end = {m[2].lower(): m.start() for m in TAG.finditer(html) if m[1]}
    kept, at, inside, depth = [], 0, "", 0
    for m in TAG.finditer(html):
        kind = m[2].lower()
        if inside:
            if kind == inside:
                depth += -1 if m[1] else (kind not in RAW)
                if not depth:
                    inside, at = "", m.end()
        elif kind in DROPPED:
            kept += [html[at : m.start()], " "]
            at = m.end()
            if not m[1] and not m[3].endswith("/") and last_end.get(kind, -1) > m.start():
                inside, depth = kind, 1
    return "".join(kept if inside else [*kept, html[at:]])


def anchors(bare: str) -> list[dict]:
    """Each anchor's attributes and content, and from where until where the content of its closest container goes.

    Both are null without a container. A list item ends where the next one of its list begins; an element that is never closed
    ends with the one around it; an end without a beginning is passed over.
    """
    found: list[dict] = []
    stack: list[tuple[str, int, list[dict]]] = []  # open elements: kind, where their content begins, the anchors they are closest to
    anchor: tuple[dict, int] | None = None

    def close(down_to: int, end: int) -> None:
        while len(stack) > down_to:
            _, start, held = stack.pop()
            for a in held:
                a["around"], a["until"] = start, end

    for m in TAG.finditer(bare):
        kind, ends = m[2].lower(), bool(m[1])
        if kind == "a":
            if anchor:
                anchor[0]["inner"], anchor = bare[anchor[1] : m.start()], None
            if not ends:
                anchor = ({"attributes": m[3], "inner": "", "around": None, "until": None}, m.end())
                found.append(anchor[0])
                next((held for k, _, held in reversed(stack) if k in CONTAINERS), []).append(anchor[0])
        elif kind in CONTAINERS or kind in LISTS:
            if ends:
                level = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == kind), None)
                if level is not None:
                    close(level, m.start())
                continue
            if kind == "li":
                level = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in LISTS or stack[i][0] == "li"), None)
                if level is not None and stack[level][0] == "li":
                    close(level, m.start())
            stack.append((kind, m.end(), []))
    if anchor:
        anchor[0]["inner"] = bare[anchor[1] :]
    close(0, len(bare))
    return found


@F.pandas_udf(PARTS)
def page_parts(html: pd.Series) -> pd.DataFrame:
    """(bare, anchors) of each page; of a null one, nothing."""
    bare = [None if h is None else readable(h) for h in html]
    return pd.DataFrame({"bare": bare, "anchors": [[] if b is None else anchors(b) for b in bare]})
