"""Pages: main content by link density, rendering diagnosis, embedded state, grids of divs. Parsed in Arrow batches."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Elements and id or class words that hold no content, and ids of state scripts.
STRIP = frozenset("script style nav header footer aside form noscript svg button".split())
HINT = re.compile("cookie|banner|consent|nav|menu|footer|header|sidebar|related|promo|social|breadcrumb|newsletter|subscribe", re.I)
STATE_IDS = ("__NEXT_DATA__", "__NUXT__")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, skip: frozenset = frozenset()) -> list[str]:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                if x.strip():
                    out.append(x.strip())
            elif x.name not in skip:
                todo.extend(reversed(x.children))
        return out

    def text(self, skip: frozenset = frozenset()) -> str:
        return " ".join(self.strings(skip))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self._close({"p"}, {"div", "td", "article", "section", "main", "body", ""})
        elif tag == "li":
            self._close({"li"}, {"ul", "ol", ""})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _close(self, names: set[str], until: set[str]) -> None:
        node = self.at
        while node.name not in until:
            if node.name in names:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.name == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def find(root: Node, name: str) -> Node | None:
    return next((n for n in root.walk() if n.name == name), None)


def link_density(node: Node) -> float:
    """Characters in links over all characters; 1 for an empty node."""
    text = node.text()
    if not text:
        return 1.0
    return len(" ".join(n.text() for n in node.walk() if n.name == "a")) / len(text)


def _without_chrome(node: Node) -> None:
    for n in list(node.walk()):
        n.children = [
            c for c in n.children if isinstance(c, str) or not (c.name in STRIP or HINT.search(f"{c.attrs.get('id', '')} {c.attrs.get('class', '')}".strip() or "-"))
        ]


def extract_main(html: str | None) -> str:
    """An article or main of more than 200 characters, else the container with most text outside links, else all text."""
    root = parse(html)
    _without_chrome(root)
    for name in ("article", "main"):
        node = find(root, name)
        if node is not None and len("".join(node.strings())) > 200:
            return re.sub(r"\s+", " ", node.text()).strip()
    best, score = root, 0.0
    for node in root.walk():
        if node.name in ("div", "section", "article", "main"):
            found = len(node.text()) * (1 - link_density(node))
            if found > score:
                best, score = node, found
    return re.sub(r"\s+", " ", best.text()).strip()


#: Pages that a worker holds as Python objects at once.
SLICE = 100


def main_content(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every page, a slice of pages at a time."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([extract_main(x) for x in part.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, StructType([pages.schema["page_id"], StructField("text", StringType())]))


def _script(root: Node, key: str, value: str) -> Node | None:
    return next((n for n in root.walk() if n.name == "script" and n.attrs.get(key) == value), None)


def diagnose(html: str | None) -> tuple[bool, int, int, str | None]:
    """(needs_render, visible_chars, script_chars, state_script)."""
    root = parse(html)
    visible = len((find(root, "body") or root).text(frozenset({"script", "style"})))
    scripts = sum(len("".join(c for c in n.children if isinstance(c, str))) for n in root.walk() if n.name == "script")
    state = next((i for i in STATE_IDS if _script(root, "id", i)), None)
    if state is None and _script(root, "type", "application/ld+json"):
        state = "ld+json"
    return visible < 200 and (scripts > visible or state is not None), visible, scripts, state


def diagnose_render(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("needs_render boolean, visible_chars bigint, script_chars bigint, state_script string")
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([diagnose(h) for h in html], columns=["needs_render", "visible_chars", "script_chars", "state_script"])

    return pages.select("page_id", run("html").alias("d")).select("page_id", "d.*")


def harvest_state(html: str | None):
    """JSON of the first state script that parses, else of the first ld+json script, else None."""
    root = parse(html)
    for node in [*(_script(root, "id", i) for i in STATE_IDS), _script(root, "type", "application/ld+json")]:
        if node is not None:
            try:
                return json.loads("".join(c for c in node.children if isinstance(c, str)))
            except ValueError:
                continue
    return None


def div_grid(html: str | None) -> tuple[list[str], list[list[str | None]]] | None:
    """Header and rows of a table made of divs: rows are the divs of the commonest class whose first holds two divs or more."""
    root = parse(html)
    divs = [n for n in root.walk() if n.name == "div"]
    counts: dict[str, int] = {}
    for n in divs:
        for c in n.attrs.get("class", "").split():
            counts[c] = counts.get(c, 0) + 1
    inner = lambda n: [c for c in n.children if isinstance(c, Node) and c.name == "div"]
    for cls, n in sorted(counts.items(), key=lambda kv: -kv[1]):
        own = [d for d in divs if cls in d.attrs.get("class", "").split()]
        if n >= 2 and len(inner(own[0])) >= 2:
            rows = [[c.text() for c in inner(d)] for d in own if inner(d)]
            if len(rows) < 2:
                return None
            width = max(map(len, rows))
            names = (rows[0] + [f"col_{i}" for i in range(width)])[:width]
            return names, [(r + [None] * width)[:width] for r in rows[1:]]
    return None
