"""Queries on HTML pages: simple selectors, a small XPath subset, text and attributes.

A page is parsed once into parallel lists (an arena in document order); a node is an index, and its descendants
are a contiguous range, so selecting scans a slice instead of walking objects. Selectors are compiled once per
rule set into tests on a node. :func:`extract` evaluates all rules of a job in one Arrow pass over the pages.

Meaning: blanks combine descendants, the only combinator; ``tag``, ``#id``, ``.class`` and ``[attribute op value]``
with ``= *= ^= $= ~= |=``; the scope itself never matches; a node below two matches of an outer part is found
twice. ``br img input meta link`` take no content; an end tag closes up to the nearest open element of its name
and is ignored without one. A node's text is its own text, then that of its children in order, with white space
collapsed. Unclosed tails are read as far as the parser goes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content.
_EMPTY = frozenset(("br", "img", "input", "meta", "link"))


class Page(HTMLParser):
    """Arena of a page; node 0 is the document."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.attributes, self.parents, self.ends = ["document"], [{}], [-1], [0]
        self.own: list[list[str]] = [[]]
        self._open = [0]
        self.feed(source)
        for node in self._open:
            self.ends[node] = len(self.tags)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = len(self.tags)
        self.tags.append(tag)
        self.attributes.append({k: v or "" for k, v in attrs})
        self.parents.append(self._open[-1])
        self.own.append([])
        self.ends.append(node + 1)
        if tag not in _EMPTY:
            self._open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[k]] == tag:
                for node in self._open[k:]:
                    self.ends[node] = len(self.tags)
                del self._open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.own[self._open[-1]].append(data)

    def text(self, node: int) -> str:
        """Document order of nodes is depth first, so the text of a subtree is that of its range."""
        return " ".join(" ".join(p for n in range(node, self.ends[node]) for p in self.own[n]).split())

    def outer(self, node: int) -> str:
        """Markup of a node, its own text before its children."""
        attrs = "".join(f' {k}="{v}"' for k, v in self.attributes[node].items())
        inner = "".join(self.outer(n) for n in range(node + 1, self.ends[node]) if self.parents[n] == node)
        return f"<{self.tags[node]}{attrs}>{''.join(self.own[node])}{inner}</{self.tags[node]}>"

    def select(self, selector: str, scope: int = 0) -> list[int]:
        """Nodes below ``scope`` that match, in order, repeated as often as they match."""
        found = [scope]
        for test in compile_selector(selector):
            found = [n for s in found for n in range(s + 1, self.ends[s]) if test(self.tags[n], self.attributes[n])]
        return found


Test = Callable[[str, dict], bool]
_SIMPLE = re.compile(r"""\[\s*([^\]=~|^$*\s]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]]*)))?\s*\]|([#.])([^#.\[]+)|([^#.\[]+)""")
_PARTS = re.compile(r"""(?:\[(?:"[^"]*"|'[^']*'|[^\]])*\]|[^\s\[])+""")
_COMPARE: dict[str, Callable[[str, str], bool]] = {
    "=": lambda v, x: v == x,
    "*=": lambda v, x: x in v,
    "^=": lambda v, x: v.startswith(x),
    "$=": lambda v, x: v.endswith(x),
    "~=": lambda v, x: x in v.split(),
    "|=": lambda v, x: v == x or v.startswith(x + "-"),
}


@lru_cache(maxsize=512)
def compile_selector(selector: str) -> tuple[Test, ...]:
    """One test per part of a selector, outermost first."""
    return tuple(_compile_part(p) for p in _PARTS.findall(selector.strip()))


def _compile_part(part: str) -> Test:
    tag, ident, classes, attrs = None, None, set(), []
    for m in _SIMPLE.finditer(part):
        name, op, a, b, c, mark, word, plain = m.groups()
        if name:
            attrs.append((name, op, next((x for x in (a, b, c) if x is not None), "").strip()))
        elif mark == "#":
            ident = word
        elif mark == ".":
            classes.add(word)
        elif plain and tag is None:
            tag = plain.lower()

    def test(t: str, have: dict) -> bool:
        if tag is not None and t != tag or ident is not None and have.get("id") != ident:
            return False
        if classes and not classes <= set(have.get("class", "").split()):
            return False
        return all(n in have and (op is None or _COMPARE[op](have[n], x)) for n, op, x in attrs)

    return test


_XPATH = re.compile(r"""^//(\*|[\w-]+)(?:\[@id\s*=\s*['"]?([^'"\]]+)['"]?\]|\[contains\(\s*@class\s*,\s*['"]?([^'")]+)['"]?\s*\)\])?(?:/@([\w-]+))?$""")


def xpath(page: Page, expression: str, scope: int = 0) -> list[str | int]:
    """Values or nodes of ``//tag``, ``//*[@id=…]``, ``//tag[contains(@class,…)]``, each with ``/@attribute`` or
    within ``string(…)``; other expressions find nothing. A missing attribute is an empty text."""
    text = expression.strip()
    as_string = text.startswith("string(") and text.endswith(")")
    m = _XPATH.match(text[7:-1].strip() if as_string else text)
    if not m:
        return []
    tag, ident, klass, attribute = m.groups()
    nodes = [
        n for n in range(scope + 1, page.ends[scope])
        if (tag == "*" or page.tags[n] == tag.lower()) and (not ident or page.attributes[n].get("id") == ident) and (not klass or klass.strip() in page.attributes[n].get("class", "").split())
    ]
    if attribute:
        return [page.attributes[n].get(attribute, "") for n in nodes]
    return [page.text(nodes[0])] if as_string and nodes else [] if as_string else nodes


def values(page: Page, rule: dict, scope: int = 0) -> list[str]:
    """All values of a rule ``{"selector" | "xpath", "attribute"}`` below a node; missing ones are left out."""
    if rule.get("xpath"):
        found = xpath(page, rule["xpath"], scope)
        return [x if isinstance(x, str) else page.text(x) for x in found]
    nodes = page.select(rule.get("selector") or "", scope)
    if rule.get("attribute"):
        return [v for n in nodes if (v := page.attributes[n].get(rule["attribute"])) is not None]
    return [page.text(n) for n in nodes]


def scopes(page: Page, rule: dict, scope: int = 0) -> list[int]:
    """Nodes that a rule finds."""
    if rule.get("xpath"):
        return [n for n in xpath(page, rule["xpath"], scope) if isinstance(n, int)]
    return page.select(rule.get("selector") or "", scope)


def children(page: Page, rule: dict, scope: int = 0) -> list[dict]:
    """Of each node that a rule finds, the values of the rules in its ``children``, to any depth."""
    return [{n: children(page, r, s) if r.get("children") else values(page, r, s) for n, r in rule["children"].items()} for s in scopes(page, rule, scope)]


def extract(pages: DataFrame, key: str, html: str, rules: dict[str, dict], item_selector: str | None = None) -> DataFrame:
    """``key, item_pos, <rule> array<string>…``: one row per item (or page), every page parsed once. A rule with
    ``children`` gives JSON text of a list of objects instead."""
    kind = pages.schema[key].dataType.simpleString()
    ddl = ", ".join([f"`{key}` {kind}", "item_pos int", *(f"`{n}` {'string' if r.get('children') else 'array<string>'}" for n, r in rules.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pos, out = [], [], {n: [] for n in rules}
            for k, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if source is None:
                    continue
                page = Page(source)
                for i, scope in enumerate(page.select(item_selector) if item_selector else [0]):
                    keys.append(k)
                    pos.append(i)
                    for n, rule in rules.items():
                        out[n].append(json.dumps(children(page, rule, scope), ensure_ascii=False) if rule.get("children") else values(page, rule, scope))
            lists = {n: pa.string() if rule.get("children") else pa.list_(pa.string()) for n, rule in rules.items()}
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(pos, pa.int32()), *[pa.array(v, lists[n]) for n, v in out.items()]], [key, "item_pos", *out])

    return pages.select(key, F.col(html)).mapInArrow(run, ddl)
