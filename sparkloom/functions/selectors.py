"""A small matcher of CSS selectors over parsed markup, and code blocks found with it.

Known parts: tag, .class, #id, [a], [a='v'], [a*='v'], :not(...) and :has(...), below each other, lists with commas.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .code import ALIASES, PATTERNS
from .markup import VOID

CODE_TYPE = "array<struct<pattern:string,language:string,content:string>>"


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def below(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.below()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_PART = re.compile(r"""(?P<tag>^[A-Za-z][\w-]*|^\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)['"]?(?P<value>[^'"\]]*)['"]?)?\]""", re.X)


def _outside(text: str, cut: str) -> list[str]:
    """Split where no bracket or parenthesis is open."""
    out, depth, held = [], 0, ""
    for c in text:
        depth += (c in "([") - (c in ")]")
        if c == cut and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [x.strip() for x in [*out, held] if x.strip()]


@lru_cache(1024)
def _compound(text: str) -> tuple[tuple, ...]:
    """Tests of one compound selector."""
    tests = []
    while text:
        found = re.match(r":(not|has)\(", text)
        if found:
            depth, end = 1, found.end()
            while depth:
                depth += (text[end] == "(") - (text[end] == ")")
                end += 1
            tests.append((found.group(1), text[found.end() : end - 1]))
            text = text[end:]
            continue
        found = _PART.match(text)
        if not found:
            raise ValueError(f"unknown selector {text!r}")
        g = found.groupdict()
        kind = next(k for k in ("tag", "cls", "id", "attr") if g[k] is not None)
        tests.append((kind, g[kind], g["op"], g["value"]))
        text = text[found.end() :]
    return tuple(tests)


def _passes(node: Node, tests: tuple[tuple, ...]) -> bool:
    for kind, what, *more in tests:
        if kind == "tag":
            ok = what in ("*", node.tag)
        elif kind == "cls":
            ok = what in node.attributes.get("class", "").split()
        elif kind == "id":
            ok = node.attributes.get("id") == what
        elif kind == "attr":
            value = node.attributes.get(what)
            ok = value is not None and (more[0] is None or (value == more[1] if more[0] == "=" else more[1] in value))
        elif kind == "has":
            ok = any(matches(x, what) for x in node.below())
        else:
            ok = not matches(node, what)
        if not ok:
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    """Whether a node is meant by a selector; ancestors may stand anywhere above."""
    for way in _outside(selector, ","):
        *above, last = [_compound(p) for p in _outside(way, " ")]
        if not _passes(node, last):
            continue
        at = node.parent
        while above and at is not None:
            if _passes(at, above[-1]):
                above.pop()
            at = at.parent
        if not above:
            return True
    return False


def select(root: Node, selector: str) -> list[Node]:
    return [n for n in root.below() if matches(n, selector)]


def language_of(node: Node) -> str | None:
    """From classes and data attributes of the node, its parent and its grandparent."""
    at: Node | None = node
    for _ in range(3):
        if at is None:
            break
        found = re.search(r"(?:^|\s)(?:language|lang|highlight|brush)-([\w+#-]+)", at.attributes.get("class", ""))
        name = found.group(1) if found else at.attributes.get("data-language") or at.attributes.get("data-lang")
        if name:
            return ALIASES.get(name.lower(), name.lower())
        at = at.parent
    return None


def code_blocks(html: str, least: int = 1) -> list[dict]:
    """Code in a page: of equal contents the one whose pattern comes first."""
    root, seen, out = parse(html), set(), []
    for name, selector in PATTERNS.items():
        for node in select(root, selector):
            content = node.text().strip("\n")
            if len(content.strip()) >= least and content not in seen:
                seen.add(content)
                out.append({"pattern": name, "language": language_of(node), "content": content})
    return out


def page_code(html: Column) -> Column:
    @F.pandas_udf(CODE_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([code_blocks(h or "") for h in batch])

    return run(html)
