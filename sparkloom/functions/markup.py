"""Structure of web pages: titles, headings, links, code blocks, text, by one Arrow function over Python's HTML parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_TYPE = (
    "title string, description string, canonical string, headings array<struct<level:int,text:string,id:string>>, links array<string>, "
    "code array<struct<language:string,content:string>>, text string, markdown string, lang string, density double"
)
#: Elements whose text is no content, and elements that end a line.
HIDDEN = {"script", "style", "noscript", "template", "svg", "head"}
FRAME = {"nav", "footer", "aside", "header", "form"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "br", "hr", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "footer", "nav", "header", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Classes of page furniture: fixed values.
FURNITURE = re.compile(r"(?:^|\s|-)(?:ad|ads|advert|sidebar|menu|nav|navbar|breadcrumb|cookie|popup|banner|share|social)(?:\s|-|$)", re.I)
_LANGUAGE = re.compile(r"(?:^|\s)(?:language|lang|highlight|brush)[-:]\s*([A-Za-z0-9+#]+)")
INLINE_LEAST = 50


class _Reader(HTMLParser):
    """Collects what PAGE_TYPE names while tags open and close; unclosed tags end with their parents."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base = base
        self.open: list[tuple[str, bool]] = []  # tag, whether it hides
        self.frames = 0
        self.found: dict[str, str] = {}
        self.headings: list[dict] = []
        self.links: list[str] = []
        self.code: list[dict] = []
        self.parts: list[str] = []
        self.marks: list[str] = []
        self.taken: list[tuple[str, list[str], dict]] = []  # title, headings and code that are open

    @property
    def hidden(self) -> bool:
        return any(h for _, h in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html" and a.get("lang"):
            self.found.setdefault("lang", a["lang"].lower())
        if tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name in ("og:title", "og:description", "description") and a.get("content"):
                self.found.setdefault(name, a["content"].strip())
        if tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
            self.found.setdefault("canonical", urljoin(self.base, a["href"]))
        if tag == "a" and a.get("href"):
            try:
                to = urljoin(self.base, a["href"].strip())
            except ValueError:
                to = ""
            if to.lower().startswith(("http://", "https://")):
                self.links.append(to)
        if tag in BLOCKS:
            self._break("\n" if tag in ("br", "li", "tr") else "\n\n")
        if tag == "li":
            self.marks.append("- ")
        if re.fullmatch("h[1-6]", tag):
            self.marks.append("#" * int(tag[1]) + " ")
            self.taken.append((tag, [], {"level": int(tag[1]), "id": a.get("id")}))
        elif tag == "title" or tag in ("pre", "code"):
            inside = any(t == "pre" for t, _, _ in self.taken)
            if not (tag == "code" and inside):
                self.taken.append((tag, [], {"language": _language(a)}))
            elif _language(a):
                next(m for t, _, m in reversed(self.taken) if t == "pre").update(language=_language(a))
            if tag == "pre":
                self.marks.append("```\n")
        if tag not in VOID:
            hides = tag in HIDDEN or tag in FRAME or bool(FURNITURE.search(a.get("class", "")))
            self.open.append((tag, hides))

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, _ = self.open.pop()
            self._closed(t)
            if t == tag:
                break
        if tag in BLOCKS:
            self._break("\n\n")

    def _closed(self, tag: str) -> None:
        if self.taken and self.taken[-1][0] == tag:
            _, parts, more = self.taken.pop()
            text = "".join(parts)
            if tag == "title":
                self.found.setdefault("title", " ".join(text.split()))
            elif tag in ("pre", "code"):
                self.code.append({"language": more["language"], "content": text.strip("\n"), "inline": tag == "code"})
                if tag == "pre":
                    self.marks.append("\n```")
            else:
                self.headings.append({"level": more["level"], "text": " ".join(text.split()), "id": more["id"]})

    def _break(self, mark: str) -> None:
        if not self.hidden:
            self.parts.append("\n")
            self.marks.append(mark)

    def handle_data(self, data: str) -> None:
        for _, parts, _ in self.taken:
            parts.append(data)
        if not self.hidden:
            self.parts.append(data)
            self.marks.append(data if any(t == "pre" for t, _, _ in self.taken) else re.sub(r"\s+", " ", data))

    def result(self, size: int) -> dict:
        while self.open:
            self._closed(self.open.pop()[0])
        text = re.sub(r"[ \t\r\f\v]*\n\s*", "\n", re.sub(r"[ \t]+", " ", "".join(self.parts))).strip()
        seen: set[str] = set()
        code = []
        for block in self.code:
            long = not block["inline"] or len(block["content"].encode()) > INLINE_LEAST
            if long and block["content"].strip() and block["content"] not in seen:
                seen.add(block["content"])
                code.append({"language": block["language"], "content": block["content"]})
        first = next((h["text"] for h in self.headings if h["level"] == 1 and h["text"]), None)
        markdown = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(self.marks))).strip()
        return {
            "title": self.found.get("og:title") or self.found.get("title") or first or "Untitled",
            "description": self.found.get("og:description") or self.found.get("description"),
            "canonical": self.found.get("canonical"),
            "headings": self.headings,
            "links": self.links,
            "code": code,
            "text": text,
            "markdown": markdown,
            "lang": self.found.get("lang"),
            "density": len(text.encode()) / size if size else 0.0,
        }


def _language(attributes: dict[str, str]) -> str | None:
    found = _LANGUAGE.search(attributes.get("class", ""))
    return (found.group(1) if found else attributes.get("data-lang") or attributes.get("data-language") or "").lower() or None


def read_page(html: str | None, url: str | None) -> dict:
    reader = _Reader(url or "")
    reader.feed(html or "")
    reader.close()
    return reader.result(len((html or "").encode("utf-8", "replace")))


def page_structure(html: Column, url: Column) -> Column:
    """A page's structure, as PAGE_TYPE has it. Pages are read by the session's Arrow batches, which callers keep small."""

    @F.pandas_udf(PAGE_TYPE)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for html_, url_ in batches:
            yield pd.DataFrame([read_page(h, u) for h, u in zip(html_, url_, strict=True)], columns=[p.split(" ")[0] for p in _TOP])

    return read(html, url)


_TOP = ["title", "description", "canonical", "headings", "links", "code", "text", "markdown", "lang", "density"]


def simple_title(html: Column) -> Column:
    """What stands between the first title tags."""
    return F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def headings(html: Column) -> Column:
    """Texts of headings in flat markup, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def clean_markdown(text: Column) -> Column:
    """No more than one blank line in a row, no spaces at line ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


#: What the markup of site frameworks holds (any of), and where their content is.
FRAMEWORKS = {
    "div#__next": ("__NEXT_DATA__", "_next"),
    "div#__nuxt": ("_nuxt", "__nuxt"),
    "[ng-version]": ("ng-version", "ng-app"),
    "[data-reactroot]": ("data-reactroot", "react-root"),
    "[data-v-app]": ("v-app", "data-v-"),
    "[data-sveltekit-hydrate]": ("svelte", "__sveltekit"),
    "div#__docusaurus": ("docusaurus",),
    "div#app": ("vitepress",),
    "div#___gatsby": ("gatsby", "___gatsby"),
}


def framework_selectors(html: Column) -> Column:
    tests = []
    for selector, marks in FRAMEWORKS.items():
        has = F.lit(False)
        for mark in marks:
            has = has | F.contains(html, F.lit(mark))
        tests.append(F.when(has, selector))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())
