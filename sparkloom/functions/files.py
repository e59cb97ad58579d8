"""Text and structure of single files, by format. Each takes bytes and gives title, description, content and tags."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

from .code import LANGUAGES
from .markup import read_page

MOST_ROWS = 10_000
MOST_MEMBERS = 1_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def title_of(path: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in re.sub(r"[-_]+", " ", PurePosixPath(path).stem).split()) or "Untitled"


def _result(title: str, description: str, content: str, tags: list[str], kind: str) -> dict:
    return {"title": title, "description": description, "content": content, "tags": tags, "source_type": kind}


def read_html(data: bytes, path: str) -> dict:
    page = read_page(data.decode("utf-8", "replace"), path if path.startswith("http") else "")
    return _result(page["title"], page["description"] or page["text"][:200], page["markdown"], [h["text"] for h in page["headings"]][:10], "html")


def read_markdown(data: bytes, path: str) -> dict:
    text = data.decode("utf-8", "replace")
    body = re.sub(r"(?s)```.*?(```|$)", "", text)
    heads = [h.strip() for h in re.findall(r"(?m)^#{1,6}[ \t]+(.+?)[ \t#]*$", body)]
    first = re.search(r"(?m)^#[ \t]+(.+?)[ \t#]*$", body)
    paragraphs = (" ".join(p.split()) for p in re.split(r"\n\s*\n", body) if not p.lstrip().startswith("#"))
    return _result(first.group(1).strip() if first else title_of(path), next((p for p in paragraphs if len(p.encode()) > 20), ""), text, heads, "markdown")


def read_text(data: bytes, path: str) -> dict:
    """Plain text, or source code by its extension: tags are the language and the names it defines."""
    text, ext = data.decode("utf-8", "replace"), PurePosixPath(path).suffix.lstrip(".").lower()
    language = next((k for k, names in LANGUAGES.items() if ext in names and k not in ("markdown", "html", "json")), None)
    if language:
        names = re.findall(r"(?m)^\s*(?:export\s+|pub\s+|async\s+)*(?:def|class|fn|struct|enum|impl|function)\s+([A-Za-z_]\w*)", text)
        return _result(title_of(path), "", text, [language, *names][:20], "source_code")
    lines = [x.strip() for x in text.splitlines()]
    tags = [x for x in lines if x and len(x.encode()) < 80 and sum(c.isupper() for c in x) > 1][:10]
    return _result(title_of(path), text[:200], text, tags, "plain_text")


def read_json(data: bytes, path: str) -> dict:
    try:
        value = json.loads(data)
    except ValueError:
        return read_text(data, path)
    tags = list(value)[:10] if isinstance(value, dict) else []
    return _result(title_of(path), "", json.dumps(value, ensure_ascii=False, indent=1), [str(t) for t in tags], "json")


def read_csv(data: bytes, path: str) -> dict:
    """A line of names and values for each row; values that are empty are left out, rows of another width kept as they are."""
    rows = csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline=""))
    heads = next(rows, [])
    lines = [f"Headers: {' | '.join(heads)}"] if heads else []
    for n, row in enumerate(rows):
        if n == MOST_ROWS:
            break
        lines.append(", ".join(f"{h}: {v}" for h, v in zip(heads, row, strict=True) if v) if len(row) == len(heads) else " | ".join(row))
    return _result(title_of(path), f"{max(0, len(lines) - 1)} rows", "\n".join(lines), [h for h in heads if h], "csv")


def read_docx(data: bytes, path: str) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.iter(f"{_W}p")]
    filled = [x.strip() for x in lines if x.strip()]
    tags = [x for x in filled[:10] if len(x.encode()) < 100 and any(c.isupper() for c in x) and "." not in x]
    return _result(title_of(path), (filled or [""])[0][:200], "\n".join(filled), tags, "docx")


def _cell(value: str, kind: str, strings: list[str]) -> str:
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "Yes" if value == "1" else "No"
    if kind in ("str", "inlineStr", "e"):
        return value
    number = float(value)
    return f"{number:.0f}" if number == int(number) else f"{number:.2f}"


def read_xlsx(data: bytes, path: str) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        places = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        blocks, sheets = [], []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            at = places[sheet.get(f"{_R}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(at if at.startswith("xl/") else f"xl/{at}")).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    value, kind = c.find(f"{_S}v"), c.get("t", "n")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else value.text if value is not None else None
                    if text not in (None, ""):
                        cells.append(_cell(text, kind, strings))
                if cells:
                    rows.append(" | ".join(cells))
            sheets.append(sheet.get("name", ""))
            blocks.append("\n".join([f"Sheet: {sheets[-1]}", *rows]))
    return _result(title_of(path), f"{len(sheets)} sheets", "\n\n".join(blocks), sheets, "excel")


def read_pdf(data: bytes, path: str) -> dict:
    """Needs an optional package; lines are trimmed and blank ones dropped."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise NotImplementedError("reading PDF files needs the package pypdf") from e
    text = "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    stem = re.sub(r"(?<=[^\sA-Z])(?=[A-Z])", " ", re.sub(r"[-_]+", " ", PurePosixPath(path).stem)).strip()
    return _result(stem or "Untitled", " ".join(lines[:5])[:300], "\n".join(lines), [], "pdf")


READERS = {
    "html": read_html, "htm": read_html, "md": read_markdown, "markdown": read_markdown, "csv": read_csv, "json": read_json, "docx": read_docx, "xlsx": read_xlsx, "pdf": read_pdf,
}


def members(data: bytes, most: int = MOST_MEMBERS) -> Iterator[tuple[str, bytes]]:
    """Files in a ZIP archive, by name; folders, hidden files and paths that lead outside are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in [i for i in z.infolist() if not i.is_dir()][:most]:
            parts = PurePosixPath(info.filename).parts
            if ".." not in parts and not info.filename.startswith("/") and not any(p.startswith((".", "__MACOSX")) for p in parts):
                yield info.filename, z.read(info)


def read_file(path: str, data: bytes) -> list[dict]:
    """Entries of a file by its extension; of an archive those of its members. What can't be read has an error."""
    ext = PurePosixPath(path).suffix.lstrip(".").lower()
    try:
        if ext == "zip":
            return [dict(e, path=f"{path}!{e['path']}") for name, body in members(data) for e in read_file(name, body)]
        return [READERS.get(ext, read_text)(data, path) | {"path": path, "error": None}]
    except (ValueError, KeyError, NotImplementedError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return [_result(title_of(path), "", "", [], ext or "unknown") | {"path": path, "error": f"{type(e).__name__}: {e}"}]
