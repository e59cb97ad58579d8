"""Chunks of entries: sliding windows and summaries as columns, packed chunks by Python table functions.

Sizes are in bytes where packing compares them, and in characters where windows cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import small_batches

SIZE, OVERLAP, LEAST = 512, 50, 50
CHUNK = "entry_id long, chunk_index int, chunk_type string, text string"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of `size` characters, each `overlap` before the last one's end; blank ones are left out."""
    step = size - overlap if overlap < size else size
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))))
    cut = F.transform(starts, lambda i: trimmed(F.substring(text, i * step + 1, F.lit(size))))
    return F.filter(F.coalesce(cut, F.array().cast("array<string>")), lambda x: x != "")


def summary(title: Column, description: Column, tags: Column, size: int = SIZE) -> Column:
    """Title, description and tags in one text; cut to twice the size in characters where it is longer in bytes."""
    shown = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    whole = F.concat_ws(". ", title, F.when(description != "", description), shown)
    return F.when(F.octet_length(whole) > 2 * size, F.substring(whole, 1, 2 * size)).otherwise(whole)


def basic_chunks(entries: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Summary first, then windows of the content; chunks below `least` bytes are left out. Ids are entry#index."""
    parts = F.concat(
        F.array(F.struct(F.lit("summary").alias("chunk_type"), summary(F.col("title"), F.lit(""), F.col("tags"), size).alias("text"))),
        F.transform(windows(F.col("content"), size, overlap), lambda x: F.struct(F.lit("content").alias("chunk_type"), x.alias("text"))),
    )
    kept = F.filter(parts, lambda x: F.octet_length(x["text"]) >= least)
    rows = entries.select("entry_id", F.posexplode(kept).alias("chunk_index", "c"))
    return rows.select(F.concat_ws("#", "entry_id", "chunk_index").alias("chunk_id"), "entry_id", "chunk_index", "c.chunk_type", "c.text")


def fence_parts(text: Column) -> Column:
    """Parts between code fences, in turn text and code."""
    return F.transform(F.split(text, "```"), lambda x, i: F.struct(i.alias("part"), (i % 2 == 1).alias("code"), x.alias("text")))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sections at Markdown headers: key, section, header, level, bytes of text before it, body.

    Lines are numbered within their document only; a fold over a document's lines opens a section at each header.
    """
    lines = F.split(F.col(text), "\n")
    level = lambda x: F.length(F.regexp_extract(x, r"^\s*(#{1,6})(?!#)", 1))
    empty = F.array().cast("array<struct<header:string,level:int,start:bigint,body:string>>")
    start = F.struct(empty.alias("done"), F.lit(None).cast("string").alias("header"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("start"), F.lit("").alias("body"), F.lit(0).cast("bigint").alias("at"))

    def closed(a: Column) -> Column:
        row = F.struct(a["header"].alias("header"), a["level"].alias("level"), a["start"].alias("start"), trimmed(a["body"]).alias("body"))
        return F.when(a["header"].isNotNull() | (trimmed(a["body"]) != ""), F.concat(a["done"], F.array(row))).otherwise(a["done"])

    def step(a: Column, line: Column) -> Column:
        n = level(line)
        name = F.regexp_replace(line, r"^\s*#{1,6}\s*", "")
        after = a["at"] + F.octet_length(line) + 1
        opened = F.struct(closed(a).alias("done"), F.concat(F.repeat(F.lit("#"), n), F.lit(" "), name).alias("header"), n.alias("level"), a["at"].alias("start"), F.lit("").alias("body"), after.alias("at"))
        joined = F.when(a["body"] != "", F.concat(a["body"], F.lit("\n"), line)).otherwise(line)
        grown = F.struct(a["done"].alias("done"), a["header"].alias("header"), a["level"].alias("level"), a["start"].alias("start"), joined.alias("body"), after.alias("at"))
        return F.when(n > 0, opened).otherwise(grown)

    found = F.aggregate(lines, start, step, closed)
    return docs.select(key, F.posexplode(found).alias("section", "s")).select(key, "section", "s.*")


# Packing is a fold over one document's pieces, so it runs a document at a time in Python.


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def slide(text: str, size: int, overlap: int) -> list[str]:
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end == len(text):
            break
        start = end - overlap if overlap < size else end
    return out


def _fill(pieces: Iterator[str], size: int, glue: str, split) -> list[str]:
    """Pieces joined by glue while they fit; a piece that never fits is split."""
    out, held = [], ""
    for piece in pieces:
        piece = piece.strip()
        if not piece:
            continue
        n = _bytes(piece)
        if held and _bytes(held) + n + len(glue) > size:
            out.append(held)
            held = ""
        if n > size:
            if held:
                out.append(held)
                held = ""
            out += split(piece)
        else:
            held = f"{held}{glue}{piece}" if held else piece
    return [*out, held] if held else out


def by_sentences(text: str, size: int, overlap: int) -> list[str]:
    pieces = iter(re.findall(r"[^.!?]*[.!?]|[^.!?]+$", text))
    return _fill(pieces, size, " ", lambda s: slide(s, size, overlap))


def by_paragraphs(text: str, size: int, overlap: int) -> list[str]:
    return _fill(iter(text.split("\n\n")), size, "\n\n", lambda p: by_sentences(p, size, overlap))


def smart_split(text: str, size: int) -> list[str]:
    """Cut at the last fence, blank line or sentence end past 30 % of the size; never inside a character."""
    raw, out, start = text.encode("utf-8", "surrogatepass"), [], 0
    least = int(size * 0.3)
    while start < len(raw):
        end = min(start + size, len(raw))
        while start < end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end == start:  # one character is longer than the size
            end = start + 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
        if end < len(raw):
            part = raw[start:end]
            for mark, more in ((b"```", 0), (b"\n\n", 0), (b". ", 1), (b".\n", 1)):
                at = part.rfind(mark)
                if at > least:
                    end = start + at + more
                    break
        piece = raw[start:end].decode("utf-8", "surrogatepass").strip()
        if piece:
            out.append(piece)
        rest = raw[end:].decode("utf-8", "surrogatepass") if end < len(raw) and raw[end : end + 1].isspace() else ""
        start = end + (_bytes(rest) - _bytes(rest.lstrip()) if rest else 0)
    return out


def merge_small(chunks: list[str], least: int = 200) -> list[str]:
    """A chunk below `least` bytes takes in the ones that follow until it is long enough."""
    out, i = [], 0
    while i < len(chunks):
        held = chunks[i]
        while _bytes(held) < least and i + 1 < len(chunks):
            i += 1
            held = f"{held}\n\n{chunks[i]}"
        out.append(held)
        i += 1
    return out


def kind_of(text: str) -> str:
    if text.startswith("```") or "\n```" in text:
        return "code"
    return "header" if text.startswith("#") and len(text.splitlines()) <= 3 else "content"


def markdown_sections(text: str) -> list[tuple[str | None, int, str]]:
    out, header, level, body = [], None, 0, []
    for line in text.split("\n"):
        found = re.match(r"\s*(#{1,6})(?!#)\s*(.*)", line, re.S)
        if found:
            if header is not None or "".join(body).strip():
                out.append((header, level, "\n".join(body).strip()))
            level = len(found.group(1))
            header, body = f"{found.group(1)} {found.group(2)}", []
        else:
            body.append(line)
    if header is not None or "".join(body).strip():
        out.append((header, level, "\n".join(body).strip()))
    return out


def markdown_chunks(text: str, size: int, overlap: int, least: int) -> list[tuple[str, str]]:
    """Sections under the path of their headers; long ones in parts, each with the path again."""
    out, path = [], []
    for header, level, body in markdown_sections(text):
        if header is not None:
            path = [*path[: level - 1], header]
        context = " > ".join(path) + "\n\n" if path else ""
        whole = context + body
        if _bytes(whole.strip()) < least:
            continue
        if _bytes(whole) <= size:
            out.append(("header" if header is not None else "content", whole))
            continue
        for i, part in enumerate(by_paragraphs(body, size, overlap)):
            if _bytes(part) >= least:
                out.append(("content", f"{context}{'(continued)' + chr(10) * 2 if i and context else ''}{part}"))
    return out


def packed_chunks(entries: DataFrame, how: str, size: int = 2000, overlap: int = 100, least: int = LEAST, merge: int = 200) -> DataFrame:
    """Chunks of each entry by `smart`, `paragraphs` or `markdown` packing, numbered from 0."""

    def chunks(text: str) -> list[tuple[str, str]]:
        if how == "markdown":
            return markdown_chunks(text, size, overlap, least)
        parts = merge_small(smart_split(text, size), merge) if how == "smart" else by_paragraphs(text, size, overlap)
        return [(kind_of(p), p) for p in parts if _bytes(p) >= least]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(e, i, k, t) for e, text in zip(batch["entry_id"], batch["content"], strict=True) for i, (k, t) in enumerate(chunks(text or ""))]
            yield pd.DataFrame(rows, columns=["entry_id", "chunk_index", "chunk_type", "text"])

    small_batches(entries.sparkSession)
    return entries.select("entry_id", "content").mapInPandas(run, CHUNK)


def code_chunks(source: str, language: str, most: int = 4000) -> list[tuple[str, str, str]]:
    """(kind, names, text) of a source file: top-level definitions packed to `most` bytes; the whole file without any."""
    found = python_symbols(source) if language == "python" else line_symbols(source)
    if not found:
        return [("file", "", source)] if source.strip() else []
    out: list[tuple[str, str, str]] = []
    held: list[tuple[str, str, str]] = []

    def flush() -> None:
        if held:
            out.append((held[0][0] if len(held) == 1 else "group", ", ".join(n for _, n, _ in held), "\n\n".join(t for _, _, t in held)))
            held.clear()

    for kind, name, text in found:
        if _bytes(text) > most:
            flush()
            out.append((kind, name, text))
            continue
        if held and sum(_bytes(t) + 2 for _, _, t in held) + _bytes(text) > most:
            flush()
        held.append((kind, name, text))
    flush()
    return out


def python_symbols(source: str) -> list[tuple[str, str, str]]:
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return line_symbols(source)
    lines, out = source.splitlines(), []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, "\n".join(lines[start - 1 : node.end_lineno])))
    return out


_SYMBOL = re.compile(r"^(?:export\s+|pub(?:\([^)]*\))?\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|default\s+|abstract\s+)*(fn|func|function|def|class|struct|enum|trait|interface|impl|mod|module|type|const)\s+([A-Za-z_]\w*)")
_KINDS = {"fn": "function", "func": "function", "def": "function", "mod": "module", "const": "constant"}


def line_symbols(source: str) -> list[tuple[str, str, str]]:
    """Definitions that begin a line, each up to the next; for languages without a parser here."""
    lines = source.splitlines()
    starts = [(i, m) for i, x in enumerate(lines) if (m := _SYMBOL.match(x))]
    return [(_KINDS.get(m[1], m[1]), m[2], "\n".join(lines[i : starts[n + 1][0] if n + 1 < len(starts) else len(lines)]).rstrip()) for n, (i, m) in enumerate(starts)]
