"""Columns over text: titles, sizes, code and prose tests, language votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that only hold a place.
PLACEHOLDERS = (
    "loading", "loading...", "please wait", "...", "copy", "copied", "copied!", "click to copy", "copy to clipboard", "[object object]", "undefined", "null", "error", "n/a",
)
#: Characters and beginnings of words that code has.
CODE_CHARACTERS = "{}[]();=<>:/\\|&*%#@$"
CODE_WORDS = (
    "function ", "def ", "fn ", "func ", "sub ", "method ", "class ", "struct ", "enum ", "interface ", "trait ", "type ", "import ", "from ", "require(", "include ", "use ", "using ",
    "module.exports", "export ", "package ", "const ", "let ", "var ", "val ", "mut ", "pub ", "public ", "private ", "protected ", "static ", "async ", "await ", "return ", "yield ", "throw ",
    "if ", "else ", "for ", "while ", "switch ", "case ", "try ", "catch ", "finally ", "=> ", "-> ", ":: ", "..", "$ ", "# ", "sudo ", "npm ", "yarn ", "cargo ", "pip ", "apt ",
)
#: Words of English prose.
PROSE_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its", "you", "your", "we", "our", "they", "their", "i", "my",
    "he", "she", "him", "her", "his", "hers", "can", "will", "would", "could", "should", "may", "might", "must", "to", "of", "in", "for", "on", "with", "at", "by", "from", "into",
    "through", "during", "before", "after", "above", "below", "and", "or", "but", "not", "so", "if", "then", "else", "when", "while", "have", "has", "had", "do", "does", "did", "make", "made",
    "here", "there", "where", "how", "what", "which", "who", "why", "more", "most", "some", "any", "all", "each", "every", "both", "also", "just", "only", "even", "still", "now",
)
#: Phrases of navigation and footers.
NAVIGATION = (
    "log in", "sign in", "sign up", "sign out", "log out", "search", "menu", "navigation", "skip to content", "cookie", "privacy policy", "terms of service", "all rights reserved",
)


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_placeholder(text: Column) -> Column:
    low = trimmed(F.lower(text))
    return (low == "") | low.isin(*PLACEHOLDERS)


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def has_code_structure(text: Column) -> Column:
    """More than one code character in fifty bytes, or a word that code has."""
    count = F.length(text) - F.length(F.translate(text, CODE_CHARACTERS, ""))
    return ((text != "") & (count > F.floor(F.octet_length(text) / 50))) | _any_of(text, CODE_WORDS)


def prose_ratio(text: Column) -> Column:
    """Share of words that are common in English prose."""
    w = words(F.lower(text))
    hits = F.size(F.filter(w, lambda x: x.isin(*PROSE_WORDS)))
    return F.when(F.size(w) > 0, F.round(hits / F.size(w), 6)).otherwise(0.0)


def is_boilerplate(text: Column) -> Column:
    """Short with three navigation phrases or more, or mostly links."""
    low, n = F.lower(text), F.size(words(text))
    phrases = F.size(F.filter(F.array(*(F.when(F.contains(low, F.lit(p)), 1) for p in NAVIGATION)), lambda x: x.isNotNull()))
    links = F.regexp_count(text, F.lit(r"\]\("))
    return ((n < 100) & (phrases >= 3)) | (links / F.greatest(n, F.lit(1)) > 0.3)


#: What tells a language; two of them make a vote.
INDICATORS = {
    "de": (" der ", " die ", " und ", " ist "),
    "en": (" the ", " and ", " of ", " is "),
    "es": (" que ", " los ", " una ", " del "),
    "fr": (" les ", " des ", " une ", " est "),
}


def language_vote(text: Column, indicators: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The language with most indicators, two at least; ties go to the first name."""
    table = INDICATORS if indicators is None else indicators
    votes = [F.struct(sum((F.when(F.contains(text, F.lit(p)), 1).otherwise(0) for p in ps), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, ps) in enumerate(sorted(table.items()))]
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] >= 2, best["k"])


def size_text(size: Column) -> Column:
    shown = F.format_string("%d bytes", size)
    for unit, name in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")):
        shown = F.when(size >= unit, F.format_string(f"%.1f {name}", F.bround(size / unit, 1))).otherwise(shown)
    return shown


def named_values(rows: DataFrame) -> Column:
    """`name: value` for each column of a row in order; nulls and empty values are left out."""
    shown = (F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in rows.columns)
    return F.concat_ws(", ", *shown)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def title_of_name(name: Column) -> Column:
    """A file name as a title: no extension, words with a capital."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    parts = F.filter(F.split(F.translate(stem, "_-", "  "), " "), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def id_of_path(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 32)


#: Source types by extension; source code has a type of its own, others are plain text.
SOURCE_TYPES = {
    "html": ("html", "htm"), "pdf": ("pdf",), "docx": ("docx", "doc"), "excel": ("xlsx", "xls"), "csv": ("csv",), "json": ("json",), "markdown": ("md", "markdown"), "plain_text": ("txt",),
    "source_code": ("rs", "py", "js", "ts", "jsx", "tsx", "java", "go", "c", "cpp", "h", "cs", "rb", "php", "swift", "kt", "scala", "sh", "bash", "zsh", "yaml", "yml", "toml", "xml"),
}
ENTRY_TYPES = {"pdf": "pdf", "source_code": "code", "html": "document", "markdown": "document", "url": "document"}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def source_type(name: Column) -> Column:
    """url for addresses, else by extension."""
    out = F.lit("plain_text")
    for kind, exts in SOURCE_TYPES.items():
        out = F.when(extension(name).isin(*exts), kind).otherwise(out)
    return F.when(name.rlike("^https?://"), "url").otherwise(out)


def entry_type(kind: Column) -> Column:
    out = F.lit("other")
    for k, v in ENTRY_TYPES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def heading_lines(text: Column, most: int = 10, longest: int = 80) -> Column:
    """The first short lines with more than one capital."""
    lines = F.transform(F.split(text, "\r?\n"), trimmed)
    return F.slice(F.filter(lines, lambda x: (x != "") & (F.octet_length(x) < longest) & (F.regexp_count(x, F.lit(r"\p{Lu}")) > 1)), 1, most)


def is_uuid(value: Column) -> Column:
    return F.regexp_like(F.lower(value), F.lit("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"))
