"""Columns over source code: validation in stages, canonical languages, patterns of code in pages."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as text_functions

#: What code has, what a bad extraction has, what prose has.
INDICATORS = (
    r"\w+\s*\([^)]*\)",
    r"\w+\s*=\s*.+",
    r"\b(if|for|while|switch|case|try|catch|except)\b",
    r"\b(var|let|const|def|class|function|interface|type|struct|enum)\b",
    r"\b(import|from|require|include|using|use)\b",
    r"[\{\}\[\]]",
    r"[\+\-\*/%&\|\^<>=!]",
    r"\.\w+",
    r"(=>|->)",
    r"\b(return|break|continue|yield|await|async)\b",
)
BAD = (
    r"\b(from|import|def|class|if|for|while|return)[a-z]",
    r"&[lg]t;|&amp;|&quot;|&#\d+;",
    r"<[^>]{50,}>",
    r"(<span[^>]*>){5,}",
    r"[^\s]{200,}",
)
PROSE = (
    r"\b(the|this|that|these|those|is|are|was|were|will|would|should|could|have|has|had)\b",
    r"[.!?]\s+[A-Z]",
    r"\b(however|therefore|furthermore|moreover|nevertheless|additionally|specifically)\b",
)
#: How lines of comments begin, and languages that are diagrams.
COMMENT = (r"^\s*(//|#|/\*|\*|<!--)", r'^\s*"""', r"^\s*'''", r"^\s*\*\s")
DIAGRAMS = ("mermaid", "plantuml", "graphviz", "dot", "diagram")
#: Words of which code of a language has two at least.
LANGUAGE_WORDS = {
    "typescript": (":", "{", "}", "=>", "function", "class", "interface", "type"),
    "javascript": ("function", "{", "}", "=>", "const", "let", "var"),
    "python": ("def", ":", "return", "self", "import", "class"),
    "java": ("class", "public", "private", "{", "}", ";"),
    "rust": ("fn", "let", "mut", "impl", "struct", "->"),
    "go": ("func", "type", "struct", "{", "}", ":="),
    "cpp": ("class", "public", "private", "::", "{", "}", ";"),
    "c": ("#include", "void", "int", "{", "}", ";"),
}
#: Names that a language goes by.
LANGUAGES = {
    "rust": ("rust", "rs"), "python": ("python", "py", "python3", "py3"), "javascript": ("javascript", "js", "jsx", "mjs", "cjs"), "typescript": ("typescript", "ts", "tsx"),
    "go": ("go", "golang"), "java": ("java",), "csharp": ("csharp", "cs", "c#", "dotnet"), "cpp": ("cpp", "c++", "cxx", "cc", "cplusplus"), "c": ("c",), "ruby": ("ruby", "rb"), "php": ("php",),
    "swift": ("swift",), "kotlin": ("kotlin", "kt", "kts"), "sql": ("sql", "mysql", "postgresql", "postgres", "sqlite", "plsql"),
    "shell": ("shell", "bash", "sh", "zsh", "fish", "powershell", "ps1", "console", "terminal"), "yaml": ("yaml", "yml"), "json": ("json", "jsonc", "json5"), "toml": ("toml",),
    "markdown": ("markdown", "md"), "html": ("html", "htm", "xhtml"), "css": ("css", "scss", "sass", "less", "stylus"),
}
#: Short names of languages in markup.
ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "rs": "rust", "cs": "csharp", "c++": "cpp", "cxx": "cpp", "sh": "bash", "zsh": "bash", "yml": "yaml", "md": "markdown",
    "objc": "objectivec", "objective-c": "objectivec", "asm": "assembly", "proto": "protobuf",
}
#: Where pages keep code, by what made them.
PATTERNS = {
    "docusaurus_code_block": ".prism-code, [class*='codeBlockContent']",
    "docusaurus_tab_code_block": ".tabs-container pre code",
    "mkdocs_code_block": ".highlight pre, .codehilite pre",
    "sphinx_code_block": ".highlight-python pre, .highlight-default pre, .highlight pre",
    "readthedocs_code": ".rst-content pre",
    "jekyll_highlight": ".highlighter-rouge pre, .highlight pre.highlight",
    "hugo_highlight": ".highlight pre, .chroma pre",
    "vuepress_code": "div[class*='language-'] pre",
    "gatsby_code": ".gatsby-highlight pre",
    "nextjs_rehype": "[data-rehype-pretty-code] code",
    "astro_code": ".astro-code pre",
    "prism_js": "[class*='language-'] code, pre[class*='language-']",
    "highlight_js": ".hljs, pre code.hljs",
    "syntax_highlighter": ".syntaxhighlighter",
    "rouge_syntax": ".rouge pre, .rouge-code",
    "shiki": ".shiki code, pre.shiki",
    "github_code": ".blob-code-content, .highlight pre, .js-file-line",
    "gitlab_code": ".blob-content pre, .code pre",
    "bitbucket_code": ".code-container pre",
    "stackoverflow_code": ".s-prose pre, .s-code-block, .post-text pre",
    "monaco_editor": ".monaco-editor .view-lines",
    "code_mirror": ".CodeMirror-code, .cm-content",
    "ace_editor": ".ace_editor .ace_content",
    "terminal_output": ".terminal pre, .console pre, .shell pre",
    "asciinema_player": ".asciinema-player pre",
    "data_language_attr": "[data-language] code, [data-lang] code",
    "class_prefix_code": "[class*='code-'] pre, [class*='snippet'] pre",
    "data_code_attr": "[data-code]",
    "pre_code": "pre code",
    "pre_only": "pre:not(:has(code))",
    "code_only": "code:not(pre code)",
}


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(_SHORT.get(pattern, pattern)))


#: The same tests without repeats that a test doesn't need: each matches where its original does, and nowhere else.
_SHORT = {
    r"\w+\s*\([^)]*\)": r"\w\s*\([^)]*\)", r"\w+\s*=\s*.+": r"\w\s*=\s*.", r"\.\w+": r"\.\w", r"(<span[^>]*>){5,}": r"(?:<span[^>]*>){5}", r"[^\s]{200,}": r"\S{200}",
}


def indicators(text: Column) -> Column:
    """How many kinds of signs of code a text has."""
    return reduce(add, (F.when(_has(text, p), 1).otherwise(0) for p in INDICATORS))


def prose_score(text: Column) -> Column:
    """Signs of prose for each word."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return reduce(add, (F.regexp_count(text, F.lit(p)) for p in PROSE)) / F.greatest(n, F.lit(1))


def verdict(text: Column, language: Column | None = None, least: int = 20, most: int = 50_000, signs: int = 3, prose: float = 0.15) -> Column:
    """`valid`, or the first of the stages that a text fails."""
    size = F.octet_length(F.regexp_replace(text, r"^\s+|\s+$", ""))
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    filled = F.size(F.filter(lines, lambda x: _has(x, r"\S")))
    comments = F.size(F.filter(lines, lambda x: reduce(or_, (_has(x, p) for p in COMMENT))))
    long = F.size(F.filter(lines, lambda x: F.octet_length(x) > 300))
    out = F.when(size < least, "too short").when(size > most, "too long")
    if language is not None:
        out = out.when(F.lower(language).isin(*DIAGRAMS), "diagram")
    out = out.when(reduce(or_, (_has(text, p) for p in BAD)), "bad extraction").when(indicators(text) < signs, "few indicators").when(filled == 0, "no lines")
    out = out.when(comments / filled > 0.7, "comments")
    if language is not None:
        for name, words in LANGUAGE_WORDS.items():
            n = reduce(add, (F.when(F.contains(F.lower(text), F.lit(w)), 1).otherwise(0) for w in words))
            out = out.when((F.lower(language) == name) & (n < 2), "wrong language")
    return out.when(filled < 3, "few lines").when(long > F.floor(F.size(lines) / 2), "long lines").when(prose_score(text) > prose, "prose").otherwise("valid")


def canonical_language(hint: Column) -> Column:
    """One of the known languages, `other` if none goes by that name."""
    out = F.lit("other")
    for name, names in LANGUAGES.items():
        out = F.when(F.lower(hint).isin(*names), name).otherwise(out)
    return out


def language_vote(text: Column) -> Column:
    """The language of which a text has most words, two at least; ties go to the first name; null for none."""
    return text_functions.language_vote(text, LANGUAGE_WORDS)


def alias(language: Column) -> Column:
    low = F.lower(language)
    out = low
    for short, name in ALIASES.items():
        out = F.when(low == short, name).otherwise(out)
    return out


def quick_check(text: Column) -> Column:
    """Whether a text has brackets or operators at all."""
    return _has(text, r"[{}\[\]();=<>]|->|::")


def pattern_catalog(spark: SparkSession) -> DataFrame:
    """pattern, selector: all ways that pages are known to keep code, in the order in which they are tried."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(PATTERNS.items())], "place int, pattern string, selector string")


def language_catalog(spark: SparkSession) -> DataFrame:
    """language, names, parsed: the languages that have a name here, and whether definitions are read by a parser."""
    rows = [(k, list(v), k == "python") for k, v in LANGUAGES.items()] + [("other", [], False)]
    return spark.createDataFrame(rows, "language string, names array<string>, parsed boolean")
