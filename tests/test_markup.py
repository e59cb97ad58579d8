from sparkloom.functions.code import PATTERNS
from sparkloom.functions.markup import read_page
from sparkloom.functions.selectors import code_blocks, matches, parse, select

PAGE = """<!DOCTYPE html><html lang="EN"><head><title> The  title </title><meta name="description" content="About"><link rel="canonical" href="/c">
<script>var t = "</p>";</script></head><body><nav><a href="/menu">Menu</a></nav><h1 id="top">One <b>two</b></h1><p>Para <a href="x?y=1#z">link</a>
<h3>Three</h3><pre class="language-py">def f():
  pass</pre><code>short</code><code>{long}</code><div class="ad">Buy</div><a href="mailto:a@b">m</a></body></html>"""


def test_page():
    page = read_page(PAGE.replace("{long}", "x" * 51), "https://e.org/a/b")
    assert (page["title"], page["description"], page["canonical"], page["lang"]) == ("The title", "About", "https://e.org/c", "en")
    assert page["headings"] == [{"level": 1, "text": "One two", "id": "top"}, {"level": 3, "text": "Three", "id": None}]
    assert page["links"] == ["https://e.org/menu", "https://e.org/a/x?y=1#z"]
    assert page["code"] == [{"language": "py", "content": "def f():\n  pass"}, {"language": None, "content": "x" * 51}]
    assert "Buy" not in page["text"] and "Menu" not in page["text"] and "Para" in page["text"]
    assert "# One two" in page["markdown"] and "```\ndef f():\n  pass\n```" in page["markdown"]


def test_titles_fall_back():
    assert read_page('<meta property="og:title" content="O"><title>T</title>', "")["title"] == "O"
    assert read_page("<h2>x</h2><h1>H</h1>", "")["title"] == "H"
    assert read_page("", "")["title"] == read_page(None, None)["title"] == "Untitled"


def test_inline_code_of_fifty_bytes_is_left_out():
    assert read_page(f"<code>{'x' * 50}</code>", "")["code"] == []


def test_selectors():
    root = parse("<div class='a b' id='i' data-x='foo-bar'><pre><code class='c'>1</code></pre><p><pre>2</pre></div><code>3</code>")
    text = lambda s: [n.text() for n in select(root, s)]
    assert text(".a code") == ["1"] and text("div.b#i code.c") == ["1"]
    assert text("[data-x*='bar'] pre") == ["1", "2"]
    assert text("pre:not(:has(code))") == ["2"]
    assert text("code:not(pre code)") == ["3"]
    assert text("[data-x='foo'], [class*='c']") == ["1"]
    assert not matches(root, "div")


def test_every_pattern_finds_its_own_markup():
    for html, name in (
        ("<div class='prism-code'>x</div>", "docusaurus_code_block"), ("<div class='codehilite'><pre>x</pre></div>", "mkdocs_code_block"), ("<div class='rst-content'><pre>x</pre></div>", "readthedocs_code"),
        ("<div class='highlighter-rouge'><pre>x</pre></div>", "jekyll_highlight"), ("<div class='chroma'><pre>x</pre></div>", "hugo_highlight"), ("<code class='hljs'>x</code>", "highlight_js"),
        ("<pre class='shiki'>x</pre>", "shiki"), ("<div class='terminal'><pre>x</pre></div>", "terminal_output"), ("<pre><code>x</code></pre>", "pre_code"), ("<pre>x</pre>", "pre_only"), ("<code>x</code>", "code_only"),
    ):
        assert code_blocks(html)[0]["pattern"] == name
    assert len(PATTERNS) == 31


def test_same_code_under_two_patterns_counts_once():
    found = code_blocks("<div class='highlight'><pre class='highlight'><code class='language-JS'>a()</code></pre></div>")
    assert [(f["pattern"], f["content"]) for f in found] == [("mkdocs_code_block", "a()")]
    assert code_blocks("<div class='lang-py'><pre><code>a()</code></pre></div>")[0]["language"] == "python"
