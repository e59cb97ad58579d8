from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import chunkers as c


def test_windows_in_spark_equal_windows_in_python(spark):
    texts = ["", " ", "a" * 250, "b" * 100, "c" * 101, "é" * 333, "word " * 90]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    found = {r.i: r.w for r in rows.select("i", c.windows(F.col("x"), 100, 20).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert found[i] == c.slide(t, 100, 20)


def test_summary_is_cut_in_characters(spark):
    row = spark.createDataFrame([("T", "D", ["x", "y"]), ("T", "", []), ("é" * 40, "", [])], "t string, d string, g array<string>")
    assert [r[0] for r in row.select(c.summary(F.col("t"), F.col("d"), F.col("g"), 30)).collect()] == ["T. D. Tags: x, y", "T", "é" * 40]


def test_paragraphs_and_sentences():
    assert c.by_paragraphs("a\n\nb\n\nc", 4, 0) == ["a\n\nb", "c"]
    assert c.by_paragraphs("One two. Three four! Five?", 12, 0) == ["One two.", "Three four!", "Five?"]
    assert c.by_sentences("aaaa. bbbb. cccc.", 11, 0) == ["aaaa. bbbb.", "cccc."]
    assert c.by_sentences("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]


def test_smart_split_breaks():
    assert c.smart_split("aaaa aaaa. bbbb bbbb", 15) == ["aaaa aaaa.", "bbbb bbbb"]
    assert c.smart_split("text text\n\nmore of it", 15) == ["text text", "more of it"]
    assert c.smart_split("word word word ```code``` x", 22)[0] == "word word word"
    assert c.smart_split("ab. " + "c" * 30, 20)[0].startswith("ab. c")  # a break before 30 % doesn't count
    assert c.smart_split("", 10) == []


@settings(max_examples=100, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="aé🎉 .\n`#", max_size=120), st.integers(1, 40))
def test_smart_split_keeps_all_text(text, size):
    joined = "".join("".join(c.smart_split(text, size)).split())
    assert joined == "".join(text.split())


def test_merge_small_and_kinds():
    assert c.merge_small(["a", "b", "c" * 10, "d"], 5) == ["a\n\nb\n\n" + "c" * 10, "d"]
    assert [c.kind_of(t) for t in ("```x```", "a\n```", "# T\nx", "# T\n1\n2\n3", "x")] == ["code", "code", "header", "content", "content"]


MD = "intro\n# A\ntext a\n## B\ntext b\n```\n# no header\n```\n# C\n####### seven\n"


def test_markdown_sections_in_spark_and_python(spark):
    df = spark.createDataFrame([(1, MD), (2, ""), (3, "no header"), (4, "# only")], "k int, t string")
    rows = c.sections(df, "k", "t").orderBy("k", "section").collect()
    for k, t in ((1, MD), (2, ""), (3, "no header"), (4, "# only")):
        assert [(r.header, r.level, r.body) for r in rows if r.k == k] == c.markdown_sections(t)
    assert [r.start for r in rows if r.k == 1] == [0, 6, 17, 33, 49]


def test_markdown_chunks_carry_their_path():
    text = "# A\n" + "word " * 10 + "\n## B\n" + "\n\n".join(["para " * 12] * 4)
    found = c.markdown_chunks(text, 120, 10, 20)
    assert found[0] == ("header", "# A\n\n" + ("word " * 10).strip())
    assert found[1][1].startswith("# A > ## B\n\npara") and found[2][1].startswith("# A > ## B\n\n(continued)\n\npara")


def test_code_chunks():
    source = "import os\n\n@x\ndef f():\n    return 1\n\nclass C:\n    def m(self):\n        pass\n"
    assert [(k, n) for k, n, _ in c.code_chunks(source, "python")] == [("group", "f, C")]
    assert [(k, n) for k, n, _ in c.code_chunks(source, "python", 30)] == [("function", "f"), ("class", "C")]
    assert [(k, n) for k, n, _ in c.code_chunks("pub fn a() {}\n\nstruct B;\n", "rust", 20)] == [("function", "a"), ("struct", "B")]
    assert c.code_chunks("x = 1\n", "python") == [("file", "", "x = 1\n")]


def test_fence_parts(spark):
    row = spark.createDataFrame([("a```b```c",)], "t string").select(c.fence_parts(F.col("t"))).first()[0]
    assert [(r.part, r.code, r.text) for r in row] == [(0, False, "a"), (1, True, "b"), (2, False, "c")]
