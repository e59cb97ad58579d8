"""Code blocks against their SQL on headings with character references of all kinds."""

import duckdb

from sparkloom.plans.registry import ORACLE_SQL, QUERIES

HEADS = [
    "a &quot;b&quot; &lt;c&gt; &amp;&amp", "x &notit; &notin; &copy 1 &nosuch; &", "&#65;&#x42;&#X43 &#0;&#128;&#xD800;&#1114112;&#99999999999999999999;&#x00000000041;&#11;",
    "&nbsp;", "same", "&amp;lt; &hellip;&NewLine;end", "&#xfffffffffffff; &#x;&#; &#39;&apos;", "é&eacute;&eacute", "&copyx &ampamp; a&b", "q &quot",
]


def test_references_in_code(spark, tmp_path):
    rows = [(i, f"http://a.example/{i}", f"<html><h1>{h}</h1><p>t</p></html>") for i, h in enumerate(HEADS)]
    rows += [(99, "http://a.example/99", "<h1>twice</h1><h1>twice</h1><h1>once</h1>"), (100, None, "<p>none</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "pattern", "language", "content"]
    found = sorted(tuple(r) for r in QUERIES["code_blocks"](spark, str(tmp_path)).select(*columns).collect())
    assert found == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['code_blocks']})").fetchall())
    assert (0, "pre_only", "text", 'a "b" <c> &&') in found and (99, "pre_only", "text", "once") in found
