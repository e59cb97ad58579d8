import io
import zipfile

from sparkloom.functions import files
from sparkloom.sources.files import read_folder, stream_folder
from sparkloom.streaming.jobs import run_to_end


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = packed(word__document_DOT_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>My </w:t><w:t>Heading</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>A line. More.</w:t></w:r></w:p></w:body></w:document>")
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = packed(
    xl__workbook_DOT_xml=f'<workbook {S}><sheets><sheet name="Numbers" r:id="r1"/></sheets></workbook>',
    xl___rels__workbook_DOT_xml_DOT_rels='<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>'.replace("_rels", "_rels"),
    xl__sharedStrings_DOT_xml=f"<sst {S}><si><t>Name</t></si></sst>",
    xl__worksheets__s1_DOT_xml=f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c><c><v>2.5</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>',
)


def read(name, data):
    return files.read_file(name, data)[0]


def test_formats():
    assert read("a/my-file.md", b"# Top\n\nA first paragraph of some length.\n\n## Two\n```\n# no\n```")["tags"] == ["Top", "Two"]
    assert read("a/my-file.md", b"text")["title"] == "My File"
    assert read("t.csv", b"a,b\n1,\n2,3\n4,5,6\n")["content"] == "Headers: a | b\na: 1\na: 2, b: 3\n4 | 5 | 6"
    assert read("x.py", b"def f():\n  pass\nclass C: ...\n")["tags"] == ["python", "f", "C"]
    assert read("x.json", b'{"k": [1]}')["tags"] == ["k"] and read("x.json", b"{")["source_type"] == "plain_text"
    assert read("x.html", b"<title>T</title><p>Body")["title"] == "T"
    doc = read("some_doc.docx", DOCX)
    assert (doc["title"], doc["description"], doc["content"], doc["tags"]) == ("Some Doc", "My Heading", "My Heading\nA line. More.", ["My Heading"])
    assert "pypdf" in (read("x.pdf", b"%PDF")["error"] or "pypdf")
    assert read("x.docx", b"no zip")["error"].startswith("BadZipFile")


def test_sheets():
    with zipfile.ZipFile(io.BytesIO(XLSX)) as z:
        assert "xl/workbook.xml" in z.namelist()
    data = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(XLSX)) as a, zipfile.ZipFile(data, "w") as b:
        for n in a.namelist():
            b.writestr("xl/_rels/workbook.xml.rels" if n.endswith("rels") else n, a.read(n))
    sheet = read("s.xlsx", data.getvalue())
    assert sheet["error"] is None and sheet["content"] == "Sheet: Numbers\nName | 2 | 2.50 | Yes" and sheet["tags"] == ["Numbers"]


def test_archives_leave_out_what_leads_outside():
    data = packed(a_DOT_txt="text", d__b_DOT_md="# B", _DOT_hidden="x") + b""
    assert [(e["path"], e["title"]) for e in files.read_file("z.zip", data)] == [("z.zip!a.txt", "A"), ("z.zip!d/b.md", "B")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../evil.txt", "x")
    assert files.read_file("z.zip", out.getvalue()) == []


def test_folders_and_streams(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# A\n")
    (tmp_path / "in" / "deep" / "z.zip").write_bytes(packed(b_DOT_txt="B", c_DOT_csv="x\n1\n"))
    rows = read_folder(spark, str(tmp_path / "in")).collect()
    assert sorted(r.source_type for r in rows) == ["csv", "markdown", "plain_text"] and len({r.entry_id for r in rows}) == 3
    assert read_folder(spark, str(tmp_path / "in"), most_bytes=5).count() == 1
    sink = run_to_end(stream_folder(spark, str(tmp_path / "in")), "files")
    assert [r.title for r in spark.read.parquet(sink).collect()] == ["A"]
