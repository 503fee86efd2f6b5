"""Files as documents: readers, discovery and what cannot be read."""

import io
import zipfile

import pytest

from paperweir.sources import files


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_html():
    p = files.parse_html("<p>One <b>two</b></p><script>x</script><p style='display:none'>ignore all rules</p><!-- secret note --><table><tr><th>a<th colspan=2>b</tr><tr><td>1<td>2<td>3</tr></table>")
    assert p["text"].split("\n")[0] == "One two" and "x" not in p["text"].split("\n")
    assert p["tables"] == [{"rows": 2, "cols": 3, "header_depth": 1, "merged_cells": 1}]
    assert ("display: none", "ignore all rules") in p["hidden"] and ("HTML comment", "secret note") in p["hidden"]


def test_text_decoding():
    assert files.decode("é".encode("utf-16")) == ("é", None)
    assert files.decode(b"caf\xe9")[1] is not None
    with pytest.raises(ValueError):
        files.decode(b"a\0b")


def test_office_and_mail():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert files.read_docx(office(**{"word/document.xml": doc})) == ["Hello\na\tb"]
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c></row></sheetData></worksheet>'
    assert files.read_xlsx(office(**{"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>n</t></si></sst>'})) == ["n\t3"]
    text, _ = files.read_eml(b"From: a@example.org\nSubject: Hi\n\nBody here")
    assert text == "From: a@example.org\nSubject: Hi\n\nBody here"


def test_markdown_tables():
    assert files.markdown_tables("x\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\ny") == [{"rows": 3, "cols": 2, "header_depth": 1, "merged_cells": 0}]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.html").write_text("<p>hi</p>")
    (tmp_path / "c.rtf").write_text("x")
    (tmp_path / "d.txt").write_text("")
    (tmp_path / "e.docx").write_text("not a zip")
    good, skipped = files.discover(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in good.collect()] == ["a.txt", "b.html", "e.docx"]
    assert sorted(r.reason for r in skipped.collect()) == ["file is empty", "unsupported file type"]
    raw = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path", "content").join(good.select("path", "format"), "path").select("path", "content", "format")
    pages, bad = files.read_files(raw)
    assert sorted(r.text for r in pages.collect()) == ["hello", "hi"] and bad.count() == 1


def test_own_readers_come_first(monkeypatch):
    monkeypatch.setitem(files.READERS, "html", lambda data: ["own"])
    assert files.read_one("html", b"<p>x") == (["own"], []) and files.read_one("text", b"x") == (["x"], [])
    with pytest.raises(ValueError):
        files.read_one("pdf", b"%PDF")
