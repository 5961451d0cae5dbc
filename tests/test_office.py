"""Office files made by hand, read from their parts."""

import io
import zipfile

import pandas as pd

from corvid.sources import files, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        for name, text in parts.items():
            file.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def docx():
    body = "<w:p><w:r><w:t>First</w:t></w:r><w:r><w:t xml:space='preserve'> line</w:t><w:tab/><w:t>end</w:t></w:r></w:p><w:p/><w:p><w:r><w:t> </w:t></w:r></w:p>"
    body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:hyperlink><w:r><w:t>Sécond</w:t><w:br/><w:t>&amp; last</w:t></w:r></w:hyperlink></w:p>"
    return zipped(**{"word__document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx():
    def sheet(rows):
        return f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>"

    one = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c><c r="E1" t="inlineStr"><is><t>when</t></is></c></row>'
    one += '<row r="2"><c r="A2"><v>3</v></c><c r="B2"><v>7</v></c><c r="C2" t="str"><v>x</v></c><c r="E2" s="1"><v>45292.5</v></c></row><row r="3"/>'
    one += '<row r="4"><c r="A4"><v>4</v></c><c r="D4" t="b"><v>1</v></c><c r="C4" t="e"><v>#DIV/0!</v></c></row>'
    two = '<row r="1"><c t="s"><v>2</v></c></row><row r="2"><c><v>1.5</v></c></row><row r="3"><c><v>2</v></c></row>'
    return zipped(
        **{
            "xl__workbook.xml": f'<workbook {S}><sheets><sheet name="Öne" sheetId="1" r:id="r1"/><sheet name="two" sheetId="2" r:id="r2"/><sheet name="none" sheetId="3" r:id="r3"/></sheets></workbook>',
            "xl___rels__workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="r3" Target="worksheets/sheet3.xml"/></Relationships>',
            "xl__sharedStrings.xml": f"<sst {S}><si><t>n</t></si><si><r><t>to</t></r><r><t>tal</t></r><rPh><t>no</t></rPh></si><si><t>v</t></si></sst>",
            "xl__styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
            "xl__worksheets__sheet1.xml": sheet(one),
            "xl__worksheets__sheet2.xml": sheet(two),
            "xl__worksheets__sheet3.xml": sheet(""),
        }
    )


def test_docx():
    assert office.docx(docx()) == "First line\tend\n\nSécond\n& last"


def test_excel():
    want = ["\n=== Sheet: Öne ===\n", "n: 3 | total: 7.0 | n.1: x | when: 2024-01-01 12:00:00", "n: 4 | Unnamed: 3: True", "\n=== Sheet: two ===\n", "v: 1.5", "v: 2.0", "\n=== Sheet: none ===\n"]
    assert office.excel(xlsx()) == "\n".join(want)
    # as a data frame shows the same columns
    frame = pd.DataFrame({"n": [3, 4], "total": [7, None]})
    assert [str(x) for x in frame["n"]] == ["3", "4"] and str(frame["total"][0]) == "7.0"


def test_files_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(docx())
    (folder / "b.XLSX").write_bytes(xlsx())
    (folder / "bad.docx").write_bytes(b"no zip")
    (folder / "other.bin").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: r for r in files.documents(spark, str(folder)).collect()}
    assert got["a.docx"].text.startswith("First line") and "=== Sheet: two ===" in got["b.XLSX"].text and "other.bin" not in got
    assert got["bad.docx"].text is None and "BadZipFile" in got["bad.docx"].error

    def go():
        out = files.documents(spark, str(folder), stream=True).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        out.format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
        return sorted(r.path.rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert go() == ["a.docx", "b.XLSX", "bad.docx"]
    (folder / "c.txt").write_text("new")
    assert go() == ["a.docx", "b.XLSX", "bad.docx", "c.txt"] == go()
