"""Sheets of workbooks."""

import zipfile

from cadastra.sources import workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, shared=()):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN} {RELS}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si>{s}</si>' for s in shared)}</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")


def test_sheets(spark, tmp_path):
    shared = ["<t>ville</t>", "<r><t>pr</t></r><r><t>ix</t></r><rPh><t>x</t></rPh>", "<t>Béja</t>"]
    data = (
        '<row r="1"><c r="A1" t="inlineStr"><is><t>Titre</t></is></c></row>'
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>0</v></c></row>'
        '<row r="4"><c r="A4" t="s"><v>2</v></c><c r="D4"><v>12.5</v></c></row>'
        '<row r="5"><c r="A5" t="inlineStr"><is><t> </t></is></c></row>'
        '<row r="7"><c r="B7" t="str"><v>7</v></c><c r="AA7"><v>1</v></c></row>'
    )
    book(tmp_path / "a.xlsx", {"Vide": "", "Données": data}, shared)
    df = workbooks.sheet(spark, str(tmp_path / "a.xlsx"), "Données", header_row=2)
    assert df.columns == ["ville", "prix", "column_2", "ville_3"]
    assert sorted(map(tuple, df.collect()), key=str) == [("Béja", None, None, "12.5"), (None, "7", None, None)]
    assert len(workbooks.lines(spark, str(tmp_path / "a.xlsx"), "Données").filter("line = 6").first()["cells"]) == 27


def test_no_rows(spark, tmp_path):
    book(tmp_path / "a.xlsx", {"Vide": ""})
    assert workbooks.sheet(spark, str(tmp_path / "a.xlsx")).collect() == []
    assert workbooks.lines(spark, str(tmp_path / "a.xlsx"), "Autre").collect() == []


def test_several_files(spark, tmp_path):
    for name, value in (("a", "1"), ("b", "2")):
        book(tmp_path / f"{name}.xlsx", {"S": f"<row><c><v>9</v></c></row><row><c><v>{value}</v></c></row>"})
    assert sorted(r[0] for r in workbooks.sheet(spark, str(tmp_path / "*.xlsx")).collect()) == ["1", "2"]
