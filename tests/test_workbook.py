"""Workbooks written by hand: shared and inline strings, gaps, several sheets."""

import zipfile

from pathwarden.sources import workbook as W

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SHARED = ["학원명", "도로명주소", "가 학원", "대전 유성구 1", "대전 서구 2", "나 학원"]


def write(path, sheets, shared=SHARED):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN} {REL}><sheets>{names}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{k}" Type="t" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        if shared is not None:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r><rPh><t>x</t></rPh></si>" for s in shared) + "</sst>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")


def row(n, *cells):
    return f'<row r="{n}">' + "".join(cells) + "</row>"


s = lambda ref, k: f'<c r="{ref}" t="s"><v>{k}</v></c>'
text = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
plain = lambda ref, v, t="n": f'<c r="{ref}" t="{t}"><v>{v}</v></c>'


def test_three_sheets(spark, tmp_path):
    first = row(1, s("A1", 0), s("C1", 1)) + row(2, s("A2", 2), plain("B2", 7.5), s("C2", 3)) + row(3, s("A3", 2), s("C3", 3)) + row(5, s("A5", 5), s("C5", 4)) + row(6, s("A6", 5))
    second = row(1, text("A1", "교습소명"), text("B1", "소재지주소")) + row(2, text("A2", "다"), text("B2", "대전 유성구 9")) + row(3, plain("AA3", 1, "b"), plain("AB3", "#N/A", "e"))
    write(tmp_path / "a.xlsx", {"학원": first, "교습소": second, "빈": ""})
    write(tmp_path / "b.xlsx", {"other": row(1, text("A1", "no header")) + row(2, text("A2", "x"))}, None)
    cells = W.read_workbooks(spark, f"{tmp_path}/*.xlsx")
    got = {(r["file"][-6:], r["sheet"], r["row"]): r["cells"] for r in cells.collect()}
    assert got["a.xlsx", "학원", 1] == ["학원명", None, "도로명주소"] and got["a.xlsx", "학원", 2] == ["가 학원", "7.5", "대전 유성구 1"]
    assert got["a.xlsx", "교습소", 3] == [None] * 26 + ["TRUE", None] and ("a.xlsx", "빈", 1) not in got and len(got) == 10
    assert {r["district"]: r["count"] for r in W.academy_counts(cells).collect()} == {"유성구": 2, "서구": 1}


def test_no_workbook_rows(spark, tmp_path):
    write(tmp_path / "a.xlsx", {"빈": ""}, None)
    assert W.academy_counts(W.read_workbooks(spark, str(tmp_path))).count() == 0
