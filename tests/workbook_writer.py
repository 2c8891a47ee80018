"""Write tiny .xlsx files with the standard library, for the reader's tests."""

import zipfile
from xml.sax.saxutils import escape

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _ref(row, col):
    letters = ""
    col += 1
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def write_workbook(path, sheets, formats=(), shared=True, parts=None):
    """``sheets``: name -> (rows, merges).  A cell is None, text, bool, number or (number, style)."""
    strings, given = [], parts or {}

    def cell(r, c, v):
        ref = _ref(r, c)
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, tuple):
            return f'<c r="{ref}" s="{v[1]}"><v>{v[0]}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><f>1+1</f><v>{v}</v></c>'
        if shared:
            strings.append(v)
            return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    parts = {}
    for i, (rows, merges) in enumerate(sheets.values(), 1):
        body = "".join(
            f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1)
        )
        merged = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
        merged = f"<mergeCells>{merged}</mergeCells>" if merged else ""
        parts[f"xl/worksheets/sheet{i}.xml"] = f"{_HEAD}<worksheet {_MAIN}><sheetData>{body}</sheetData>{merged}</worksheet>"
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f"{_HEAD}<workbook {_MAIN} {_REL}><sheets>{names}</sheets></workbook>"
    links = "".join(
        f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml" Type="sheet"/>' for i in range(1, len(sheets) + 1)
    )
    parts["xl/_rels/workbook.xml.rels"] = (
        f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    )
    if strings:
        items = "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r></si>" for s in strings)
        parts["xl/sharedStrings.xml"] = f"{_HEAD}<sst {_MAIN}>{items}</sst>"
    own = "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{escape(f)}"/>' for i, f in enumerate(formats))
    xfs = '<xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{164 + i}"/>' for i in range(len(formats)))
    parts["xl/styles.xml"] = f"{_HEAD}<styleSheet {_MAIN}><numFmts>{own}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>"
    parts |= given
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
