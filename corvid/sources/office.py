"""Word documents and Excel workbooks from their zipped XML parts, without further libraries.

XML is read as a stream, so what is held of a sheet is a row, and of a workbook the
shared strings. Values are shown as a data frame would: a column of whole numbers
with gaps shows them with a decimal place, dates with their time.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats of dates and times among those that need no description.
_DATES = {*range(14, 23), *range(45, 48)}


def _elements(part, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag in order, each emptied when the next one is asked for."""
    for _, element in ElementTree.iterparse(part):
        if element.tag == tag:
            yield element
            element.clear()


def paragraphs(content: bytes) -> list[str]:
    """Texts of the paragraphs of a document's body, blank ones left out; tables are not read."""
    out, depth = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as file, file.open("word/document.xml") as part:
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            if element.tag == f"{_W}tbl":
                depth += 1 if event == "start" else -1
            if event == "end" and element.tag == f"{_W}p":
                if not depth and (text := _runs(element)).strip():
                    out.append(text)
                element.clear()
    return out


def _runs(paragraph: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
    texts = []
    for run in paragraph.iter(f"{_W}r"):
        texts += [x.text or "" if x.tag == f"{_W}t" else marks[x.tag] for x in run if x.tag == f"{_W}t" or x.tag in marks]
    return "".join(texts)


def docx(content: bytes) -> str:
    """Non-blank paragraphs, parted by blank lines."""
    return "\n\n".join(paragraphs(content))


def _strings(file: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in file.namelist():
        return []
    with file.open("xl/sharedStrings.xml") as part:
        return [_string(x) for x in _elements(part, f"{_S}si")]


def _string(element: ElementTree.Element) -> str:
    """A string's text, of one run or several, without readings."""
    return "".join((x.text or "") for child in element for x in ([child] if child.tag == f"{_S}t" else child.iter(f"{_S}t") if child.tag == f"{_S}r" else []))


def _date_styles(file: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in file.namelist():
        return set()
    root = ElementTree.fromstring(file.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", "")) for x in root.iter(f"{_S}numFmt")}
    dates = _DATES | {k for k, code in own.items() if re.search("[dmyhs]", code.lower().replace("general", ""))}
    formats = root.find(f"{_S}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dates}


def _column(reference: str) -> int:
    """Place of a cell's column, from 0: A1 is in the first."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _value(cell: ElementTree.Element, strings: list[str], dates: set[int], start: datetime.datetime):
    kind, value = cell.get("t", "n"), cell.findtext(f"{_S}v")
    if kind == "inlineStr":
        inner = cell.find(f"{_S}is")
        return None if inner is None else _string(inner)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return value == "1"
    if kind in ("str", "d"):
        return value
    number = float(value)
    if int(cell.get("s", 0)) in dates:
        return start + datetime.timedelta(milliseconds=round(number * 86_400_000))
    return int(number) if number.is_integer() and not re.search("[.eE]", value) else number


def _rows(file: zipfile.ZipFile, path: str, strings: list[str], dates: set[int], start: datetime.datetime) -> Iterator[dict[int, object]]:
    """Values by column of each row that has some."""
    with file.open(path) as part:
        for row in _elements(part, f"{_S}row"):
            values, at = {}, -1
            for cell in row.findall(f"{_S}c"):
                at = _column(cell.get("r")) if cell.get("r") else at + 1
                if (value := _value(cell, strings, dates, start)) is not None and value != "":
                    values[at] = value
            if values:
                yield values


def _names(first: dict[int, object], width: int) -> list[str]:
    """Column names from the first row: empty ones are numbered, repeated ones told apart."""
    out: list[str] = []
    times: dict[str, int] = {}
    for i in range(width):
        name = str(first[i]) if i in first else f"Unnamed: {i}"
        n = times.get(name, 0)
        times[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def sheets(content: bytes) -> Iterator[tuple[str, Iterator[str]]]:
    """Name and lines of each sheet of a workbook, a line ``column: value | ...`` for each row with values."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        book = ElementTree.fromstring(file.read("xl/workbook.xml"))
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(file.read("xl/_rels/workbook.xml.rels"))}
        settings = book.find(f"{_S}workbookPr")
        late = settings is not None and settings.get("date1904") in ("1", "true")
        start = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30)
        strings, dates = _strings(file), _date_styles(file)
        for sheet in book.iter(f"{_S}sheet"):
            target = links[sheet.get(f"{_R}id")]
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if path in file.namelist():
                yield sheet.get("name"), _lines(lambda path=path: _rows(file, path, strings, dates, start))


def _lines(rows) -> Iterator[str]:
    first, width, n = None, 0, 0
    numbers: dict[int, int] = {}
    other: set[int] = set()
    broken: set[int] = set()
    for values in rows():  # once for the columns' kinds
        width = max(width, max(values) + 1)
        if first is None:
            first = values
            continue
        n += 1
        for i, v in values.items():
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                other.add(i)
            else:
                numbers[i] = numbers.get(i, 0) + 1
                if isinstance(v, float):
                    broken.add(i)
    if first is None:
        return
    names = _names(first, width)
    decimal = {i for i, k in numbers.items() if i not in other and (k < n or i in broken)}
    body = rows()
    next(body)
    for values in body:
        yield " | ".join(f"{names[i]}: {float(v) if i in decimal else v}" for i, v in sorted(values.items()))


def excel(content: bytes) -> str:
    """Each sheet's heading and lines."""
    out = []
    for name, lines in sheets(content):
        out.append(f"\n=== Sheet: {name} ===\n")
        out.extend(lines)
    return "\n".join(out)
