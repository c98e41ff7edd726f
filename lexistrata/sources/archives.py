"""Files inside downloaded resources: ZIP members, spreadsheets without a spreadsheet library, CSV samples.

All of it runs in Python workers on the bytes of one resource at a time; nothing is unpacked to disk.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Sequence
from pathlib import PurePosixPath
from xml.etree import ElementTree

from lexistrata.constants import ZIP_PROFILED, ZIP_SKIPPED, ZIP_SUPPORTED

ROWS = 1000
HEADER_ROWS = 10
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def is_unsafe_path(name: str) -> bool:
    """Names that lead out of the folder they would be unpacked to."""
    path = PurePosixPath(name.replace("\\", "/"))
    return path.is_absolute() or ".." in path.parts or bool(re.match(r"^[A-Za-z]:", name))


def skip_reason(name: str, size: int, most_bytes: int) -> str:
    """Why a member is not profiled; empty for one that may be."""
    ending = PurePosixPath(name).suffix.lower()
    if is_unsafe_path(name):
        return "unsafe_path"
    if ending in ZIP_SKIPPED:
        return "skipped_extension"
    if ending not in ZIP_SUPPORTED:
        return "unsupported_extension"
    return "inner_file_too_large" if size > most_bytes else ""


def zip_members(data: bytes, *, most_files: int = 20, most_bytes: int = 25 << 20) -> tuple[list[dict], str]:
    """The first members of an archive as manifest entries, those to profile with their bytes, and what went wrong."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            infos = archive.infolist()
            entries = []
            for info in [i for i in infos if not i.is_dir()][:most_files]:
                ending = PurePosixPath(info.filename).suffix.lower()
                reason = skip_reason(info.filename, info.file_size, most_bytes)
                chosen = not reason and ending in ZIP_PROFILED
                if not reason and not chosen:
                    reason = "manifest_only"
                entries.append(
                    {
                        "inner_file_name": info.filename,
                        "inner_file_extension": ending,
                        "inner_file_size_bytes": info.file_size,
                        "selected_for_schema_profile": chosen,
                        "skip_reason": reason,
                        "data": archive.read(info) if chosen else None,
                    }
                )
            if len(infos) > most_files:
                entries.append(_note(f"zip_file_limit_reached_{most_files}"))
            return entries, ""
    except UnicodeDecodeError:
        return [_note("zip_encoding_error")], "zip_encoding_error"
    except (zipfile.BadZipFile, NotImplementedError, EOFError):
        return [_note("corrupted_zip")], "corrupted_zip"


def _note(reason: str) -> dict:
    return {
        "inner_file_name": "",
        "inner_file_extension": "",
        "inner_file_size_bytes": 0,
        "selected_for_schema_profile": False,
        "skip_reason": reason,
        "data": None,
    }


def csv_table(data: bytes, rows: int = ROWS) -> list[list[str | None]]:
    """The header and first rows of a CSV file; empty cells are null."""
    text = io.TextIOWrapper(io.BytesIO(data), encoding="utf-8-sig", errors="replace", newline="")
    out = []
    for line in csv.reader(text):
        if line:
            out.append([cell if cell != "" else None for cell in line])
        if len(out) > rows:
            break
    return out


def _column(reference: str) -> int:
    number = 0
    for char in re.match(r"[A-Z]*", reference)[0]:
        number = number * 26 + ord(char) - 64
    return number - 1


def xlsx_sheets(data: bytes, rows: int = ROWS + HEADER_ROWS) -> list[tuple[str, list[list[str | None]]]]:
    """Name and first rows of every sheet of a workbook; gaps between cells are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        targets = {
            r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        }
        sheets = []
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            sheets.append((sheet.get("name"), _rows(book.read(part), shared, rows)))
        return sheets


def _rows(part: bytes, shared: list[str], most: int) -> list[list[str | None]]:
    out: list[list[str | None]] = []
    for _, node in ElementTree.iterparse(io.BytesIO(part)):
        if node.tag != f"{_MAIN}row":
            continue
        number = int(node.get("r") or len(out) + 1)
        while len(out) < min(number - 1, most):
            out.append([])
        if len(out) >= most:
            break
        line: list[str | None] = []
        for cell in node.iter(f"{_MAIN}c"):
            at = _column(cell.get("r") or "") if cell.get("r") else len(line)
            line += [None] * (at - len(line))
            line.append(_value(cell, shared))
        out.append(line)
        node.clear()
    return out


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    return value.text


def flatten_headers(headers: Sequence[str | Sequence[str | None]]) -> list[str]:
    """Names of columns; a header over several rows is its parts joined by spaces, missing ones left out."""
    named = ([header] if isinstance(header, str) else [part for part in header if part is not None and str(part) != "nan"] for header in headers)
    return [" ".join(map(str, parts)).strip() for parts in named]


def header_row(rows: list[list[str | None]]) -> int:
    """The first of the first ten rows with the most filled cells, cells with letters counting twice."""

    def worth(row: list[str | None]) -> int:
        filled = [c.strip() for c in row if c is not None and c.strip()]
        return len(filled) + sum(bool(re.search("[A-Za-z]", c)) for c in filled)

    scores = [worth(row) for row in rows[:HEADER_ROWS]]
    return scores.index(max(scores)) if scores else 0
