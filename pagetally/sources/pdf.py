"""Page counts of PDF files: a data source that reads a file's end and its page tree, not its pages.

`spark.read.format("pdf_pages").load(folder)` gives path, pages and error of every file with a matching name at any depth,
one partition for every `perPartition` files. A file is opened where the folder's file system has it (a scheme that
pyarrow knows), and only its last kilobyte, its cross-reference table and the objects on the way to the page tree's root
are read. A file that cannot be read is a row with its error and no number; the job goes on. The source's paths are planned
on the driver; for folders with more files than it can hold, `pages_of` takes paths that tasks have listed.

The page tree's root says how many pages it has; where it does not, the tree is walked. Files whose cross-references are
compressed are read whole, and their plain page objects counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, pages int, error string"
_TAIL = 1024
_OBJECT = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.DOTALL)


class Unreadable(ValueError):
    """Not a PDF file, or one without a page tree."""


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", folder) if re.match(r"\w+:", folder) else folder)


class _File:
    def __init__(self, handle, size: int):
        self.handle, self.size, self.places = handle, size, {}

    def at(self, start: int, n: int) -> bytes:
        if not 0 <= start < self.size:
            raise Unreadable(f"offset {start} is outside the file")
        self.handle.seek(start)
        return self.handle.read(n)

    def object(self, number: int) -> bytes:
        """An object's text; more is read until its end is there."""
        if number not in self.places:
            raise Unreadable(f"object {number} is missing")
        start, n = self.places[number], 2048
        while not (found := _OBJECT.match(text := self.at(start, n))):
            if start + n >= self.size or len(text) < n:
                raise Unreadable(f"object {number} has no end")
            n *= 4
        if int(found[1]) != number:
            raise Unreadable(f"object {number} is not where it should be")
        return found[3]

    def table(self, start: int) -> bytes:
        """Reads a cross-reference table, and those before it; the first place of an object stands. Gives the trailer."""
        first, seen = b"", set()
        while start not in seen:
            seen.add(start)
            n = 4096
            while b"startxref" not in (text := self.at(start, n)):
                if start + n >= self.size:
                    break
                n *= 4
            body, found, trailer = text.partition(b"trailer")
            if not found or not body.lstrip().startswith(b"xref"):
                raise LookupError("no plain cross-references")
            words, k = body.split(), 1
            while k + 1 < len(words):
                number, count = int(words[k]), int(words[k + 1])
                for i in range(count):
                    offset, _, kind = words[k + 2 + 3 * i : k + 5 + 3 * i]
                    if kind == b"n":
                        self.places.setdefault(number + i, int(offset))
                k += 2 + 3 * count
            first = first or trailer
            if not (before := re.search(rb"/Prev\s+(\d+)", trailer)):
                break
            start = int(before[1])
        return first


def _reference(text: bytes, key: bytes) -> int:
    if not (found := re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R\b", text)):
        raise Unreadable(f"no {key.decode()}")
    return int(found[1])


def _leaves(file: _File, root: int) -> int:
    """Pages of a tree; a node that comes again is not entered again."""
    todo, seen, n = [root], set(), 0
    while todo:
        number = todo.pop()
        if number in seen:
            continue
        seen.add(number)
        text = file.object(number)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", text, re.DOTALL)
        if kids is None:
            n += 1
        else:
            todo += [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R\b", kids[1])]
    return n


def count_pages(handle, size: int) -> int:
    """Pages of an open file."""
    file = _File(handle, size)
    if size == 0 or b"%PDF-" not in file.at(0, _TAIL):
        raise Unreadable("no PDF header")
    tail = file.at(max(0, size - _TAIL), _TAIL)
    if not (last := re.findall(rb"startxref\s+(\d+)", tail)):
        raise Unreadable("no startxref")
    try:
        trailer = file.table(int(last[-1]))
    except LookupError:
        return len(re.findall(rb"/Type\s*/Page\b(?!s)", file.at(0, size))) or _none()
    root = _reference(file.object(_reference(trailer, b"Root")), b"Pages")
    said = re.search(rb"/Count\s+(-?\d+)", file.object(root))
    return int(said[1]) if said and int(said[1]) >= 0 else _leaves(file, root)


def _none() -> int:
    raise Unreadable("no page objects")


def _row(system: fs.FileSystem, path: str) -> tuple[str, int | None, str | None]:
    try:
        with system.open_input_file(path) as handle:
            return path, count_pages(handle, handle.size()), None
    except (OSError, ValueError) as e:
        return path, None, f"{type(e).__name__}: {e}"


def pages_of(paths: DataFrame, folder: str) -> DataFrame:
    """path, pages, error of files (path) of a folder's file system: what the data source gives, without a listing that
    the driver holds."""
    shape = pa.schema([("path", pa.string()), ("pages", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        for b in batches:
            rows = [_row(system, path) for path in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(shape)], schema=shape)

    return paths.select("path").mapInArrow(run, SCHEMA)


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfPagesReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.pattern, self.per = options["path"], options.get("pathGlobFilter", "*.pdf"), int(options.get("perPartition", 256))

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.folder)
        found = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and fnmatch(f.base_name.lower(), self.pattern))
        return [_Paths(found[i : i + self.per]) for i in range(0, len(found), self.per)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        system, _ = opened(self.folder)
        for path in partition.paths:
            yield _row(system, path)


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PdfPagesReader(self.options)


def plain_pdf(pages: int, fan: int = 4) -> bytes:
    """A file of empty pages, `fan` to a node of its page tree. The root of every third does not say how many it has."""
    nodes = [list(range(i, min(i + fan, pages))) for i in range(0, pages, fan)]
    first = 3 + len(nodes)
    kids = " ".join(f"{3 + i} 0 R" for i in range(len(nodes)))
    said = "" if pages % 3 == 2 else f" /Count {pages}"
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}]{said} >>"]
    for own in nodes:
        inner = " ".join(f"{first + i} 0 R" for i in own)
        bodies.append(f"<< /Type /Pages /Parent 2 0 R /Count {len(own)} /Kids [{inner}] >>")
    for k in range(pages):
        bodies.append(f"<< /Type /Page /Parent {3 + k // fan} 0 R /MediaBox [0 0 595 842] >>")
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(bodies, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n{body}\nendobj\n".encode()
    start, rows = len(out), "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n{rows}trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()


def write_pdfs(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a file for each row of (path below the folder, pages); no pages: a file that nobody can read. Gives the
    paths; a task that runs again writes the same bytes once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        made: set[str] = set()
        for b in batches:
            for path, pages in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = f"{root}/{path}"
                if (parent := at.rpartition("/")[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(at) as out:
                    out.write(plain_pdf(pages) if pages else b"%PDF-1.4\nbroken")
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["path"])

    return rows.mapInArrow(run, "path string")
