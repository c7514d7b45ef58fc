"""Sinks that write files or none: ``file_set`` (path, content) and ``pdf_files`` (document, place, content, width, height).

Tasks write into a folder of this write's own, beside the files; the commit moves what finished tasks reported, an abort removes the
folder, and with it what failed or repeated tasks left.  A file that is there already makes the commit fail, which takes back what it
had moved.  A PDF is written page by page: a task holds one page and the offsets of the document's objects, so neither pages nor
bytes of a document are bounded.  Rows have to come by document and place, which ``write_pdfs`` sees to.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# fixed values: the longest edge of a page is the height of an A4 sheet, in points
LONGEST_EDGE = 841.89


@dataclass
class Written(WriterCommitMessage):
    """(where a task wrote, where it belongs) of its files, under the sink's folder."""

    files: list[tuple[str, str]]


def inside(path: str) -> str:
    """The path, if it stays within the sink's folder."""
    parts = (path or "").split("/")
    if any(p in ("", ".", "..") for p in parts) or "\\" in path or "\0" in path:
        raise ValueError(f"no safe file name: {path!r}")
    return path


class Aside(DataSourceWriter):
    """Writes aside; moves on commit, removes on abort."""

    def __init__(self, path: str) -> None:
        self.path, self.folder = path, f".pending-{uuid.uuid4().hex}"

    def store(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path)
        return store, root.rstrip("/")

    def begin(self, name: str) -> tuple[fs.FileSystem, str, str]:
        """(file system, full path, path under the sink's folder) of a new file of this task's attempt."""
        store, root = self.store()
        made = f"{self.folder}/{uuid.uuid4().hex}/{inside(name)}"
        store.create_dir(f"{root}/{made}".rsplit("/", 1)[0], recursive=True)
        return store, f"{root}/{made}", made

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self.store()
        files, moved = [f for m in messages if m for f in m.files], []
        try:
            if len({name for _, name in files}) < len(files):
                raise FileExistsError("two rows have the same file name")
            for made, name in files:
                if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                    raise FileExistsError(f"{name} is there already")
                store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                store.move(f"{root}/{made}", f"{root}/{name}")
                moved.append(name)
        except BaseException:
            for name in moved:
                store.delete_file(f"{root}/{name}")
            raise
        finally:
            self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        store, root = self.store()
        if store.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.folder}")


class FileWriter(Aside):
    def write(self, iterator: Iterator[Row]) -> Written:
        files = []
        for row in iterator:
            store, full, made = self.begin(row["path"])
            with store.open_output_stream(full) as out:
                out.write(bytes(row["content"] or b""))
            files.append((made, row["path"]))
        return Written(files)


class Pdf:
    """A PDF file that grows by a page at a time."""

    def __init__(self, out) -> None:
        self.out, self.at, self.places, self.kids = out, 0, {}, []
        self.put(b"%PDF-1.4\n")

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def object(self, number: int, body: bytes) -> None:
        self.places[number] = self.at
        self.put(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def page(self, picture: bytes, width: int, height: int) -> None:
        scale = LONGEST_EDGE / max(width, height)
        w, h = b"%.2f" % (width * scale), b"%.2f" % (height * scale)
        drawing = b"q %s 0 0 %s 0 0 cm /P Do Q" % (w, h)
        page = 3 + 3 * len(self.kids)
        self.kids.append(page)
        self.object(page, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %s %s] /Resources << /XObject << /P %d 0 R >> >> /Contents %d 0 R >>" % (w, h, page + 2, page + 1))
        self.object(page + 1, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(drawing), drawing))
        head = b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>" % (width, height, len(picture))
        self.object(page + 2, head + b"\nstream\n" + picture + b"\nendstream")

    def end(self) -> None:
        self.object(1, b"<< /Type /Catalog /Pages 2 0 R >>")
        self.object(2, b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in self.kids), len(self.kids)))
        table, size = self.at, len(self.places) + 1
        self.put(b"xref\n0 %d\n0000000000 65535 f \n" % size)
        for number in range(1, size):
            self.put(b"%010d 00000 n \n" % self.places[number])
        self.put(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, table))


class PdfWriter(Aside):
    def write(self, iterator: Iterator[Row]) -> Written:
        files, at, pdf, out = [], None, None, None
        try:
            for row in iterator:
                if row["document"] != at:
                    if pdf:
                        pdf.end()
                        out.close()
                    at = row["document"]
                    store, full, made = self.begin(f"{at}.pdf")
                    files.append((made, f"{at}.pdf"))
                    out = store.open_output_stream(full)
                    pdf = Pdf(out)
                if not row["content"] or not row["width"] or not row["height"] or min(row["width"], row["height"]) < 1:
                    raise ValueError(f"page {row['place']} of {at} has no picture")
                pdf.page(bytes(row["content"]), row["width"], row["height"])
            if pdf:
                pdf.end()
        finally:
            if out:
                out.close()
        return Written(files)


class FileSet(DataSource):
    """Rows as files: path under the sink's folder, content."""

    @classmethod
    def name(cls) -> str:
        return "file_set"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"])


class PdfFiles(DataSource):
    """Rows as pages of PDF files that bear their document's name."""

    @classmethod
    def name(cls) -> str:
        return "pdf_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PdfWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Writes files (path, content) into a folder: all or none."""
    files.sparkSession.dataSource.register(FileSet)
    files.select("path", "content").write.format("file_set").mode("append").save(path)


def write_pdfs(pages: DataFrame, path: str) -> None:
    """Writes pages (document, place, content, width, height) as one PDF a document into a folder: all or none."""
    pages.sparkSession.dataSource.register(PdfFiles)
    ordered = pages.select("document", "place", "content", "width", "height").repartition("document").sortWithinPartitions("document", "place")
    ordered.write.format("pdf_files").mode("append").save(path)
