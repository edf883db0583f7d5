"""Text members of ZIP archives: listed from the central directories, dealt to tasks in ranges, streamed once."""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.operators.folding import staged

#: Compressed bytes of a range of members, and ranges that are read at a time at most.
SPAN, TASKS = 64 << 20, 10_000
#: Bytes of text that a task holds before it hands them on.
BATCH = 8 << 20


_MEMBER = pa.struct([("name", pa.string()), ("offset", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("method", pa.int32()), ("flags", pa.int32())])
_RANGES = pa.schema([("archive", pa.string()), ("low", pa.int64()), ("packed", pa.int64()), ("members", pa.list_(_MEMBER))])


def _located(path: str) -> tuple[FileSystem, str]:
    """The file system of a path as Spark writes it: with or without a scheme, nothing escaped."""
    scheme, colon, rest = path.partition(":")
    return FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}" if colon and "/" not in scheme else path)


@contextmanager
def _opened(path: str) -> Iterator[zipfile.ZipFile]:
    files, inner = _located(path)
    with files.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
        yield archive


def _entries(archive: zipfile.ZipFile, wanted: re.Pattern) -> list[zipfile.ZipInfo]:
    """The wanted members in the order of their bytes."""
    return sorted((e for e in archive.infolist() if not e.is_dir() and wanted.search(e.filename)), key=lambda e: e.header_offset)


def _inflated(head: bytes, body: bytes, entry: dict) -> bytes:
    """A member of its local header and the bytes behind it, checked against the directory's length and checksum."""
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no local header of {entry['name']}")
    skip = int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    raw = body[skip : skip + entry["packed"]]
    if entry["method"] == zipfile.ZIP_DEFLATED:
        inflater = zlib.decompressobj(-15)
        raw = inflater.decompress(raw) + inflater.flush()
    if len(raw) != entry["size"] or zlib.crc32(raw) != entry["crc"]:
        raise zipfile.BadZipFile(f"bad length or CRC-32 of {entry['name']}")
    return raw


def _texts(path: str, entries: list[dict]) -> Iterator[str]:
    """Texts of the listed members, from their own bytes; the archive's directory is read again only for members that are
    encrypted or packed by a rarer method."""
    files, inner = _located(path)
    rare = {e["offset"] for e in entries if e["flags"] & 0x21 or e["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)}
    with files.open_input_file(inner) as file, (zipfile.ZipFile(file) if rare else nullcontext()) as archive:
        listed = {e.header_offset: e for e in archive.infolist()} if rare else {}
        for entry in entries:
            if entry["offset"] in rare:
                raw = archive.read(listed[entry["offset"]])
            else:
                file.seek(entry["offset"])
                head = file.read(30)
                names = int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                raw = _inflated(head, file.read(names + entry["packed"]), entry)
            yield raw.decode("utf-8", "replace")


def read_archives(spark: SparkSession, folder: str, wanted: str = "", *, span: int = SPAN) -> DataFrame:
    """(archive, low, name, text) for each member of the ``*.zip`` files below ``folder`` whose path the pattern ``wanted`` finds.

    The archives' directories are read once, by tasks, and give ranges of members of about ``span`` compressed bytes, each
    member with its place; ranges, not archives, are dealt to the tasks of the read, so one huge archive is read by many, and a
    range is read without the directory.  Each member is read once, whole; bytes that are not UTF-8 become U+FFFD.  Members
    of one name are all read; directories are no members; a damaged member ends the read with an error.  ``low`` is the place
    of the member's range.
    """
    pattern = re.compile(wanted)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _opened(path) as archive:
                    entries = _entries(archive, pattern)
                members, size, low = [], 0, 0
                for k, e in enumerate(entries):
                    members.append({"name": e.filename, "offset": e.header_offset, "packed": e.compress_size, "size": e.file_size, "crc": e.CRC, "method": e.compress_type, "flags": e.flag_bits})
                    size += e.compress_size
                    if size >= span or k + 1 == len(entries):
                        yield pa.RecordBatch.from_pylist([{"archive": path, "low": low, "packed": size, "members": members}], _RANGES)
                        members, size, low = [], 0, k + 1

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path, low, listed = (batch.column(c)[row].as_py() for c in range(3))
                names, texts, size = [], [], 0
                for k, (entry, text) in enumerate(zip(listed, _texts(path, listed), strict=True), 1):
                    names.append(entry["name"])
                    texts.append(text)
                    size += entry["size"]
                    if size >= BATCH or k == len(listed):
                        yield pa.RecordBatch.from_pydict({"archive": [path] * len(names), "low": [low] * len(names), "name": names, "text": texts})
                        names, texts, size = [], [], 0

    member = "struct<name string, offset long, packed long, size long, crc long, method int, flags int>"
    found = staged(files.select("path").mapInArrow(ranges, f"archive string, low long, packed long, members array<{member}>"), "archive-ranges")
    count, packed = found.agg(F.count("*"), F.coalesce(F.sum("packed"), F.lit(0))).first()
    tasks = max(1, min(count, TASKS, max(4 * spark.sparkContext.defaultParallelism, packed // SPAN)))
    return found.repartition(tasks).select("archive", "low", "members").mapInArrow(members, "archive string, low long, name string, text string")


def write_archives(members: DataFrame, folder: str) -> None:
    """``members`` (name, text) as ZIP files below ``folder``, one for each partition that has rows; a null text is an empty
    member.  A task writes under a name of its own attempt and renames at its end, so a task run twice leaves one archive."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, inner = _located(folder)
        own, n = f"{inner}/.part-{task.partitionId():05d}-{task.taskAttemptId()}", 0
        rows = ((name, text) for b in batches for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), strict=True))
        first = next(rows, None)
        if first is not None:
            files.create_dir(inner, recursive=True)
            with files.open_output_stream(own) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                while first is not None:
                    entry = zipfile.ZipInfo(first[0])
                    entry.compress_type = zipfile.ZIP_DEFLATED
                    archive.writestr(entry, (first[1] or "").encode("utf-8", "surrogatepass"))
                    first, n = next(rows, None), n + 1
            files.move(own, f"{inner}/part-{task.partitionId():05d}.zip")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    members.select("name", "text").mapInArrow(written, "n long").write.format("noop").mode("overwrite").save()
