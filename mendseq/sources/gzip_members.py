"""Lines of gzip files in ranges: a data source for files of many members.

gzip files may consist of members, each compressed on its own: block-compressed
sequencing files do, and so do outputs put together from parts. A range of a file begins at
the first member that starts in it and ends where the first one behind it starts, so
ranges are read by different tasks without an index. A place is a member's start if
what follows inflates to the member's end with the right checksum. Lines may cross members:
a range leaves its first piece of a line to the range before, as Spark's text source does.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "gzip_members"
# File systems that tasks open by themselves; elsewhere Spark's text source reads a file in one task.
SCHEMES = ("file", "hdfs")
# How a member starts (magic number, deflate), and the bits of its flags that have a meaning.
MAGIC, FLAGS = b"\x1f\x8b\x08", 0x1F
# Bytes read at once, and bytes of text in a batch.
CHUNK, BATCH = 1 << 20, 4 << 20


def members(file, at: int, size: int) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(start, pieces of text) of the members from the one that starts at ``at`` on; each is to be read to its end."""
    file.seek(at)
    rest, place = b"", at
    while place < size or rest:
        if not rest:
            rest = file.read(CHUNK)
            if not rest:
                return
        if rest.strip(b"\0") == b"":  # padding behind the last member
            place, rest = place + len(rest), b""
            continue
        state = zlib.decompressobj(wbits=31)

        def pieces(data: bytes) -> Iterator[bytes]:
            nonlocal rest, place
            while True:
                place += len(data)
                yield state.decompress(data, CHUNK)
                while state.unconsumed_tail:
                    yield state.decompress(state.unconsumed_tail, CHUNK)
                if state.eof:
                    break
                data = file.read(CHUNK)
                if not data:
                    raise EOFError(f"gzip member ends early at byte {place}")
            rest = state.unused_data
            place -= len(rest)

        yield place, pieces(rest)


def is_member(file, at: int, size: int) -> bool:
    """Whether a whole member starts here."""
    try:
        _, text = next(members(file, at, size))
        for _ in text:
            pass
    except (zlib.error, EOFError, StopIteration):
        return False
    return True


def first_member(file, start: int, end: int, size: int) -> int | None:
    """The start of the first member in [start, end)."""
    if start == 0:
        return 0
    at = start
    while at < end:
        file.seek(at)
        window = file.read(min(CHUNK, end - at) + len(MAGIC))
        found = window.find(MAGIC)
        while found >= 0 and at + found < end:
            flags = window[found + 3:found + 4]
            if (not flags or flags[0] <= FLAGS) and is_member(file, at + found, size):
                return at + found
            found = window.find(MAGIC, found + 1)
        at += len(window) - len(MAGIC) if len(window) > len(MAGIC) else end
    return None


def range_text(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """Text of the lines that begin in the range, in pieces."""
    first = first_member(file, start, end, size)
    if first is None:
        return
    # All but the file's first range leave what comes before the first line end to the range before.
    skipping, beyond = start > 0, False
    for at, text in members(file, first, size):
        beyond = beyond or at >= end
        if beyond and skipping:  # no line begins here
            return
        for piece in text:
            if skipping or beyond:
                line_end = piece.find(b"\n") + 1
                if beyond and line_end:
                    yield piece[:line_end]
                    return
                if skipping:
                    piece, skipping = piece[line_end:] if line_end else b"", not line_end
            if piece:
                yield piece


def lines_of(pieces: Iterator[bytes]) -> Iterator[list[str]]:
    """Batches of lines; line ends are \\n, and a last line may lack one."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece)
        if n >= BATCH and b"\n" in piece:
            text, _, left = b"".join(held).rpartition(b"\n")
            yield text.decode(errors="replace").split("\n")
            held, n = [left], len(left)
    text = b"".join(held)
    if text:
        yield text.decode(errors="replace").removesuffix("\n").split("\n")


class Range(InputPartition):
    def __init__(self, name: str, uri: str, start: int, end: int, size: int):
        self.name, self.uri, self.start, self.end, self.size = name, uri, start, end, size


class GzipMembers(DataSource):
    """``files``: JSON of [name, URI, bytes] per file; ``range``: bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_path string, block_start long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]), int(self.options["range"]))


class _Reader(DataSourceReader):
    def __init__(self, files: list, step: int):
        self.files, self.step = files, step

    def partitions(self) -> list[Range]:
        return [Range(name, uri, start, min(start + self.step, size), size)
                for name, uri, size in self.files for start in range(0, size, self.step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(part.uri)
        with system.open_input_file(path) as file:
            for lines in lines_of(range_text(file, part.start, part.end, part.size)):
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.name] * n), pa.array([part.start] * n, pa.int64()), pa.array(lines, pa.string())],
                    names=["file_path", "block_start", "value"])
