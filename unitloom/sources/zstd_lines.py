"""Lines of Zstandard files as a Spark data source, read and written frame by frame.

A file is planned as byte ranges of its compressed size alone.  The task of a range finds the frames that begin in it by
their headers: a candidate counts only if its block headers lead to the next frame or to the end of the file.  As
with plain text, a task leaves out everything up to the first line end (unless its first frame begins the file) and reads on
past its range up to the end of the line that it is in, so every line comes once, whatever frames it lies in.  A file of one frame is
one task's work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import ship

FORMAT = "zstdlines"
#: Fixed values of the format: the sign of a frame, and the first of sixteen signs of a frame to be skipped.
MAGIC, SKIPPABLE = 0xFD2FB528, 0x184D2A50
#: Bytes read at a time, and lines per batch handed to Spark.
CHUNK, BATCH = 1 << 18, 4_096
ENDINGS = (".zst", ".zstd")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS or object store) and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def files_under(path: str) -> list[tuple[str, int]]:
    """Path and size of the file, or of all Zstandard files below the folder, but for hidden and pending ones."""
    store, root = filesystem(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(root) :].split("/") if part)
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.endswith(ENDINGS) and not hidden(i.path))


def header_size(head: bytes) -> int | None:
    """Bytes of a frame header, from its first six; None if it can't be one."""
    if len(head) < 6 or int.from_bytes(head[:4], "little") != MAGIC or head[4] & 0b1000:
        return None
    single, dictionary, content = head[4] >> 5 & 1, head[4] & 3, head[4] >> 6
    return 5 + (not single) + (0, 1, 2, 4)[dictionary] + (single, 2, 4, 8)[content]


def frame_end(source, start: int, size: int) -> int | None:
    """Where the frame at ``start`` ends, by its block headers alone; None if there is no whole frame there."""
    source.seek(start)
    head = source.read(14)
    if len(head) >= 8 and int.from_bytes(head[:4], "little") & ~0xF == SKIPPABLE:
        end = start + 8 + int.from_bytes(head[4:8], "little")
        return end if end <= size else None
    length = header_size(head)
    if length is None:
        return None
    at, last = start + length, False
    while not last:
        source.seek(at)
        block = int.from_bytes(three := source.read(3), "little")
        last, kind, held = block & 1, block >> 1 & 3, block >> 3
        if len(three) < 3 or kind == 3 or held > 1 << 17:
            return None
        at += 3 + (1 if kind == 1 else held)
    at += 4 if head[4] & 0b100 else 0
    return at if at <= size else None


def is_frame(source, start: int, size: int) -> bool:
    """Whether a whole frame begins at ``start`` and another one, or nothing, follows it."""
    end = frame_end(source, start, size)
    if end is None:
        return False
    source.seek(end)
    sign = int.from_bytes(source.read(4), "little")
    return end == size or sign == MAGIC or sign & ~0xF == SKIPPABLE


def first_frame(source, start: int, end: int, size: int) -> int | None:
    """The first frame that begins in [start, end)."""
    if start == 0:
        return 0 if size else None
    signs = [MAGIC.to_bytes(4, "little"), *[(SKIPPABLE + i).to_bytes(4, "little") for i in range(16)]]
    at = start
    while at < end:
        source.seek(at)
        held = source.read(min(CHUNK, end - at) + 3)
        places = set()
        for sign in signs:
            place = held.find(sign)
            while place >= 0:
                places.add(at + place)
                place = held.find(sign, place + 1)
        for place in sorted(p for p in places if p < end):
            if is_frame(source, place, size):
                return place
        at += CHUNK
    return None


def frames(source, start: int, size: int) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Each frame from ``start`` on: where it begins, and its text in pieces (to be used up before the next frame)."""
    import zstandard

    at = start
    while at < size:
        source.seek(at)
        head = source.read(8)
        if int.from_bytes(head[:4], "little") & ~0xF == SKIPPABLE:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        unzip, begun = zstandard.ZstdDecompressor().decompressobj(), at

        def pieces():
            nonlocal at
            source.seek(begun)
            while not unzip.eof:
                piece = source.read(CHUNK)
                if not piece:
                    raise EOFError(f"a frame at byte {begun} is cut off")
                at += len(piece)
                yield unzip.decompress(piece)
            at -= len(unzip.unused_data)

        yield begun, pieces()


def lines(source, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines that belong to the byte range [start, end) of a file."""
    first = first_frame(source, start, end, size)
    if first is None:
        return
    begun = first == 0  # else the line in which the first frame begins is the business of the range before
    rest: list[bytes] = []
    for place, pieces in frames(source, first, size):
        beyond = place >= end
        if beyond and not begun:
            return  # no line begins in this range
        for piece in pieces:
            if not begun:
                cut = piece.find(b"\n")
                if cut < 0:
                    continue
                piece, begun = piece[cut + 1 :], True
            if beyond:
                cut = piece.find(b"\n")
                if cut >= 0:
                    yield b"".join([*rest, piece[:cut]])
                    return
                rest.append(piece)
                continue
            whole = piece.split(b"\n")
            if len(whole) > 1:
                yield b"".join([*rest, whole[0]])
                yield from whole[1:-1]
                rest = []
            rest.append(whole[-1])
    if begun and (last := b"".join(rest)):
        yield last


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int
    size: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class LinesReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[FileRange]:
        ranges = [
            FileRange(name, at, min(at + self.split, size), size) for name, size in files_under(self.path) for at in range(0, size, self.split)
        ]
        return ranges or [FileRange("", 0, 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, _ = filesystem(self.path)
        held = []
        with store.open_input_file(partition.path) as source:
            for line in lines(source, partition.start, partition.end, partition.size):
                if line.strip():
                    held.append(line.decode("utf-8", "replace"))
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})
                    held = []
        yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})


class LinesWriter(DataSourceArrowWriter):
    """Each task writes files under ``_pending``; they move into the folder when all tasks are done."""

    def __init__(self, path: str, frame: int, overwrite: bool):
        self.path, self.frame, self.overwrite = path, frame, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import zstandard

        store, root = filesystem(self.path)
        store.create_dir(f"{root}/_pending", recursive=True)
        name = f"part-{uuid.uuid4().hex}.zst"
        waiting, held, any_rows = [], 0, False
        with store.open_output_stream(f"{root}/_pending/{name}", compression=None) as out:
            for batch in iterator:
                for value in batch.column(0).to_pylist():
                    if value is not None:
                        waiting.append(value.encode() + b"\n")
                        held += len(waiting[-1])
                        any_rows = True
                    if held >= self.frame:
                        out.write(zstandard.ZstdCompressor().compress(b"".join(waiting)))
                        waiting, held = [], 0
            if waiting:
                out.write(zstandard.ZstdCompressor().compress(b"".join(waiting)))
        return Written([name] if any_rows else [])

    def commit(self, messages: list) -> None:
        store, root = filesystem(self.path)
        if self.overwrite:
            for name, _ in files_under(self.path):
                store.delete_file(name)
        for message in messages:
            for name in message.files if message else ():
                store.move(f"{root}/_pending/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/_pending").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_pending")


class ZstdLines(DataSource):
    """Options: ``path``; ``splitBytes``, compressed bytes per partition; ``frameBytes``, text bytes per frame written."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"], int(self.options.get("frameBytes", 4 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    ship(spark)
    spark.dataSource.register(ZstdLines)
