"""Lines of many files in one scan, each with its byte offset: a Spark data source that reads splits of files.

A line's key is where its first byte stands, so every scan gives the same key, whatever the size of the splits and the
number of tasks, and a key found in one job finds its line in another. Spark's own text source tells neither the
offset nor, without a join, which of the listed entries a file belongs to; here both are known where the bytes are read.

All entries are looked up together when the scan is planned: plain paths in one request to their file system, folders
and patterns by listing. A split is a range of bytes; it owns the lines that begin in it. Small files share a split,
large ones are cut; compressed files are read whole, and their offsets count the uncompressed bytes.

A line ends at a line feed or a carriage return; of a pair of them the second ends a blank line. Blank lines are not
returned. A byte-order mark at the beginning of a file is skipped. Bytes are handed on as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glossmill.schemas import LINE
from glossmill.sources.answers import opened

SOURCE = "glossmill_lines"
SPLIT_BYTES = 64 << 20
OPEN_BYTES = 1 << 20  # what opening a file counts, when small ones are put together
READ_BYTES = 4 << 20
MARK = b"\xef\xbb\xbf"
CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
LINE_ARROW = pa.schema([
    ("source_idx", pa.int32()), ("source", pa.string()), ("hint", pa.string()), ("file", pa.string()), ("block", pa.int64()),
    ("seq", pa.int64()), ("value", pa.string()),
])


@dataclass(frozen=True)
class Found:
    """A file of an entry: where it is, its size, its number within the entry, and the bytes of the files before it."""

    entry: int
    name: str
    size: int
    number: int
    before: int


@dataclass
class Split(InputPartition):
    """Byte ranges (file, begin, end) that one task reads; a compressed file's range is -1, its whole."""

    ranges: list[tuple[Found, int, int]]


def visible(name: str) -> bool:
    return not name.rsplit("/", 1)[-1].startswith(("_", "."))


def in_order(name: str) -> str:
    """The name with the number of a part file filled up to ten digits: Spark writes five, and there may be more parts."""
    return re.sub(r"part-(\d+)([^/]*)$", lambda m: f"part-{m[1]:0>10}{m[2]}", name)


def listing(paths: list[str]) -> list[list[tuple[str, int]] | None]:
    """For each path its files and their sizes; None for one that does not exist.

    A plain path is a file or a folder, whose files are taken without its subfolders; a pattern has *, ? or [.
    """
    found: list[list[tuple[str, int]] | None] = [None] * len(paths)
    stores: dict[str, tuple[fs.FileSystem, list[int], list[str]]] = {}
    for i, path in enumerate(paths):
        store, inner = opened(path)
        key = path.split("://")[0] + "://" + path.split("://")[1].split("/")[0] if "://" in path else ""
        stores.setdefault(key, (store, [], []))[1].append(i)
        stores[key][2].append(inner.rstrip("/") or "/")
    for store, at, inner in stores.values():
        plain = [k for k, p in enumerate(inner) if not any(c in p for c in "*?[")]
        infos = dict(zip(plain, store.get_file_info([inner[k] for k in plain]))) if plain else {}
        folders: dict[str, list] = {}

        def inside(folder: str) -> list:
            if folder not in folders:
                folders[folder] = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            return folders[folder]

        for k, path in enumerate(inner):
            if k not in infos:
                head, _, last = path.rpartition("/")
                named = [f for f in inside(head or "/") if fnmatch(f.base_name, last) and visible(f.base_name)]
                files = [f for f in named if f.is_file]
                for folder in (f.path for f in named if f.type == fs.FileType.Directory):
                    files += [f for f in inside(folder) if f.is_file and visible(f.base_name)]
                if not files and not named:
                    continue
            elif infos[k].type == fs.FileType.NotFound:
                continue
            elif infos[k].is_file:
                files = [infos[k]]
            else:
                files = [f for f in inside(path) if f.is_file and visible(f.base_name)]
            found[at[k]] = sorted(((f.path, f.size) for f in files), key=lambda f: in_order(f[0]))
    return found


def codec(name: str) -> str | None:
    return next((c for end, c in CODECS.items() if name.endswith(end)), None)


def splits(entries: list[tuple[str, str]], split_bytes: int) -> list[Split]:
    """Ranges of all files in listed order, dealt into tasks of about ``split_bytes``."""
    out, held, size = [], [], 0
    for entry, files in enumerate(listing([path for path, _ in entries])):
        before = 0
        for number, (name, length) in enumerate(files or []):
            file = Found(entry, name, length, number, before)
            before += length
            cuts = [(0, -1)] if codec(name) else [(a, min(a + split_bytes, length)) for a in range(0, length, split_bytes)]
            for begin, end in cuts:
                held.append((file, begin, end))
                size += OPEN_BYTES + (length if end < 0 else end - begin)
                if size >= split_bytes:
                    out.append(Split(held))
                    held, size = [], 0
    return out + ([Split(held)] if held or not out else [])


def _ends_line(data: np.ndarray) -> np.ndarray:
    return (data == 10) | (data == 13)


def lines_in(read, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Lines that begin in [begin, end), as (place in the file, place in the bytes, bytes); end -1 is the file's.

    ``read(n)`` gives the next bytes, from ``begin - 1`` on unless begin is 0. A line is the bytes from its place up to
    the next line's, with the line end.
    """
    at = max(begin - 1, 0)  # place of the first held byte
    held = read(READ_BYTES)
    own = begin == 0  # does a line begin at the first held byte?
    while True:
        more = read(READ_BYTES)
        breaks = np.flatnonzero(_ends_line(np.frombuffer(held, np.uint8)))
        starts = np.concatenate(([0] if own else [], breaks + 1)).astype(np.int64)
        if end >= 0:
            past = np.flatnonzero(starts + at >= end)
            if past.size:  # the first line of the next split; ours end before it
                starts = starts[: past[0] + 1]
                if starts.size > 1:
                    yield starts[:-1] + at, starts, held
                return
        if not more:
            if starts.size and starts[-1] < len(held):
                starts = np.append(starts, len(held))
            if starts.size > 1:
                yield starts[:-1] + at, starts, held
            return
        if starts.size > 1:
            yield starts[:-1] + at, starts, held
        if starts.size:  # go on with the last line, which may be longer
            held, at, own = held[starts[-1] :] + more, at + int(starts[-1]), True
        else:
            held, at = more, at + len(held)


class LineReader(DataSourceReader):
    def __init__(self, entries: list[tuple[str, str]], split_bytes: int):
        self.entries, self.split_bytes = entries, split_bytes

    def partitions(self) -> list[Split]:
        return splits(self.entries, self.split_bytes)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        for file, begin, end in partition.ranges:
            path, hint = self.entries[file.entry]
            store, _ = opened(path)
            same = [pa.scalar(v, f.type) for v, f in zip((file.entry, path, hint, in_order(file.name), file.number), LINE_ARROW)]
            with store.open_input_stream(file.name, compression=codec(file.name)) if end < 0 else store.open_input_file(file.name) as data:
                if begin:
                    data.seek(begin - 1)
                for places, bounds, held in lines_in(data.read, begin, end):
                    yield from self._batches(same, file, places, bounds, held)

    def _batches(self, same, file, places, bounds, held):
        if places[0] == 0 and held.startswith(MARK, bounds[0]):
            bounds = np.concatenate((bounds[:1] + len(MARK), bounds[1:]))
        values = pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(held)])
        values = pc.ascii_rtrim(values, "\r\n")
        rows = [*(pa.repeat(v, len(places)) for v in same), pa.array(places + file.before), values]
        yield pa.RecordBatch.from_arrays(rows, schema=LINE_ARROW).filter(pc.greater(pc.binary_length(values), 0))


class LineSource(DataSource):
    """Options: ``entries``, a JSON list of [path, hint], and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self):
        return LINE

    def reader(self, schema) -> LineReader:
        entries = [tuple(e) for e in json.loads(self.options["entries"])]
        return LineReader(entries, int(self.options.get("splitBytes", SPLIT_BYTES)))


def scan_lines(spark: SparkSession, entries: Iterable[tuple[str, str]], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of all entries (path, hint) in listed order, with their key; an entry that does not exist has none.

    ``source_idx`` is the place of the entry, ``block`` that of the file within it, and ``seq`` the offset of the line
    in the entry's files laid end to end: one number that is unique in its source and ascends in the order of lines.
    """
    spark.dataSource.register(LineSource)
    listed = json.dumps([list(e) for e in entries])
    return spark.read.format(SOURCE).option("entries", listed).option("splitBytes", split_bytes).load()
