"""Image folders as bronze rows: a parallel walk, then header reads in Arrow batches.

``read_images`` looks for folders on the driver, in the first levels only, and lists files
in tasks: of each of those levels' folders its own, and the subtrees beneath them.  The
paths are then dealt out for reading.  So no listing is ever in one place but that of
one folder's own files, which one task streams.
``spark.read.format("imageheaders")`` is the same behind a data source, which cannot deal
paths anew: each folder or subtree is given to ``slices`` partitions, and each of these
lists it and reads the files whose names hash to its own number.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import BRONZE
from . import fields
from .headers import EXTENSIONS, UNSUPPORTED, HeaderError, read_tags

#: Fixed: folders that hold no photographs of their owner.
SKIPPED = {".git", ".svn", ".hg", "__pycache__", ".cache", "@eaDir", ".Trashes", "$RECYCLE.BIN", "Thumbs", ".thumbnails"}
#: Folders at which the walk goes over to tasks.
FOLDERS = 64
COLUMNS = [x.split(" ")[0] for x in BRONZE.split(", ")]


def extension(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def subfolders(folder: str) -> list[str]:
    """The folders in a folder that a walk goes into."""
    out = []
    try:
        with os.scandir(folder) as found:
            out = [e.path for e in found if not e.name.startswith(".") and e.name not in SKIPPED and e.is_dir(follow_symlinks=False)]
    except OSError:
        pass
    return sorted(out)


def roots(root: str, folders: int) -> tuple[list[str], list[str]]:
    """Folders whose own files are to be listed, and subtrees that are to be walked, ``folders`` or a few more in all."""
    flat, trees = [], [root]
    while trees and len(trees) + len(flat) < folders:
        flat.append(trees.pop(0))
        trees += subfolders(flat[-1])
    return flat, trees


def listed(folder: str, wanted: frozenset[str]) -> tuple[list[str], list[str]]:
    """Wanted files and subfolders of a folder; no hidden names, no links, no error for what cannot be read."""
    files, folders = [], []
    try:
        with os.scandir(folder) as found:
            for e in found:
                if e.name.startswith("."):
                    continue
                try:
                    mode = e.stat(follow_symlinks=False).st_mode
                except OSError:
                    continue
                if stat.S_ISDIR(mode):
                    if e.name not in SKIPPED:
                        folders.append(e.path)
                elif stat.S_ISREG(mode) and extension(e.name) in wanted:
                    files.append(e.path)
    except OSError:
        pass
    return sorted(files), sorted(folders)


def walk(root: str, extensions=None) -> Iterator[str]:
    """The wanted files under a folder, depth first; lazily."""
    wanted, todo = frozenset(extensions or EXTENSIONS), [root]
    while todo:
        files, folders = listed(todo.pop(), wanted)
        yield from files
        todo += reversed(folders)


def read_file(path: str) -> dict:
    """The bronze row of one file; whatever is wrong with it becomes its status and detail."""
    row = dict.fromkeys(COLUMNS) | {"path": path, "bytes_read": 0, "container": "unknown"}
    ext = extension(path)
    if ext in UNSUPPORTED:
        return row | {"status": "unsupported", "container": ext[1:], "detail": "this container is not read"}
    try:
        with open(path, "rb", buffering=0) as f:
            tags, container, used = read_tags(f, os.fstat(f.fileno()).st_size, ext)
        row |= {"container": container, "bytes_read": used}
        photo = fields.photograph(tags)
    except HeaderError as e:
        return row | {"status": "unsupported" if e.unsupported else "no-exif", "container": e.container, "bytes_read": e.used, "detail": str(e)}
    except Exception as e:  # noqa: BLE001  a file must not end the scan
        return row | {"status": "unreadable", "detail": f"{type(e).__name__}: {e}"}
    if photo["taken"] is None and photo["camera"] is None and photo["focal"] is None:
        return row | {"status": "no-exif", "detail": "EXIF without time, camera and focal length"}
    return row | photo | {"status": "ok"}


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
ARROW = pa.schema([(n, _KINDS[t]) for n, t in (x.split(" ") for x in BRONZE.split(", "))])


def batches(paths: Iterator[str], size: int = 500) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for p in paths:
        rows.append(read_file(p))
        if len(rows) == size:
            yield pa.RecordBatch.from_pylist(rows, ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ARROW)


def read_images(spark: SparkSession, root: str, extensions=None, folders: int = FOLDERS, tasks: int | None = None) -> DataFrame:
    """Bronze rows of all images under ``root`` (a folder that executors can see)."""
    wanted = frozenset(extensions or EXTENSIONS)
    flat, trees = roots(root, folders)
    found = spark.createDataFrame([(p, False) for p in flat] + [(p, True) for p in trees], "path string, tree boolean").repartition(len(flat) + len(trees))

    def expand(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path, tree in zip(b.column("path").to_pylist(), b.column("tree").to_pylist()):
                own: list[str] = []
                for p in walk(path, wanted) if tree else listed(path, wanted)[0]:
                    own.append(p)
                    if len(own) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(own)], ["path"])
                        own = []
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(own)], ["path"])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(p for b in parts for p in b.column("path").to_pylist())

    # A folder may hold most of the files, so paths (not folders) are dealt out for reading.
    paths = found.mapInArrow(expand, "path string").repartition(tasks or max(8, spark.sparkContext.defaultParallelism * 2))
    return paths.mapInArrow(read, BRONZE)


class _Slice(InputPartition):
    def __init__(self, folder: str, tree: bool, number: int, of: int):
        self.folder, self.tree, self.number, self.of = folder, tree, number, of


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.slices, self.folders = options["path"], int(options.get("slices", 4)), int(options.get("folders", FOLDERS))
        self.wanted = frozenset([x.strip() for x in options["extensions"].split(",")] if options.get("extensions") else EXTENSIONS)

    def partitions(self) -> list[_Slice]:
        flat, trees = roots(self.root, self.folders)
        return [_Slice(p, tree, i, self.slices) for places, tree in ((flat, False), (trees, True)) for p in places for i in range(self.slices)]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        paths = walk(part.folder, self.wanted) if part.tree else iter(listed(part.folder, self.wanted)[0])
        yield from batches(p for p in paths if zlib.crc32(os.fsencode(p)) % part.of == part.number)


class ImageHeaders(DataSource):
    """``spark.read.format("imageheaders").load(folder)``; options: extensions, slices, folders."""

    @classmethod
    def name(cls) -> str:
        return "imageheaders"

    def schema(self) -> str:
        return BRONZE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageHeaders)
