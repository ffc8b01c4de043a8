"""Heads of files as a data source: a range of bytes of each file of a listing, and the whole file only where that isn't enough.

    heads.register(spark)
    spark.read.format("file_heads").option("listing", folder_of_parquet_files).load()

Files are opened by their URI, so the listing may name any file system that Arrow can open. Partitions are stretches of
the listing, which only tasks read; filters on ``path`` are pushed down to it, so other files are not opened.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from framesift.storage import written

#: Bytes that hold the metadata of nearly all pictures.
HEAD_BYTES = 64 << 10
#: Files of one partition, and bytes of one batch, apart from a larger file.
PORTION, BATCH_BYTES = 1000, 16 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of a local path, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _listing_files(listing: str) -> tuple[fs.FileSystem, list[str]]:
    system, path = opened(listing)
    found = system.get_file_info(fs.FileSelector(path)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
    return system, sorted(f.path for f in found if fnmatchcase(f.base_name, "[!._]*.parquet"))


@dataclass
class Stretch(InputPartition):
    """Some rows of one row group of a file of the listing."""

    file: str
    group: int
    start: int


class FileHeads(DataSource):
    """Columns of the listing, ``head`` and ``error``. A file that can't be read has a null head and says why.

    Options: ``listing``, a Parquet table with a column ``path``; ``bytes``, how many to read (-1: all), and ``offset``,
    from where; ``enough``, ``module:function`` that says of the bytes read whether they are, else the rest is read, too.
    """

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def _listing(self) -> str:
        if "listing" not in self.options:
            raise ValueError("file_heads needs the option listing")
        return self.options["listing"]

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        system, files = _listing_files(self._listing())
        if not files:
            raise ValueError("the listing has no files")
        with system.open_input_file(files[0]) as f:
            return from_arrow_schema(pq.read_schema(f)).add("head", "binary").add("error", "string")

    def reader(self, schema: StructType) -> HeadsReader:
        return HeadsReader(self._listing(), int(self.options.get("bytes", HEAD_BYTES)), int(self.options.get("offset", 0)), self.options.get("enough"), schema)


class HeadsReader(DataSourceReader):
    """Reads the heads of the files of a listing."""

    def __init__(self, listing: str, n: int, offset: int, enough: str | None, schema: StructType):
        self.listing, self.n, self.offset, self.enough, self.columns = listing, n, offset, enough, schema.fieldNames()
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can say about the path, and leaves the rest to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.wanted.append((type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        system, files = _listing_files(self.listing)
        out = []
        for path in files:
            with system.open_input_file(path) as f:
                meta = pq.read_metadata(f)
            out += [Stretch(path, g, a) for g in range(meta.num_row_groups) for a in range(0, meta.row_group(g).num_rows, PORTION)]
        return out

    def _rows(self, part: Stretch) -> pa.Table:
        system, _ = opened(self.listing)
        with system.open_input_file(part.file) as f:
            rows = pq.ParquetFile(f).read_row_group(part.group, columns=self.columns[:-2]).slice(part.start, PORTION)
        path = rows.column("path")
        for kind, value in self.wanted:
            good = {"EqualTo": lambda: pc.equal(path, value), "In": lambda: pc.is_in(path, pa.array(list(value))), "StringStartsWith": lambda: pc.starts_with(path, value)}[kind]()
            rows = rows.filter(good)
            path = rows.column("path")
        return rows

    def _head(self, uri: str, enough: Callable[[bytes], bool] | None) -> bytes:
        system, path = opened(uri)
        with system.open_input_file(path) as f:
            if self.n < 0:
                return f.read_at(max(f.size() - self.offset, 0), self.offset)
            head = f.read_at(self.n, self.offset)
            if enough and len(head) == self.n and not enough(head):
                head += f.read_at(f.size() - self.offset - len(head), self.offset + len(head))
            return head

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        module, _, function = (self.enough or "").partition(":")
        enough = getattr(importlib.import_module(module), function) if function else None
        rows = self._rows(part)
        start, size, heads, errors = 0, 0, [], []

        def batch() -> list[pa.RecordBatch]:
            made = rows.slice(start, len(heads)).append_column("head", pa.array(heads, pa.binary())).append_column("error", pa.array(errors, pa.string()))
            return made.combine_chunks().to_batches()

        for i, uri in enumerate(rows.column("path").to_pylist()):
            head, error = None, None
            try:
                if uri is None:
                    raise OSError("no path")
                head = self._head(uri, enough)
            except (OSError, ValueError, pa.ArrowException) as e:
                error = str(e)
            heads.append(head)
            errors.append(error)
            size += len(head or b"")
            if size > BATCH_BYTES:
                yield from batch()
                start, size, heads, errors = i + 1, 0, [], []
        if heads:
            yield from batch()


def register(spark: SparkSession) -> None:
    """Make ``file_heads`` known, and let filters be pushed down to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileHeads)


def heads(files: DataFrame, n: int = HEAD_BYTES, keep: tuple[str, ...] = ("path",), enough: Callable[[bytes], bool] | None = None) -> DataFrame:
    """``keep``, ``head`` and ``error`` for files with a ``path``: the listing is written, and read by the data source.

    A file that can't be read has a null head and says why; the others go on. A file shorter than ``n`` bytes is
    whole in its head, and so is one whose first bytes are not ``enough``, if that is given (a function of a module).
    """
    spark = files.sparkSession
    register(spark)
    source = spark.read.format("file_heads").option("listing", written(files.select(*dict.fromkeys((*keep, "path"))))).option("bytes", n)
    if enough:
        source = source.option("enough", f"{enough.__module__}:{enough.__name__}")
    return source.load().select(*keep, "head", "error")
