"""Workbooks as a data source: `spark.read.format("workbook").load(path)` gives (path, sheet, row, cells), with option
tables=true (path, sheet, name, ref).

A large workbook is one partition for each sheet; small ones are read several in a partition. Filters of
equality on path and sheet are pushed down, so that sheets they exclude are never opened. Rows are pulled from the sheet's
XML one at a time: a sheet of any size takes the memory of its shared strings.
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .xlsx import SharedStrings, book_sheets, book_tables, sheet_rows

#: Compressed bytes from which a workbook is read by sheets, and which small ones share a partition.
SPLIT_BYTES = 8 << 20
#: Rows of one batch that a reader emits.
BATCH = 4096

_CELLS = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
_TABLES = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("name", pa.string()), ("ref", pa.string())])


def file_system(uri: str):
    """(file system, path) of a URI that this machine's Arrow can open: local, s3, gs, hdfs."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class Books(InputPartition):
    """Files of one partition, and for a large one the sheet."""

    paths: tuple[str, ...]
    sheet: str | None = None


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, tables: bool, split_bytes: int):
        self.path, self.pattern, self.tables, self.split_bytes = path, pattern, tables, split_bytes
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in ("path", "sheet"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only[name] = self.only.get(name, values) & values

    def wanted(self, name: str, value: str) -> bool:
        return name not in self.only or value in self.only[name]

    def partitions(self) -> list[Books]:
        from pyarrow import fs

        system, root = file_system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        chosen = [
            f for f in files if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and self.wanted("path", f.path)
        ]
        out, held, size = [], [], 0
        for f in sorted(chosen, key=lambda f: f.path):
            if f.size >= self.split_bytes:
                with system.open_input_file(f.path) as data, opened(data, f.path) as book:
                    out += [Books((f.path,), name) for name, _ in book_sheets(book) if self.wanted("sheet", name)]
                continue
            if held and size + f.size > self.split_bytes:
                out.append(Books(tuple(held)))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return out + [Books(tuple(held))] * bool(held) or [Books(())]

    def read(self, partition: Books) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        schema = _TABLES if self.tables else _CELLS
        held: list[tuple] = []
        for path in partition.paths:
            with system.open_input_file(path) as data, opened(data, path) as book:
                for row in self.rows(book, path, partition.sheet):
                    held.append(row)
                    if len(held) == BATCH:
                        yield _batch(held, schema)
                        held = []
        if held:
            yield _batch(held, schema)

    def rows(self, book: zipfile.ZipFile, path: str, only: str | None) -> Iterator[tuple]:
        chosen = [(name, part) for name, part in book_sheets(book) if (only is None or name == only) and self.wanted("sheet", name)]
        shared = SharedStrings(book) if chosen and not self.tables else None
        for name, part in chosen:
            if self.tables:
                yield from ((path, *t) for t in book_tables(book, name, part))
            else:
                yield from ((path, name, at, cells) for at, cells in sheet_rows(book, part, shared))


def opened(data, path: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(data)
    except (zipfile.BadZipFile, pa.ArrowInvalid) as e:
        raise ValueError(f"{path} is no workbook: {e}") from e


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, sheet string, name string, ref string" if self.tables() else "path string, sheet string, row int, cells array<string>"

    def tables(self) -> bool:
        return self.options.get("tables", "false").lower() == "true"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(
            self.options["path"], self.options.get("pathGlobFilter", "*.xlsx"), self.tables(),
            int(self.options.get("splitBytes", SPLIT_BYTES))
        )


def read_workbooks(spark: SparkSession, path: str, *, tables: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All workbooks at or below a path; see the module. A file that is no workbook is an error; no file is no rows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").options(tables=tables, splitBytes=split_bytes).load(path)


def write_workbooks(books: DataFrame, folder: str) -> None:
    """Writes (path, content) as folder/path.xlsx: under another name first, so that a retried task leaves whole files only."""
    import pandas as pd

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                part = f"{root}/.{name}.{attempt}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{root}/{name}.xlsx")
            yield pd.DataFrame({"path": frame["path"]})

    books.select("path", "content").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
