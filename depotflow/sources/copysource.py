r"""COPY text as a Spark data source, also of a file that holds many blocks.

``spark.read.format("copytext")`` reads byte ranges of a file, cut at line ends, as Arrow batches. It reads the
columns of the schema it is given and tests pushed filters on their columns before it decodes the others.
A file may hold one table's rows, or the blocks of a dump: a ``COPY name (columns) FROM stdin;`` line, rows,
and ``\.``. The marks of the blocks are found by a job over all ranges; a block then is read like a file.

Paths are those that pyarrow's file systems know, or local ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from depotflow.functions.columns import LINE_PARTS, with_generated
from depotflow.schemas import MODEL
from depotflow.sources.copytext import END_OF_DATA, ESCAPES, NULL_FIELD

RANGE = 64 << 20  # bytes that a task reads
CHUNK = 8 << 20  # bytes that it holds at a time
_HEAD = re.compile(rb"COPY (?:\w+\.)?\"?(\w+)\"? \(([^)]*)\) FROM stdin;")
_CODED = re.compile(r"\\(?:([0-7]{1,3})|x([0-9a-fA-F]{1,2})|(.))", re.S)
_FOLDING = "spark.sql.python.filterPushdown.enabled"


@dataclass
class ByteRange(ds.InputPartition):
    """Lines that begin in [start, end) of a file; ``first`` is where lines begin at all."""

    path: str
    first: int
    start: int
    end: int


def _opened(path: str):
    """(file system, path in it)"""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """The files of a path, each with its size; hidden ones are left out."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner))
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else path[:path.index("://") + 3]
    return sorted((f"{prefix}{f.path}", f.size) for f in found
                  if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def ranges(options: dict[str, str]) -> list[ByteRange]:
    """The ranges of a path, or of a block of a file."""
    size = int(options.get("rangebytes", RANGE))
    out = []
    for path, length in _files(options["path"]):
        first, end = int(options.get("start", 0)), int(options.get("end", length))
        out += [ByteRange(path, first, at, min(at + size, end)) for at in range(first, end, size)]
    return out or [ByteRange("", 0, 0, 0)]


def lines(part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """Pieces of whole lines that begin in the range, with the place of each piece in the file."""
    system, inner = _opened(part.path)
    with system.open_input_file(inner) as file:
        at = part.start
        if at > part.first:  # the line that a range cuts belongs to the range before
            file.seek(at - 1)
            at -= 1
            while (chunk := file.read(CHUNK)) and b"\n" not in chunk:
                at += len(chunk)
            if not chunk:
                return
            at += chunk.index(b"\n") + 1
        while at < part.end:
            file.seek(at)
            chunk = file.read(min(CHUNK, part.end - at))
            if not chunk:
                return
            while not chunk.endswith(b"\n") and (more := file.read(1 << 16)):
                chunk += more[:more.index(b"\n") + 1] if b"\n" in more else more
            yield at, chunk
            at += len(chunk)


def _character(match: re.Match) -> str:
    octal, hexadecimal, other = match.groups()
    if octal or hexadecimal:
        return chr(int(octal, 8) & 255 if octal else int(hexadecimal, 16))
    return ESCAPES.get(f"\\{other}", other)


def _decoded(raw: pa.Array) -> pa.Array:
    r"""Fields as text: ``\N`` is NULL, escapes are decoded where there are any.

    Octal and hex escapes are bytes; those from 128 up are joined to characters as UTF-8.
    """
    raw = pc.if_else(pc.equal(raw, NULL_FIELD), pa.scalar(None, raw.type), raw)
    coded = pc.fill_null(pc.match_substring(raw, "\\"), False)
    if not pc.any(coded).as_py():
        return raw
    texts = raw.to_pylist()
    for i in pc.indices_nonzero(coded).to_pylist():
        if re.search(r"\\(?:[0-7]|x[0-9a-fA-F])", texts[i]):
            bytewise = texts[i].encode().decode("latin-1")
            texts[i] = _CODED.sub(_character, bytewise).encode("latin-1").decode(errors="replace")
        else:
            texts[i] = _CODED.sub(_character, texts[i])
    return pa.array(texts, pa.string())


def _typed(text: pa.Array, kind: pa.DataType) -> pa.Array:
    return pc.equal(text, "t") if pa.types.is_boolean(kind) else text.cast(kind)


_TESTS = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal,
          ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}


def _passes(test: ds.Filter, values: pa.Array) -> pa.Array:
    if isinstance(test, ds.IsNull):
        return pc.is_null(values)
    if isinstance(test, ds.IsNotNull):
        return pc.is_valid(values)
    if isinstance(test, ds.In):
        return pc.is_in(values, pa.array(test.value, values.type))
    return _TESTS[type(test)](values, pa.scalar(test.value, values.type))


class CopyTextReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema
        self.fields = options["columns"].split(",")
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Take the tests on single columns; the others stay with Spark."""
        for test in filters:
            simple = isinstance(test, (ds.IsNull, ds.IsNotNull, ds.In, *_TESTS)) and len(test.attribute) == 1
            if simple and test.attribute[0] in self.fields:
                self.filters.append(test)
            else:
                yield test

    def partitions(self) -> list[ByteRange]:
        return ranges(self.options)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        for _, piece in lines(partition) if partition.path else ():
            rows = pa.array(piece.decode().removesuffix("\n").split("\n"), pa.string())
            fields = pc.split_pattern(rows.filter(pc.not_equal(rows, END_OF_DATA)), "\t")

            def column(name: str, fields: pa.Array) -> pa.Array:
                return _typed(_decoded(pc.list_element(fields, self.fields.index(name))), kinds.field(name).type)

            for test in self.filters:
                keep = _passes(test, column(test.attribute[0], fields))
                fields = fields.filter(pc.fill_null(keep, False))
            yield pa.RecordBatch.from_arrays([column(name, fields) for name in kinds.names], schema=kinds)


class CopyTextSource(ds.DataSource):
    """Options: ``path``, ``columns`` (the fields of the rows, in order, by commas; by default those of ``table``),
    ``start`` and ``end`` of a block, ``rangebytes``. The schema is a choice of the fields, by default all of ``table``."""

    @classmethod
    def name(cls) -> str:
        return "copytext"

    def _stored(self) -> T.StructType:
        kept = {c.name for c in MODEL[self.options["table"]].stored}
        return T.StructType([f for f in MODEL[self.options["table"]].schema if f.name in kept])

    def schema(self) -> T.StructType:
        return self._stored()

    def reader(self, schema: T.StructType) -> CopyTextReader:
        options = dict(self.options)
        options.setdefault("columns", ",".join(self._stored().names) if "table" in options else ",".join(schema.names))
        return CopyTextReader(options, schema)


class CopyMarksReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[ByteRange]:
        return ranges(self.options)

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        for at, piece in lines(partition) if partition.path else ():
            for found in re.finditer(rb"^(?:COPY .*|\\\.\r?)$", piece, re.M):
                head = _HEAD.fullmatch(found[0])
                if head:
                    names = head[2].decode().replace('"', "").replace(" ", "")
                    yield partition.path, at + found.start(), at + found.end() + 1, head[1].decode(), names
                elif not found[0].startswith(b"COPY"):
                    yield partition.path, at + found.start(), at + found.end() + 1, None, None


class CopyMarksSource(ds.DataSource):
    """Where the blocks of a dump begin and end: a row for each ``COPY`` line and each end of data."""

    @classmethod
    def name(cls) -> str:
        return "copymarks"

    def schema(self) -> str:
        return "path string, at bigint, next bigint, table string, columns string"

    def reader(self, schema: T.StructType) -> CopyMarksReader:
        return CopyMarksReader(dict(self.options))


@dataclass(frozen=True)
class Block:
    path: str
    table: str
    columns: str
    start: int
    end: int


def registered(spark: SparkSession) -> SparkSession:
    """The session with both formats, and with filters passed on to them."""
    for source in (CopyTextSource, CopyMarksSource):
        spark.dataSource.register(source)
    spark.conf.set(_FOLDING, "true")
    return spark


def blocks(spark: SparkSession, path: str, **options: int) -> list[Block]:
    """The blocks of a dump, in order. A ``COPY`` line counts outside of blocks only: inside it is a row."""
    marks = registered(spark).read.format("copymarks").options(path=path, **options).load()
    out, open_mark = [], None
    for mark in marks.orderBy("path", "at").collect():  # two rows a table
        if open_mark is not None and mark.path != open_mark.path:
            open_mark = None
        if mark.table is None and open_mark is not None:
            out.append(Block(mark.path, open_mark.table, open_mark.columns, open_mark.next, mark.at))
            open_mark = None
        elif mark.table is not None and open_mark is None:
            open_mark = mark
    return out


def read_copy_block(spark: SparkSession, path: str, table: str, **options: int) -> DataFrame:
    """A table from its block in a dump; fields that the model does not have are not read, generated columns are computed."""
    block = next((b for b in blocks(spark, path, **options) if b.table == table), None)
    if block is None:
        raise KeyError(f"{path} has no block of {table}")
    fields = block.columns.split(",")
    schema = T.StructType([f for f in MODEL[table].schema if f.name in fields])
    rows = (spark.read.format("copytext").schema(schema)
            .options(path=block.path, columns=block.columns, start=block.start, end=block.end, **options).load())
    return with_generated(rows, table) if table in LINE_PARTS else rows.select(*MODEL[table].names)
