"""Tables as a log of changes, switched together.

A table is a base folder and, after it, folders with change sets: inserted, updated and deleted
rows. A commit writes the rows that change, nothing else, and then names the folders of all tables in one
manifest. Readers follow the newest manifest, so they see all changes of a commit or none, and a
job never overwrites what it reads. A reader takes of each key its newest row.

Manifests are numbered. A writer prepares one under a name of its own and gives it the next
number by a step that fails if the number is taken: a hard link on a local or mounted
file system, a rename that does not overwrite elsewhere. So of two writers that read the same version
one is refused and changes nothing. A lost executor, a lost writer or a refused one leaves
folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from depotflow.operators.changes import FLAG, applied, newest
from depotflow.schemas import MODEL

VERSION = "changed_in"  # column of stored change sets: the version that made them
COMPACT_AFTER = 16  # change sets of a table that a reader merges at most


class CommitRefused(RuntimeError):
    """Another writer has committed since this one read the tables."""


def scan_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table, read with its declared schema."""
    return spark.read.schema(MODEL[table].schema).parquet(path)


@dataclass(frozen=True)
class Kept:
    """A table that is kept besides those of the model."""

    schema: StructType
    key: tuple[str, ...]


@dataclass
class _Manifest:
    version: int = 0
    base: dict[str, str] = field(default_factory=dict)
    changes: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class _Folder:
    """Small files of a shared folder, through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._gateway = spark.sparkContext._gateway
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self._path(path)
        self._fs = self.path.getFileSystem(self._conf)
        self.links = self._fs.getUri().getScheme() == "file"

    def _path(self, *parts):
        return self._jvm.org.apache.hadoop.fs.Path(*parts)

    def names(self) -> list[str]:
        if not self._fs.exists(self.path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path, name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Make the file, whole, unless there is one of that name; whether it was made."""
        draft = self._path(self.path, f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(self.path, name)
        try:
            if self.links:
                paths = [self._jvm.java.nio.file.Paths.get(p.toUri().getPath(), self._array(self._jvm.java.lang.String, 0))
                         for p in (target, draft)]
                self._jvm.java.nio.file.Files.createLink(*paths)
                self._fs.delete(draft, False)
            else:
                option = self._jvm.org.apache.hadoop.fs.Options.Rename
                without = self._array(option, 1)
                without[0] = option.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                    self.path.toUri(), self._conf).rename(draft, target, without)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in error.java_exception.toString():
                return False
            raise
        return True

    def _array(self, kind, size: int):
        return self._gateway.new_array(kind, size)


class SnapshotStore:
    """A warehouse kept under one shared folder."""

    def __init__(self, spark: SparkSession, root: str, more: Mapping[str, Kept] | None = None,
                 compact_after: int = COMPACT_AFTER) -> None:
        self.spark = spark
        self.root = root
        self._more = dict(more or {})
        self._compact_after = compact_after
        self._manifests = _Folder(spark, f"{root}/_manifest")

    def kept(self, table: str) -> Kept:
        """Schema and key of a table."""
        return self._more.get(table) or Kept(MODEL[table].schema, tuple(MODEL[table].key))

    def _current(self) -> _Manifest:
        named = [n for n in self._manifests.names() if n.startswith("v")]
        return _Manifest(**json.loads(self._manifests.read(named[-1]))) if named else _Manifest()

    def tables(self) -> StoredTables:
        """The tables of the newest commit; later commits do not show in them."""
        return StoredTables(self, self._current())

    def last_batch(self, stream: str) -> int:
        """The last batch of the stream that was committed, -1 before the first."""
        return self._current().batches.get(stream, -1)

    def commit(self, whole: Mapping[str, DataFrame] | None = None, *,
               changes: Mapping[str, DataFrame] | None = None, stream: str | None = None,
               batch_id: int | None = None, since: StoredTables | None = None) -> int:
        """Write whole tables and change sets and make them current; returns the new version.

        ``since`` are the tables that the changes were made from: if another writer has committed
        after them, or does so before this commit is done, it is refused and changes nothing. A batch is
        committed with the stream that it belongs to.
        """
        if (stream is None) != (batch_id is None):
            raise ValueError("a batch is committed with its stream, a stream with its batch")
        now = self._current()
        if since is not None and since.version != now.version:
            raise CommitRefused(f"version {now.version} was committed after version {since.version} was read")
        version = now.version + 1
        for table, rows in (whole or {}).items():
            now.base[table] = self._written(rows.select(*self.kept(table).schema.names), table, version)
            now.changes[table] = []
        for table, rows in (changes or {}).items():
            rows = rows.select(*self.kept(table).schema.names, FLAG, F.lit(version).cast("bigint").alias(VERSION))
            now.changes[table] = now.changes.get(table, []) + [self._written(rows, table, version)]
        for table, folders in now.changes.items():
            if len(folders) > self._compact_after:
                self._compact(now, table, version)
        if stream is not None:
            now.batches[stream] = batch_id
        now.version = version
        if not self._manifests.claim(f"v{version:012d}", json.dumps(now.__dict__)):
            raise CommitRefused(f"another writer has committed version {version}")
        return version

    def compact(self, table: str) -> int:
        """Write a table anew without its change sets, which readers then need not merge."""
        now = self._current()
        now.version += 1
        self._compact(now, table, now.version)
        if not self._manifests.claim(f"v{now.version:012d}", json.dumps(now.__dict__)):
            raise CommitRefused(f"another writer has committed version {now.version}")
        return now.version

    def _compact(self, manifest: _Manifest, table: str, version: int) -> None:
        manifest.base[table] = self._written(StoredTables(self, manifest)[table], table, version)
        manifest.changes[table] = []

    def _written(self, rows: DataFrame, table: str, version: int) -> str:
        path = f"{self.root}/{table}/v{version}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path


class StoredTables(Mapping[str, DataFrame]):
    """The tables of one version."""

    def __init__(self, store: SnapshotStore, manifest: _Manifest) -> None:
        self._store, self.version = store, manifest.version
        self._base, self._changes = dict(manifest.base), {t: list(c) for t, c in manifest.changes.items()}

    def __getitem__(self, table: str) -> DataFrame:
        kept, read = self._store.kept(table), self._store.spark.read
        if table not in self._base and table not in self._changes:
            raise KeyError(table)
        base = (read.schema(kept.schema).parquet(self._base[table]) if table in self._base
                else self._store.spark.createDataFrame([], kept.schema))
        folders = self._changes.get(table)
        if not folders:
            return base
        stored = StructType([*kept.schema.fields, StructField(FLAG, StringType()), StructField(VERSION, LongType())])
        return applied(base, newest(read.schema(stored).parquet(*folders), kept.key, VERSION), kept.key)

    def __iter__(self) -> Iterator[str]:
        return iter({*self._base, *self._changes})

    def __len__(self) -> int:
        return len({*self._base, *self._changes})
