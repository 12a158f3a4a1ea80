"""Token ids as Arrow files of equal-length sequences with masks, and their readers.

Documents are sorted by id over range partitions. Each partition is one Arrow file
(``part-00007.arrow``) in the folder: record batches with two fixed-size-list columns,
``ids`` (unsigned 16 or 32 bits) and ``mask`` (true for a token, false for the padding of a
part's last sequence), so sequence ``i`` of a batch is a view into the mapped file. Beside it,
``part-00007.index.arrow`` has a row per document: id, first token in the part, number of tokens.

Tasks write under a name of their own and rename when whole, so a repeated task does no harm.
Files are reached through ``pyarrow.fs`` by the folder's URI: a local or mounted folder, or a
store that pyarrow knows.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotflow.llm.text import NOT_SPACE, encode, gather, slices, text_bytes, word_bounds
from depotflow.session import fresh_path

SEQUENCE = 2048  # ids in a sequence
BATCH = 256  # sequences in a record batch
CACHED = 500_000  # distinct units a task keeps
PART_BYTES = 32 << 20  # text that one part holds, about


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/+", uri):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


# Kinds of bytes. A word (between white space) of ASCII letters, digits and signs and of Latin-1
# letters is cut into units: runs of letters, single digits, runs of signs. A word with any
# other character, an apostrophe (contractions) or "<" (special tokens) is one unit.
LETTER, DIGIT, SIGN, OTHER = 1, 2, 3, 4
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
KIND[[0x27, 0x3C]] = OTHER
KIND[~NOT_SPACE] = 0


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of all texts, and the bytes with plain units in lower case."""
    kind = KIND[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = LETTER
    first, last, _ = word_bounds(data, offsets, NOT_SPACE)
    others = np.concatenate(([0], np.cumsum(kind == OTHER)))
    plain = others[last] == others[first]
    step = np.zeros(len(data) + 1, np.int8)
    step[first[plain]] += 1
    step[last[plain]] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    begin = np.zeros(len(data), bool)
    begin[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    begin[first] = True
    starts = np.flatnonzero(begin)
    word = np.searchsorted(first, starts, side="right") - 1
    ends = np.minimum(np.r_[starts[1:], len(data)], last[word])
    capital = inside & (data >= 0x41) & (data <= 0x5A)
    capital[lead + 1] |= inside[lead] & (data[lead + 1] < 0x9F)
    return starts, ends, data + capital.view(np.uint8) * np.uint8(0x20)


class WordCoder:
    """Ids of texts by the tokenizers library, where each distinct unit of a task is encoded once.

    The tokenizer must drop white space, map letters to lower case, and split runs of letters,
    single digits and runs of other signs; this is tried when it is loaded. A plain
    unit then goes straight to the library's merge model; words with other
    characters go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
               or not t["content"].startswith("<") for t in spec["added_tokens"]):
            raise ValueError("a special token reaches over white space; not supported")
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        sign = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(0x21, 0x7F)}
        for b in range(0x80, 0xC0):
            sign[0xC3], sign[b] = level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0]
        self.letters = str.maketrans({chr(b): c for b, c in sign.items()})
        letter = rb"(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+"
        self.plain = re.compile(letter + rb"|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
        self.known: dict[bytes, int] = {}
        self.flat, self.firsts = np.zeros(0, self.type), np.zeros(1, np.int64)
        probe = "One  two,3,45(ÉtÉ)\n\tx--y.THE!! ß"
        ids, _ = self.texts(pa.array([probe]), None)
        if self.tokenizer.encode(probe, add_special_tokens=False).ids != ids.tolist():
            raise ValueError("the tokenizer splits in another way; not supported")

    def learn(self, values: list[bytes]) -> None:
        missing = [v for v in values if v not in self.known]
        if len(self.known) + len(missing) > CACHED:
            self.known, missing = {}, values
            self.flat, self.firsts = np.zeros(0, self.type), np.zeros(1, np.int64)
        ids, lengths, merge = [], [], self.tokenizer.model.tokenize
        for value in missing:
            if self.plain.fullmatch(value):
                own = [t.id for t in merge(value.decode("latin-1").translate(self.letters))]
            else:
                own = self.tokenizer.encode(value.decode(), add_special_tokens=False).ids
            ids += own
            lengths.append(len(own))
        known = len(self.known)
        self.known.update(zip(missing, range(known, known + len(missing)), strict=True))
        self.flat = np.concatenate((self.flat, np.array(ids, self.type)))
        self.firsts = np.concatenate((self.firsts, self.firsts[-1] + np.cumsum(lengths, dtype=np.int64)))

    def texts(self, column: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end`` after each, and the number of ids of each."""
        data, offsets = text_bytes(column)
        starts, ends, data = units(data, offsets)
        rows = np.searchsorted(starts, offsets)
        codes, distinct = encode(data, starts, ends)
        values = distinct.to_pylist()
        self.learn(values)
        at = np.fromiter(map(self.known.__getitem__, values), np.int64, len(values))
        firsts = np.append(self.firsts[at], len(self.flat))
        lengths = np.append(self.firsts[at + 1] - self.firsts[at], end is not None)
        flat = np.append(self.flat, self.type(end or 0))
        codes = np.insert(codes.astype(np.int64), rows[1:], len(values))
        lengths_of = lengths[codes]
        ids = flat[gather(firsts[codes], lengths_of)]
        sums = np.concatenate(([0], np.cumsum(lengths_of)))
        return ids, np.diff(sums[rows + np.arange(len(rows))])


def _sequences(chunks: Iterator[np.ndarray], kind: pa.DataType,
               length: int) -> Iterator[pa.RecordBatch]:
    """Record batches of whole sequences; the last one is padded with 0 and masked."""
    size = length * BATCH
    held, n = [], 0
    for chunk in chunks:
        held.append(chunk)
        n += len(chunk)
        while n >= size:
            flat = np.concatenate(held)
            yield _batch(flat[:size], size, kind, length)
            held, n = [flat[size:]], n - size
    if n:
        flat = np.concatenate(held)
        yield _batch(flat, -(-n // length) * length, kind, length)


def _batch(ids: np.ndarray, total: int, kind: pa.DataType, length: int) -> pa.RecordBatch:
    values, mask = np.zeros(total, ids.dtype), np.zeros(total, bool)
    values[:len(ids)], mask[:len(ids)] = ids, True
    return pa.RecordBatch.from_arrays(
        [pa.FixedSizeListArray.from_arrays(pa.array(values, kind), length),
         pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], names=["ids", "mask"])


def write(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1,
          length: int = SEQUENCE, id_column: str = "doc_id", text_column: str = "text",
          parts: int | None = None) -> DataFrame:
    """Write all documents in ascending id order; returns a written manifest, a row per part.

    A null text counts as empty and has only the end id. Rows may repeat: equal ids are
    ordered by their text, and a null id comes first. An empty table writes no part.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-size // PART_BYTES))
    key_type = rows.schema["doc_id"].dataType
    ordered = (rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
               .withColumn("part", F.spark_partition_id()))

    def work(batches):
        coder = WordCoder(tokenizer)
        kind = pa.from_numpy_dtype(coder.type)
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        index = []

        def chunks():
            at = 0
            for batch in itertools.chain([held], batches):
                for piece in slices(batch, "text"):
                    ids, counts = coder.texts(piece["text"], end)
                    starts = at + np.cumsum(counts) - counts
                    index.append((piece["doc_id"], starts, counts))
                    at += int(counts.sum())
                    yield ids

        batches = iter(batches)
        held = next((b for b in batches if b.num_rows), None)
        if held is None:
            return

        part = held["part"][0].as_py()
        name, own = f"{root}/part-{part:05d}", uuid.uuid4().hex
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        with files.open_output_stream(f"{name}.{own}") as out, pa.ipc.new_file(out, schema) as writer:
            for made in _sequences(chunks(), kind, length):
                writer.write_batch(pa.RecordBatch.from_arrays(made.columns, schema=schema))
        table = pa.table({"doc_id": pa.chunked_array([i[0] for i in index]),
                          "first": np.concatenate([i[1] for i in index]),
                          "n_tokens": np.concatenate([i[2] for i in index])})
        with files.open_output_stream(f"{name}.index.{own}") as out, \
                pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)
        files.move(f"{name}.index.{own}", f"{name}.index.arrow")
        files.move(f"{name}.{own}", f"{name}.arrow")
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([len(table)], pa.int64()),
             pa.array([int(np.sum(table["n_tokens"].to_numpy()))], pa.int64())],
            names=["part", "n_docs", "n_tokens"])

    manifest = ordered.mapInArrow(work, "part int, n_docs long, n_tokens long")
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return docs.sparkSession.read.schema("part int, n_docs long, n_tokens long").parquet(path)


class PartReader:
    """Random access to a part: sequences and masks as views, documents by place."""

    def __init__(self, folder: str, part: int):
        files, root = filesystem(folder)
        name = f"{root}/part-{part:05d}"
        self.index = pa.ipc.open_file(files.open_input_file(f"{name}.index.arrow")).read_all()
        source = pa.memory_map(f"{name}.arrow") if isinstance(files, pafs.LocalFileSystem) \
            else files.open_input_file(f"{name}.arrow")
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _flat(self, batch: int) -> np.ndarray:
        if self.last[0] != batch:
            values = self.file.get_batch(batch).column(0).flatten()
            self.last = (batch, values.to_numpy(zero_copy_only=True))
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ``i`` of the part and its mask."""
        batch = self.file.get_batch(i // BATCH)
        at = i % BATCH
        return (batch.column(0)[at].values.to_numpy(zero_copy_only=True),
                batch.column(1)[at].values.to_numpy(zero_copy_only=False))

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from place ``first`` of the part on."""
        size, out = self.length * BATCH, []
        while count > 0:
            flat = self._flat(first // size)
            piece = flat[first % size:first % size + count]
            out.append(piece)
            first, count = first + len(piece), count - len(piece)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Read the files back: a row per document with its place among all ids and a checksum."""
    total = sorted((r.part, r.n_tokens) for r in manifest.collect())  # a row per file
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    if not total:
        return spark.createDataFrame([], schema)
    before = dict(zip([p for p, _ in total], np.cumsum([0] + [n for _, n in total[:-1]]).tolist(),
                      strict=True))
    parts = spark.createDataFrame(list(before.items()), "part int, before long")

    def work(batches):
        for batch in batches:
            for part, base in zip(batch["part"].to_pylist(), batch["before"].to_pylist(), strict=True):
                reader = PartReader(folder, part)
                for rows in reader.index.to_batches(max_chunksize=10_000):
                    first, counts = rows["first"].to_numpy(), rows["n_tokens"].to_numpy()
                    sums = [zlib.crc32(reader.ids(a, n).astype("<u4"))
                            for a, n in zip(first.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [rows["doc_id"], pa.array(first + base), pa.array(counts),
                         pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.repartition(len(total), "part").mapInArrow(work, schema)


def token_files(docs: DataFrame, tokenizer: str, end: int | None = 1,
                length: int = SEQUENCE) -> DataFrame:
    """Write the documents to a new folder of the session's shared folder and read them back."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-files")
    manifest = write(docs, folder, tokenizer, end, length)
    return read(spark, folder, manifest, docs.schema["doc_id"].dataType.simpleString())
