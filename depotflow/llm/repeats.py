"""Removal of long repeated byte strings by threshold-bounded interval expansion.

A byte goes if it lies in a string of ``LENGTH`` bytes that starts anywhere else too. Windows of
that length are dealt so that equal ones meet: a window's key is its least k-gram by hash (the
leftmost of equal ones), and the windows of a document that share one occurrence of a k-gram
form a segment, so every window is in exactly one segment.

1. Blocks of documents tell buckets their segments, each distinct one once (see ``blocks``).
   A k-gram seen once has no repeated window; a segment seen twice has only repeated ones.
2. Only segments that are unique but share their k-gram with others go on, with one copy of each of
   the others. A bucket joins them to a text, makes its Burrows-Wheeler transform from the suffix order
   by as many bytes as the threshold needs, and finds the places where neighbours in that order
   have a common prefix below the threshold: intervals are extended backwards breadth-first, so
   places come by increasing length, and the search stops at the threshold. Windows
   between two such places are repeated.
3. A k-gram with more than ``MOST_SEGMENTS`` different segments (a passage in very many contexts) does
   not go to one bucket: its windows are dealt by a hash of their own bytes and counted.
4. Blocks join the windows found to runs of bytes and drop them.

All windows are judged on the input. Matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.llm.blocks import (NOTHING, SAID, answered, blocked, bucket_of, dealt, heard, rows_of, say,
                                  unpacked)
from depotflow.llm.text import MIX, gather, mix, text_bytes

LENGTH = 200
#: Bytes of a k-gram, at the length of 200: longer ones are rarer by chance, but there are more of them.
GRAM_SHARE = 0.48
MOST_SEGMENTS = 4096
CHUNK = 1 << 18  # window starts that one numpy step works on
TEXT_AT_ONCE = 1 << 18  # bytes of segments that share a transform, about

SENT = "bucket int, block int, keys binary, lengths binary, text binary"
FOUND = "block int, level int, bucket int, values binary, summary binary"
#: Levels of answers: kinds of segments, windows of sent segments, windows of crowded k-grams.
KINDS, WINDOWS, CROWD = 0, 1, 2
ALL, SENDS, CROWDED = 1, 2, 4


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = int(MIX)
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values: prefix and suffix minima of pieces of that width."""
    n = len(values) - width + 1
    pad = -len(values) % width
    filled = np.append(values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(filled, axis=1).ravel()
    back = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First and last window start and k-gram key of every segment, in order."""
    gram = max(1, int(length * GRAM_SHARE))
    width = length - gram + 1
    valid_all = np.zeros(len(data) + 1, np.int8)
    long = np.diff(offsets) >= length
    np.add.at(valid_all, offsets[:-1][long], 1)
    np.add.at(valid_all, offsets[1:][long] - length + 1, -1)
    valid_all = np.cumsum(valid_all[:-1], dtype=np.int8).view(bool)
    size = min(CHUNK, len(data))
    up, down = _powers(size + length + 1)
    out = []
    for begin in range(0, len(data) - length + 1, CHUNK):
        stop = min(begin + CHUNK, len(data) - length + 1)
        valid = valid_all[begin:stop]
        if not valid.any():
            continue
        part = data[begin:stop + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=sums[1:])
        hashes = mix((sums[gram:] - sums[:-gram]) * down[:len(part) - gram + 1])
        packed = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_minimum(packed, width) & np.uint64(0xFFFFFF)).astype(np.int64)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        first = np.flatnonzero(new)
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | new[1:]
        # Least hashes are small numbers; mixed once more, the keys fill the buckets evenly.
        out.append((first + begin, np.flatnonzero(ends) + begin, mix(hashes[place[first]] * MIX)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Block:
    """Segments of a block's documents; distinct ones (k-gram and content) by number."""

    def __init__(self, table: pa.Table, length: int):
        table = unpacked(table)
        self.table, self.length = table, length
        self.data, self.offsets = text_bytes(table["text"])
        self.first, self.last, gram = segments(self.data, self.offsets, length)
        view, digest = memoryview(np.ascontiguousarray(self.data)), xxhash.xxh3_64_intdigest
        content = np.fromiter(
            (digest(view[a:b]) for a, b in zip(self.first.tolist(), (self.last + length).tolist(),
                                               strict=True)), np.uint64, len(self.first))
        order = np.lexsort((content, gram))
        gram, content = gram[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.gram, self.content = gram[new], content[new]
        self.example = order[new]  # an occurrence of each distinct segment

    def kinds(self, n: int, block: int) -> pa.RecordBatch:
        times = np.minimum(np.bincount(self.number, minlength=len(self.gram)), 2)
        values = np.empty((len(self.gram), 9), np.uint8)
        values[:, :8] = self.content.view(np.uint8).reshape(-1, 8)
        values[:, 8] = times
        return say(block, KINDS, self.gram, values, n)

    def load(self, answers: pa.Table) -> None:
        self.kind = heard(answers, KINDS, np.uint8)
        self.sent = np.flatnonzero((self.kind & SENDS > 0) & (self.kind & CROWDED == 0))
        self.crowded = np.flatnonzero((self.kind & CROWDED > 0) & (self.kind & ALL == 0)
                                      | (self.kind & CROWDED > 0) & (self.kind & SENDS > 0))

    def windows(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts of the examples of some distinct segments, and their counts."""
        at = self.example[numbers]
        counts = self.last[at] - self.first[at] + 1
        return gather(self.first[at], counts), counts

    def send(self, n: int, block: int) -> pa.Table:
        """The text of segments that a transform must judge, a row per bucket."""
        at = self.example[self.sent]
        lengths = self.last[at] - self.first[at] + self.length
        edges = np.searchsorted(bucket_of(self.gram[self.sent], n), np.arange(n + 1)).tolist()
        rows = {"bucket": [], "block": [], "keys": [], "lengths": [], "text": []}
        for bucket, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a == b:
                continue
            rows["bucket"].append(bucket), rows["block"].append(block)
            rows["keys"].append(self.gram[self.sent[a:b]].tobytes())
            rows["lengths"].append(lengths[a:b].astype(np.int32).tobytes())
            rows["text"].append(self.data[gather(self.first[at[a:b]], lengths[a:b])].tobytes())
        return pa.table(rows, schema=pa.schema(
            [("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()),
             ("lengths", pa.binary()), ("text", pa.binary())]))

    def crowd(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of crowded k-grams by hash, the number of each window, and how often
        each is held; a segment seen twice counts its windows twice."""
        starts, counts = self.windows(self.crowded)
        view, digest, size = memoryview(np.ascontiguousarray(self.data)), xxhash.xxh3_64_intdigest, self.length
        hashes = np.fromiter((digest(view[a:a + size]) for a in starts.tolist()), np.uint64, len(starts))
        times = np.repeat(np.where(self.kind[self.crowded] & ALL > 0, 2, 1), counts)
        keys, number = np.unique(hashes, return_inverse=True)
        return keys, number, np.minimum(np.bincount(number, times, len(keys)), 2).astype(np.uint8)

    def removed(self, answers: pa.Table) -> np.ndarray:
        """The runs of bytes to drop, as a mask over the block's text."""
        step = np.zeros(len(self.data) + 1, np.int32)
        whole = np.flatnonzero(self.kind[self.number] & ALL > 0)
        np.add.at(step, self.first[whole], 1)
        np.add.at(step, self.last[whole] + self.length, -1)
        for numbers, hit in ((self.sent, self._judged(answers)), (self.crowded, self._counted(answers))):
            starts, _ = self.windows(numbers)
            np.add.at(step, starts[hit], 1)
            np.add.at(step, starts[hit] + self.length, -1)
        return np.cumsum(step[:-1], out=step[:-1]) > 0

    def _judged(self, answers: pa.Table) -> np.ndarray:
        """Which windows of the sent segments are repeated, in order; answers are packed by bucket."""
        n_windows = self.windows(self.sent)[1]
        bits = [np.unpackbits(np.frombuffer(v, np.uint8)[8:], count=int(np.frombuffer(v[:8], np.int64)[0]))
                for v in rows_of(answers, WINDOWS)]
        out = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        if len(out) != int(n_windows.sum()):
            raise RuntimeError("answers do not fit the segments that were sent")
        return out

    def _counted(self, answers: pa.Table) -> np.ndarray:
        if not len(self.crowded):
            return np.zeros(0, bool)
        _, number, _ = self.crowd()
        return heard(answers, CROWD, np.uint8)[number] > 1


def _judge_kinds(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Kind of each segment that was told: repeated as a whole, to be sent (by the first that told
    it), under a crowded k-gram."""
    content = np.ascontiguousarray(values[:, :8]).view(np.uint64).ravel()
    order = np.lexsort((content, group))
    by_gram, by_content = group[order], content[order]
    new = np.ones(len(order), bool)
    new[1:] = (by_gram[1:] != by_gram[:-1]) | (by_content[1:] != by_content[:-1])
    segment = np.cumsum(new) - 1
    times = np.bincount(segment, values[order, 8])
    different = np.bincount(by_gram[new], minlength=int(group.max()) + 1 if len(group) else 0)[by_gram]
    kind = np.where(times[segment] > 1, ALL, 0) if len(order) else np.zeros(0, np.int64)
    kind = kind + SENDS * (new & (different > 1)) + CROWDED * (different > MOST_SEGMENTS)
    out = np.empty(len(order), np.uint8)
    out[order] = kind
    return out, b""


def _count_windows(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, bytes]:
    return np.minimum(np.bincount(group, values[:, 0]), 2)[group].astype(np.uint8), b""


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes (at least), by prefix doubling."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k:k + n]
    known = 8
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if known >= depth or new.all():
            return order
        follower = np.zeros(n, np.int64)
        follower[:max(n - known, 0)] = rank[known:]
        key = (rank * (n + 1) + follower).astype(np.uint64)
        known *= 2


def short_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order and, for each suffix in it, whether its common prefix with the one before
    is shorter than ``length``.

    Rows come by increasing length of that prefix. Two neighbouring rows that begin with the same
    byte are the backward extension, by that byte, of the rows of the suffixes one byte on. So
    their prefix ends after l + 1 bytes if and only if, between those rows, a prefix
    that ends after l bytes has been found (and none shorter). ``length - 1`` ends the search, as does
    a length that finds nothing, since no longer one can follow.
    """
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]  # the transform; the first suffix is preceded by the last byte
    # Extension of a row by the byte before it: rows with this byte, in the same order (stable).
    extended = np.empty(n, np.int64)
    extended[np.argsort(before, kind="stable")] = np.arange(n)
    back = np.empty(n, np.int64)
    back[extended] = np.arange(n)  # the row that a row is the extension of
    starts = np.cumsum(np.bincount(text, minlength=256))
    short = np.zeros(n, bool)
    short[0] = True
    short[starts[starts < n]] = True  # rows that begin with another byte: prefixes of no byte
    open_rows = np.flatnonzero(~short)
    low, high = back[open_rows - 1].astype(np.int32), back[open_rows].astype(np.int32)
    for _ in range(1, length):
        found = np.cumsum(short, dtype=np.int32)
        new = found[low] != found[high]
        if not new.any():
            break
        short[open_rows[new]] = True
        open_rows, low, high = open_rows[~new], low[~new], high[~new]
    return order, short


def repeated_windows(text: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """Which windows of some strings (one after the other) are found twice, string by string."""
    ends = np.cumsum(lengths)
    # A byte 0 parts the strings; other bytes move up by one, and 255, never in UTF-8, is free.
    place = np.arange(len(text)) + np.repeat(np.arange(len(lengths)), lengths)
    joined = np.zeros(len(text) + len(lengths), np.uint8)
    joined[place] = text + 1
    order, short = short_prefixes(joined, length)
    same = np.zeros(len(joined), bool)
    same[1:] |= ~short[1:]
    same[:-1] |= ~short[1:]
    repeated = np.zeros(len(joined), bool)
    repeated[order] = same
    windows = lengths - length + 1
    return repeated[gather(ends - lengths + np.arange(len(lengths)), windows)]


def judge(table: pa.Table, length: int, at_once: int = TEXT_AT_ONCE) -> pa.Table:
    """Judge all segments of a bucket, the segments of a k-gram in the same transform."""
    rows = table.combine_chunks()
    keys = [np.frombuffer(k, np.uint64) for k in rows["keys"].to_pylist()]
    lengths = [np.frombuffer(v, np.int32).astype(np.int64) for v in rows["lengths"].to_pylist()]
    text = np.frombuffer(b"".join(rows["text"].to_pylist()), np.uint8)
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key, size = np.concatenate(keys), np.concatenate(lengths)
    begin = np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    windows = size - length + 1
    first = np.cumsum(windows) - windows
    hit = np.zeros(int(windows.sum()), bool)
    sums, at = np.cumsum(size[order]), 0
    while at < len(order):
        last = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + at_once))
        last = min(max(last, at + 1), len(order))
        while last < len(order) and key[order[last]] == key[order[last - 1]]:
            last += 1
        some = order[at:last]
        found = repeated_windows(text[gather(begin[some], size[some])], size[some], length)
        hit[gather(first[some], windows[some])] = found
        at = last
    counts = np.bincount(owner, windows, len(keys)).astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(counts)))
    values = [counts[i].tobytes() + np.packbits(hit[edges[i]:edges[i + 1]]).tobytes() for i in range(len(keys))]
    return pa.table({"block": rows["block"], "level": pa.array(np.full(len(keys), WINDOWS, np.int32)),
                     "bucket": rows["bucket"], "values": pa.array(values, pa.binary()),
                     "summary": pa.array([b""] * len(keys), pa.binary())})


def repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text",
            block_bytes: int | None = None, keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Drop repeated strings of ``length`` bytes from every whole text; one row per input row.

    Returns ``doc_id``, the ``keep`` columns, ``n_bytes``, ``n_removed``, ``n_spans`` (runs of
    dropped bytes), ``kept_sha256`` (of the bytes that are left) and, ``with_text``, ``kept``, those bytes as text: what
    is left of a character that was cut through is no text. A null text counts as empty; texts
    below ``length`` lose nothing. Equal rows are repeats of each other.
    """
    kept_columns = [c for c in keep or [] if c != text_column]
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("text"),
                       *[F.col(c).alias(f"__{i}") for i, c in enumerate(kept_columns)])
    types = {"doc_id": rows.schema["__id"].dataType.simpleString()}
    types |= {c: rows.schema[f"__{i}"].dataType.simpleString() for i, c in enumerate(kept_columns)}
    rows, n = blocked(rows, "text", *([block_bytes] if block_bytes else []))
    by_block = rows.groupBy("block")

    def number(table: pa.Table) -> int:
        return table["block"][0].as_py()

    def tell(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Block(table, length).kinds(n, number(table))])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, length)
        block.load(right)
        return block.send(n, number(left))

    def tell_crowd(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, length) if CROWDED in _flags(right) else None
        if block is None:
            return NOTHING
        block.load(right)
        keys, _, times = block.crowd()
        return pa.Table.from_batches([say(number(left), CROWD, keys, times[:, None], n)])

    kinds = answered(by_block.applyInArrow(tell, SAID), n, {KINDS: (np.uint8, 9, _judge_kinds)})
    sent = by_block.cogroup(kinds.groupBy("block")).applyInArrow(send, SENT)
    judged = dealt(dealt(sent, n, "bucket").groupBy("bucket").applyInArrow(lambda table: judge(table, length), FOUND),
                   n, "block")
    crowd = by_block.cogroup(kinds.groupBy("block")).applyInArrow(tell_crowd, SAID)
    counted = answered(crowd, n, {CROWD: (np.uint8, 1, _count_windows)})
    answers = kinds.unionByName(judged).unionByName(counted)
    types |= {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    types |= {"kept": "string"} if with_text else {}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in types.items())

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, length)
        block.load(right)
        drop = block.removed(right)
        out = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
            own = drop[a:b]
            left_over = block.data[a:b][~own].tobytes()
            out["n_removed"].append(int(own.sum()))
            out["n_spans"].append(int((own[1:] & ~own[:-1]).sum() + own[:1].sum()))
            out["kept_sha256"].append(hashlib.sha256(left_over).hexdigest())
            if with_text:
                out["kept"].append(left_over.decode(errors="ignore"))
        rows = block.table
        columns = [rows["__id"], *[rows[f"__{i}"] for i in range(len(kept_columns))],
                   pa.array(np.diff(block.offsets)), pa.array(out["n_removed"], pa.int64()),
                   pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()),
                   *([pa.array(out["kept"], pa.string())] if with_text else [])]
        return pa.Table.from_arrays(columns, names=list(types))

    return by_block.cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def _flags(answers: pa.Table) -> set[int]:
    kinds = heard(answers, KINDS, np.uint8)
    return {CROWDED} if (kinds & CROWDED).any() else set()
