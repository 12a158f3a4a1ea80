"""Exact encoding and decoding with a SentencePiece BPE model, in vectorised merge rounds.

A text becomes segments that no piece can cross (a run of spaces with what follows it, and each
line break). The distinct segments of a slice are encoded together: one flat array holds the
symbols of all of them; every round takes the least pair rank of each segment, merges the
leftmost non-overlapping pairs of that rank at once, and compacts the arrays, until no pair
is left. A rank whose merged piece can at once take part in a better merge (or shares its
rank with another piece) is applied one leftmost pair a round, which keeps the order of the library.

The model must be a BPE model with byte fallback, identity normalisation, a dummy prefix and
no white-space removal, and no piece may hold white space behind other characters; all
but the last are read from the model file's behaviour when it is loaded, and an unfit model is
refused.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotflow.llm.text import MIX, encode, gather, slices

SPACE = "▁"  # the model's sign for a space
NONE = np.int32(2**31 - 1)
CACHED = 48 << 20  # bytes that the distinct segments kept between slices may take
ENTRY = 150  # bytes that a kept segment takes besides its own
SLICE = 1 << 20  # bytes of text encoded at once: joining ids and their digits takes some forty times as much


class PieceModel:
    """The tables of a model: pieces of characters, ranks and results of pairs, bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  a▁ ﬁ\n"
        if model.encode(probe) and model.decode(model.encode(probe)) != probe.replace(SPACE, " "):
            raise ValueError("the model changes white space or characters; it is not supported")
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.size = size
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i):
                self.bytes.append(b"")
            elif model.is_unknown(i):
                self.bytes.append(" ⁇ ".encode())
            else:
                self.bytes.append(name.replace(SPACE, " ").encode())
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        normal = {names[i]: i for i in range(size) if not special[i]}
        if any(SPACE in name.lstrip(SPACE) or "\n" in name for name in normal):
            raise ValueError("a piece crosses segments; the model is not supported")
        self.normal = set(normal.values())
        self.chars = {name: i for name, i in normal.items() if len(name) == 1}
        scores = {i: model.get_score(i) for i in normal.values()}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        shared: dict[float, int] = {}
        for score in scores.values():
            shared[score] = shared.get(score, 0) + 1
        left, right, made, rank = [], [], [], []
        for name, i in normal.items():
            for k in range(1, len(name)):
                a, b = normal.get(name[:k]), normal.get(name[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i), rank.append(order[scores[i]])
        left, right = np.array(left, np.int64), np.array(right, np.int64)
        made, rank = np.array(made, np.int32), np.array(rank, np.int32)
        own = np.full(size, NONE, np.int32)
        for i, score in scores.items():
            own[i] = order[score]
        # Pieces that may be followed at once by a merge of the same or a better rank.
        single = np.zeros(size, bool)
        single[[i for i, score in scores.items() if shared[score] > 1]] = True
        single[left[rank <= own[left]]] = True
        single[right[rank <= own[right]]] = True
        self.single = single
        self.rank, self.made = np.append(rank, NONE), np.append(made, np.int32(0))
        self._index(left * size + right)
        self.low = np.arange(1 << 16, dtype=np.int32) + size
        for char, i in self.chars.items():
            if ord(char) < 1 << 16:
                self.low[ord(char)] = i
        spelled = [b"%d," % i for i in range(size)]
        self.digits = np.array([len(s) for s in spelled], np.int64)
        self.widths = np.array([len(b) for b in self.bytes], np.int64)
        self.names, self.spoken = Pool(), Pool()
        self.names.add(np.frombuffer(b"".join(spelled), np.uint8), self.digits)
        self.spoken.add(np.frombuffer(b"".join(self.bytes), np.uint8), self.widths)

    def _index(self, keys: np.ndarray) -> None:
        """Place the pairs in a table by hash, each in the next free slot from its own."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        self.pairs = np.full(1 << bits, len(keys), np.int32)
        left, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.slots[at[first]], self.pairs[at[first]] = keys[left[first]], left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; rank NONE if it is no piece."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left >= self.size) | (right >= self.size)] = -2
        at = self._slot(keys)
        found = self.slots[at]
        pair = np.where(found == keys, self.pairs[at], len(self.rank) - 1)
        left_over = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes):
            if not len(left_over):
                break
            at[left_over] = (at[left_over] + 1) & self.mask
            found = self.slots[at[left_over]]
            hit = found == keys[left_over]
            pair[left_over[hit]] = self.pairs[at[left_over[hit]]]
            left_over = left_over[~hit & (found >= 0)]
        return self.rank[pair], self.made[pair]

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after the other, and their counts."""
        texts = [s.decode().replace(" ", SPACE) for s in segments]
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        # A character without a piece keeps a symbol of its own above all ids.
        symbols = self.low[np.minimum(chars, len(self.low) - 1)]
        for i in np.flatnonzero(chars >= len(self.low)).tolist():
            symbols[i] = self.chars.get(chr(chars[i]), self.size + int(chars[i]))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        rank, made = self._pairs(symbols, owner)
        done_symbols, done_owner = [], []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            counts = np.diff(np.r_[first, len(symbols)])
            best = np.minimum.reduceat(rank, first)
            active = best < NONE
            if not active.all():
                over = np.repeat(~active, counts)
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                keep = ~over
                symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
                best, counts = best[active], counts[active]
                first = np.cumsum(counts) - counts
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, counts))
            one = self.single[made[at]]
            firsts = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            # Of pairs that overlap in a row every second one is merged, from the left.
            run = np.r_[True, at[1:] != at[:-1] + 1]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[np.where(one, firsts, place % 2 == 0)]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged symbols stand after compaction
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            near = np.zeros(len(symbols) + 1, bool)
            near[moved] = near[moved - 1] = True  # -1 is the spare place at the end
            touched = np.flatnonzero(near[:-1])
            rank[touched] = NONE
            inner = touched[touched + 1 < len(symbols)]
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner], made[inner] = self.look_up(symbols[inner], symbols[inner + 1])
        symbols = np.concatenate(done_symbols) if done_symbols else symbols
        owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(owner, kind="stable")
        return self._bytes_for_unknown(symbols[order], owner[order], len(texts))

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(symbols), NONE, np.int32)
        made = np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            same = np.flatnonzero(owner[1:] == owner[:-1])
            rank[same], made[same] = self.look_up(symbols[same], symbols[same + 1])
        return rank, made

    def _bytes_for_unknown(self, symbols: np.ndarray, owner: np.ndarray,
                           n: int) -> tuple[np.ndarray, np.ndarray]:
        unknown = np.flatnonzero(symbols >= self.size)
        if len(unknown):
            spelled = [chr(s - self.size).encode() for s in symbols[unknown].tolist()]
            lengths = np.ones(len(symbols), np.int64)
            lengths[unknown] = [len(b) for b in spelled]
            place = np.cumsum(lengths) - lengths
            out = np.repeat(symbols, lengths)
            out[gather(place[unknown], lengths[unknown])] = \
                self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            symbols, owner = out, np.repeat(owner, lengths)
        return symbols, np.bincount(owner, minlength=n)

    def decode(self, ids: list[int]) -> bytes:
        """The text of any ids, in UTF-8: bytes that form no character become U+FFFD each."""
        out, run = [], bytearray()
        for i in ids:
            if self.is_byte[i]:
                run += self.bytes[i]
                continue
            if run:
                out.append(_spelled(bytes(run)))
                run = bytearray()
            out.append(self.bytes[i])
        if run:
            out.append(_spelled(bytes(run)))
        text = b"".join(out)
        dummy = bool(ids) and not self.is_byte[ids[0]] and self.bytes[ids[0]][:1] == b" "
        return text[1:] if dummy and ids[0] in self.normal else text


def _spelled(run: bytes) -> bytes:
    """Bytes as text; each byte that belongs to no whole character becomes U+FFFD."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(run):
        for size in (1, 2, 3, 4):
            try:
                run[i:i + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(run[i:i + size])
            i += size
            break
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


def segments(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes and distinct segments of the texts, and the first segment of each text."""
    padded = [b" " + t if t else b"" for t in texts]
    data = np.frombuffer(b"".join(padded), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in padded]))).astype(np.int64)
    space, line = data == 0x20, data == 0x0A
    begin = line.copy()
    begin[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(begin)
    codes, distinct = encode(data, starts, np.r_[starts[1:], len(data)])
    return codes, distinct, np.searchsorted(starts, offsets)


class Pool:
    """Rows of bytes or ids one after the other, to be joined by place."""

    def __init__(self, kind: type = np.uint8):
        self.data, self.ends = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, joined: np.ndarray, lengths: np.ndarray) -> None:
        self.data = np.concatenate((self.data, joined))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))

    def join(self, places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows at ``places``, joined, and where each text's part of them begins."""
        lengths = self.ends[places + 1] - self.ends[places]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        return self.data[gather(self.ends[places], lengths)], sums[rows]


@functools.lru_cache(maxsize=1)
def loaded(path: str) -> PieceModel:
    """The tables of a model, made once in a worker."""
    return PieceModel(path)


class Coder:
    """Encodes texts in a task; keeps the last distinct segments between slices."""

    def __init__(self, path: str):
        self.model = loaded(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.taken = 0
        self.ids, self.names, self.decoded = Pool(np.int32), Pool(), Pool()

    def learn(self, values: list[bytes]) -> None:
        missing = [v for v in values if v not in self.known]
        if not missing:
            return
        if self.taken + sum(map(len, missing)) + ENTRY * len(missing) > CACHED:
            self.clear()
            missing = values
        self.taken += sum(map(len, missing)) + ENTRY * len(missing)
        model, n = self.model, len(missing)
        ids, counts = model.encode_segments(missing)
        owner = np.repeat(np.arange(n), counts)
        self.ids.add(ids.astype(np.int32), counts)
        self.names.add(*model.names.join(ids, np.arange(len(ids) + 1))[:1],
                       np.bincount(owner, model.digits[ids], n).astype(np.int64))
        self.decoded.add(*model.spoken.join(ids, np.arange(len(ids) + 1))[:1],
                         np.bincount(owner, model.widths[ids], n).astype(np.int64))
        first = len(self.known)
        self.known.update(zip(missing, range(first, first + n), strict=True))

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[bytes, bytes]]]:
        """All ids, where each text's begin, and of each text its ids as decimals joined by commas and its decoded bytes."""
        codes, distinct, rows = segments([t.replace(SPACE.encode(), b" ") for t in texts])
        values = distinct.to_pylist()
        self.learn(values)
        places = np.fromiter(map(self.known.__getitem__, values), np.int64, len(values))[codes]
        ids, id_rows = self.ids.join(places, rows)
        names, name_rows = self.names.join(places, rows)
        decoded, decoded_rows = self.decoded.join(places, rows)
        # Every name ends in a comma, and every text begins with the dummy space.
        return ids, id_rows, (
            (names[name_rows[i]:max(name_rows[i + 1] - 1, name_rows[i])].tobytes(),
             decoded[decoded_rows[i] + 1:decoded_rows[i + 1]].tobytes()) for i in range(len(texts)))


def encoded(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text",
            with_ids: bool = False, with_text: bool = True) -> DataFrame:
    """Encode and decode every whole text; one row per input row.

    Returns the id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, with ``with_text`` also ``decoded`` (the
    decoded text), with ``with_ids`` also ``ids``. A null text counts as empty, so it has no ids. Rows
    may repeat; further columns are left out. ``model`` is the path of the model file on
    the executors.
    """
    fields = ("doc_id: {t}, n_tokens: long, ids_sha256: string, decoded_sha256: string"
              + (", decoded: string" if with_text else "") + (", ids: array<int>" if with_ids else ""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = fields.format(t=rows.schema["doc_id"].dataType.simpleString())

    def work(batches):
        coder = Coder(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, begin, texts = coder.texts([t.encode() if t else b"" for t in part["text"].to_pylist()])
                named, spoken, decoded = [], [], []
                for name, text in texts:
                    named.append(hashlib.sha256(name).hexdigest()), spoken.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        decoded.append(text.decode())
                columns = [part["doc_id"], pa.array(np.diff(begin)), pa.array(named), pa.array(spoken)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_text:
                    columns.append(pa.array(decoded)), names.append("decoded")
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(work, schema)
