"""Language-model scores of a probabilistic suffix tree over words.

The tree's root predicts a word from its frequency, add-one smoothed. A node is a context of one or
more preceding words. A context becomes a state if it is seen often enough and passes a
divergence test against its longest shorter state: the log likelihood of the words that
follow it, each left out of its own estimate, must rise by at least ``GAIN`` when the
context's distribution is used. Distributions are smoothed by mixing the context's
relative frequencies with its parent's distribution; the share of the parent is the one
of ``SHARES`` with the best left-out likelihood. A word is scored by the longest state
that is a suffix of the words before it.

Counts of words, pairs and longer contexts cover all training texts. They are added up in buckets
(see ``blocks``), a level of the tree at a time: counts first, then the test of the contexts.
No vocabulary and no tree is gathered in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotflow.llm.blocks import NOTHING, SAID, answered, blocked, heard, rows_of, say, unpacked
from depotflow.llm.text import MIX, NOT_SPACE, hash_all, mix, words

DEPTH = 2  # words in the longest context
LEAST = 8  # times that a context must be seen in training
GAIN = 4.0  # natural log units that the test asks for
SHARES = np.array([0.02, 0.1, 0.3, 0.6])  # of the parent's distribution
UNITS = 64  # steps of a natural log unit in sums, so that sums do not depend on their order
#: Bytes that tell the pairs of a bucket apart. Of some 10**7 pairs about one shares its count with another.
PAIR_BYTES = 5
END = np.uint64(0x5EED0FE11D0F7E87)  # the key of the end of a text


class Block:
    """The tokens of a block and what the buckets said of them so far."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, least: int, depth: int):
        table = unpacked(table)
        self.table = table
        self.n_docs, self.least = table.num_rows, least
        split = words(table["text"], NOT_SPACE)
        hashes = np.append(hash_all(split.distinct), END)
        self.keys, rank = np.unique(hashes, return_inverse=True)  # the words, by key
        ends = split.rows[1:]
        codes = np.insert(split.codes.astype(np.int64), ends, len(split.distinct))
        self.word = rank[codes]
        self.rows = split.rows + np.arange(len(split.rows))
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.rows))
        self.place = np.arange(len(self.word)) - self.rows[:-1][self.doc]
        train = table["train"].combine_chunks().to_numpy(zero_copy_only=False)
        self.train = train[self.doc] if self.n_docs else np.zeros(0, bool)
        self.answers, self.depth = answers, depth

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word[self.train], minlength=len(self.keys)).astype(np.int64)

    def load_words(self) -> None:
        self.count = heard(self.answers, 0, np.int64)
        sums = np.frombuffer(b"".join(rows_of(self.answers, 0, "summary")), np.int64).reshape(-1, 2).sum(axis=0)
        self.total, self.types = int(sums[0]), int(sums[1])
        self.root = (self.count + 1.0) / (self.total + self.types + 1)
        # Of each level: the tokens with a context, the context's number and count, and the count of both.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self._pairs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        # Keys of the contexts of each level, ascending; a pair of a level is a context of the next.
        self._contexts: list[np.ndarray] = []

    def contexts(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens after a context of ``length`` words that is seen often enough: their places,
        the contexts' numbers (in ``self._contexts``) and counts."""
        if length == 1:
            keys, at = self.keys, np.flatnonzero(self.place >= 1)
            number, seen = self.word[at - 1], self.count[self.word[at - 1]]
        else:
            # The context of a token is the pair that ends at the token before it.
            before, _, _, counts = self.levels[length - 2]
            keys, number_of, _ = self.pairs(length - 1)
            count_at, number_at = np.zeros(len(self.word), np.int64), np.zeros(len(self.word), np.int64)
            count_at[before], number_at[before] = counts, number_of
            at = np.flatnonzero(self.place >= length)
            number, seen = number_at[at - 1], count_at[at - 1]
        enough = seen >= self.least
        at, number, seen = at[enough], number[enough], seen[enough]
        held = np.zeros(len(keys), bool)
        held[number] = True
        self._contexts[length - 1:] = [keys[held]]
        return at, (np.cumsum(held) - 1)[number], seen

    @staticmethod
    def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(context * MIX + word)

    def pairs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct pairs of a context and a word seen in training, their number of each
        token (-1 if the word is not seen), and their training counts."""
        if length not in self._pairs:
            at, context, _ = self.levels[length - 1][:3] if length <= len(self.levels) else self.contexts(length)
            word = self.word[at]
            known = self.count[word] >= 1
            keys, number = np.unique(self.pair_keys(self._contexts[length - 1][context[known]], self.keys[word[known]]),
                                     return_inverse=True)
            number_of = np.full(len(at), -1, np.int64)
            number_of[known] = number
            times = np.bincount(number[self.train[at[known]]], minlength=len(keys))
            self._pairs[length] = keys, number_of, times.astype(np.int32)
        return self._pairs[length]

    def load_pairs(self, length: int) -> None:
        at, context, seen = self.contexts(length)
        self.levels.append((at, context, seen, np.zeros(0, np.int64)))
        _, number, _ = self.pairs(length)
        counts = np.append(heard(self.answers, 2 * length - 1, np.int32), 0).astype(np.int64)
        self.levels[-1] = at, context, seen, counts[number]  # a word that no text trains has none

    def states(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the distinct contexts of a level and the number of each token's context."""
        return self._contexts[length - 1], self.levels[length - 1][1]

    def estimate(self, upto: int, left_out: bool) -> np.ndarray:
        """Probability of every token by the states of up to ``upto`` words."""
        p = self.root[self.word]
        for length in range(1, upto + 1):
            at, _, seen, times = self.levels[length - 1]
            _, number = self.states(length)
            code = heard(self.answers, 2 * length, np.uint8)[number] if len(at) else np.zeros(0, np.uint8)
            kept = code > 0
            at, seen, times = at[kept], seen[kept], times[kept]
            share = SHARES[code[kept].astype(int) - 1]
            less = left_out & self.train[at]
            p[at] = (1 - share) * (times - less) / np.maximum(seen - less, 1) + share * p[at]
        return p

    def gains(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each context: the rise of the left-out log likelihood for each share, in units."""
        at, _, seen, times = self.levels[length - 1]
        keys, number = self.states(length)
        parent = self.estimate(length - 1, left_out=True)
        own = self.train[at]
        at, seen, times, number = at[own], seen[own], times[own], number[own]
        ratio = (times - 1) / np.maximum(seen - 1, 1) / parent[at]
        out = np.zeros((len(keys), len(SHARES)), np.int32)
        for k, share in enumerate(SHARES):
            units = np.rint(np.log((1 - share) * ratio + share) * UNITS)
            sums = np.bincount(number, units, len(keys))
            out[:, k] = np.clip(sums, -(2**31) + 1, 2**31 - 1)
        return keys, out

    def scores(self) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, training tokens, score of the root, score."""
        base = np.log10(self.root[self.word])
        score = np.log10(self.estimate(self.depth, left_out=False))
        known = self.count[self.word] > 0
        sums = [np.bincount(self.doc, x, self.n_docs) for x in (known, base, score)]
        return (np.diff(self.rows).astype(np.int64), sums[0].astype(np.int64),
                np.full(self.n_docs, self.total, np.int64), sums[1], sums[2])


def _sum_words(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, bytes]:
    sums = np.bincount(group, values[:, 0]).astype(np.int64)
    return sums[group], np.array([sums.sum(), (sums > 0).sum()], np.int64).tobytes()


def _sum_pairs(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, bytes]:
    return np.bincount(group, values[:, 0])[group].astype(np.int32), b""


def _test(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """For each context 0, or 1 + the number of the best share if the test is passed."""
    if not len(group):
        return np.zeros(0, np.uint8), b""
    sums = np.stack([np.bincount(group, values[:, k]) for k in range(values.shape[1])], axis=1)
    code = np.where(sums.max(axis=1) >= GAIN * UNITS, sums.argmax(axis=1) + 1, 0)
    return code[group].astype(np.uint8), b""


def scored(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text",
           depth: int = DEPTH, least: int = LEAST, block_bytes: int | None = None) -> DataFrame:
    """Score every whole text by the tree learned from the rows where ``train`` holds.

    Returns ``doc_id``, ``train``, ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``,
    ``base_score`` (the root alone) and ``score``, log10 probabilities. A null text counts as
    empty and has its end as only token; a null ``train`` trains. Rows may repeat; each counts. Without
    training rows every score is 0. Further columns are left out.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"),
                       F.coalesce(train, F.lit(True)).alias("train"))
    doc_id = rows.schema["doc_id"].dataType.simpleString()
    rows, n = blocked(rows, "text", *([block_bytes] if block_bytes else []))
    by_block = rows.groupBy("block")

    def load(left: pa.Table, right: pa.Table, length: int) -> Block:
        """A block with the counts of contexts up to ``length``."""
        block = Block(left, right, least, depth)
        block.load_words()
        for k in range(1, length + 1):
            block.load_pairs(k)
        return block

    def first(table: pa.Table) -> pa.Table:
        block = Block(table, None, least, depth)
        return pa.Table.from_batches([say(table["block"][0].as_py(), 0, block.keys,
                                          block.word_counts()[:, None], n)])

    def ask_of(tested: int, counted: int):
        """Ask for the test of contexts of ``tested`` words and the counts of the next longer ones."""
        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return NOTHING
            block, number, said = load(left, right, tested), left["block"][0].as_py(), []
            if tested:
                keys, units = block.gains(tested)
                said.append(say(number, 2 * tested, keys, units, n))
            if counted:
                keys, _, times = block.pairs(counted)
                said.append(say(number, 2 * counted - 1, keys, times[:, None], n, PAIR_BYTES))
            return pa.Table.from_batches(said)
        return ask

    answers = answered(by_block.applyInArrow(first, SAID), n, {0: (np.int64, 1, _sum_words)})
    for tested in range(depth + 1):
        counted = tested + 1 if tested < depth else 0
        said = by_block.cogroup(answers.groupBy("block")).applyInArrow(ask_of(tested, counted), SAID)
        how = {2 * tested: (np.int32, len(SHARES), _test)} if tested else {}
        if counted:
            how[2 * counted - 1] = (np.int32, 1, _sum_pairs)
        answers = answers.unionByName(answered(said, n, how))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block = load(left, right, depth)
        n_tokens, known, total, base, own = block.scores()
        return pa.table({"doc_id": block.table["doc_id"], "train": block.table["train"], "n_tokens": n_tokens,
                         "n_known": known, "train_tokens": total, "base_score": base, "score": own})

    return by_block.cogroup(answers.groupBy("block")).applyInArrow(
        score, f"doc_id {doc_id}, train boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")
