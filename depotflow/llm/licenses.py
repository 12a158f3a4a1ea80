"""Licence scans: TF-IDF cosine of lines, windows and whole files to templates, then inheritance.

1. Terms of the templates are weighted by how many files hold them; all files are counted.
2. Every line of every file is compared with every template: both as sparse TF-IDF vectors, where
   a word that no template has counts with the weight of the rarest term. So is every run of as many
   words as the template has, across line breaks: a notice may be wrapped, or stand within a
   longer line. Of a file named like a licence file, the text as a whole is compared too, with
   the templates and with whole licence texts. The best of these at or above the threshold is the
   file's own licence.
3. A file named like a licence file gives its licence to its directory. A file without a licence
   takes that of the nearest directory above it that has one, by joins on paths.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotflow.llm.text import ALPHANUMERIC, LOWER, encode, slices, text_bytes, word_bounds
from depotflow.session import durable

THRESHOLD = 0.75
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([-._].*)?$"

# Notices as licences word them, with the names of the licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                   "file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


#: Licences as whole texts, without the line that names the holder.
WHOLE = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions: The above copyright notice and this "
            "permission notice shall be included in all copies or substantial portions of the Software. THE "
            "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
            "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
            "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
            "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met: 1. Redistributions of source code "
                     "must retain the above copyright notice, this list of conditions and the following "
                     "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                     "this list of conditions and the following disclaimer in the documentation and/or other "
                     "materials provided with the distribution. 3. Neither the name of the copyright holder nor "
                     "the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission."),
)


def words_of(text: str) -> list[bytes]:
    data, offsets = text_bytes(pa.array([text]))
    data = LOWER[data]
    starts, ends, _ = word_bounds(data, offsets, ALPHANUMERIC)
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


def _lines(column, terms: dict[bytes, int]):
    """Of each word: its term (-1 if none), its line, its file, and its code; words in page order."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, ALPHANUMERIC)
    codes, distinct = encode(data, starts, ends)
    term_of = np.fromiter((terms.get(v, -1) for v in distinct.to_pylist()), np.int64, len(distinct))
    breaks = np.flatnonzero(data == 0x0A)
    owner = np.repeat(np.arange(len(column)), np.diff(rows))
    line = np.searchsorted(breaks, starts) + owner  # files lie one behind the other
    return term_of[codes] if len(codes) else np.zeros(0, np.int64), line, owner, codes


def term_weights(files: DataFrame, terms: dict[bytes, int], text_column: str) -> tuple[np.ndarray, float]:
    """Inverse document frequency of each term over all files, and that of an unseen word."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                term, _, owner, _ = _lines(part["text"], terms)
                seen = np.unique(owner[term >= 0] * len(terms) + term[term >= 0]) % len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(terms) + 1)),
                     pa.array(np.append(np.bincount(seen, minlength=len(terms)), part.num_rows))],
                    names=["term", "files"])

    counts = np.zeros(len(terms) + 1)
    for row in (files.select(F.col(text_column).alias("text")).mapInArrow(count, "term long, files long")
                .groupBy("term").agg(F.sum("files").alias("files")).collect()):  # a row per term
        counts[row.term] = row.files
    total = counts[-1]
    return np.log((total + 1) / (counts[:-1] + 1)) + 1, math.log(total + 1) + 1


def own_licences(files: DataFrame, path_column: str = "path", text_column: str = "text",
                 templates: tuple[tuple[str, str], ...] = TEMPLATES,
                 threshold: float = THRESHOLD) -> DataFrame:
    """Add ``licence`` and ``score`` of the best line to path and id columns of every file."""
    of_template = [words_of(t) for _, t in templates]
    of_whole = of_template + [words_of(t) for _, t in WHOLE]
    first = sorted({w for ws in of_template for w in ws})
    more = sorted({w for ws in of_whole for w in ws} - set(first))  # terms of whole texts only
    terms = {w: i for i, w in enumerate(first + more)}
    names = [n for n, _ in templates] + [n for n, _ in WHOLE]
    idf, unseen = term_weights(files, terms, text_column)
    whole = np.zeros((len(terms), len(of_whole)))
    for k, ws in enumerate(of_whole):
        for w in ws:
            whole[terms[w], k] += idf[terms[w]]
    whole /= np.linalg.norm(whole, axis=0)
    matrix = whole[:len(first), :len(templates)]
    lengths = [len(ws) for ws in of_template]
    named = F.coalesce(F.element_at(F.split(F.col(path_column), "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    rows = files.withColumnRenamed(text_column, "text") if text_column != "text" else files
    kept = [c for c in rows.columns if c not in ("text", "licence", "score")]
    schema = rows.select(*kept).schema.add("licence", "string").add("score", "double")

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                split = _lines(part["text"], terms)
                found = best_lines(part.num_rows, split, idf, unseen, matrix)
                best_windows(found, split, idf, unseen, matrix, lengths, threshold)
                best_whole(found, split, idf, unseen, whole, part["__named"].to_numpy(zero_copy_only=False))
                licence = [names[k] if s >= threshold else None for s, k in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part[c] for c in kept] + [pa.array(licence, pa.string()), pa.array(found[0])],
                    names=kept + ["licence", "score"])

    return rows.select(*kept, "text", named.alias("__named")).mapInArrow(work, schema)


Found = tuple[np.ndarray, np.ndarray]  # of each file the greatest cosine and its template


def best_lines(n: int, split, idf, unseen, matrix) -> Found:
    """Of each file the greatest cosine of a line, and the template; the first of equal ones."""
    term, line, owner, codes = split
    n_terms = len(matrix)  # terms of whole texts only come after these
    term = np.where(term < n_terms, term, -1)
    score, which = np.zeros(n), np.zeros(n, np.int64)
    known = term >= 0
    if not known.any():
        return score, which
    n_lines = int(line[-1]) + 1
    rich = np.bincount(line[known], minlength=n_lines)[line] > 0
    # The weight of a word that is no term: its count in the line times the unseen weight.
    other = rich & ~known
    pair, times = np.unique(line[other] * (int(codes.max()) + 1) + codes[other], return_counts=True)
    square = np.bincount(pair // (int(codes.max()) + 1), (times * unseen) ** 2, n_lines).astype(float)
    pair, times = np.unique(line[rich & known] * n_terms + term[rich & known], return_counts=True)
    at, weight = pair // n_terms, times * idf[pair % n_terms]
    square += np.bincount(at, weight ** 2, n_lines)
    used, place = np.unique(at, return_inverse=True)
    dot = np.zeros((len(used), matrix.shape[1]))
    np.add.at(dot, place, weight[:, None] * matrix[pair % n_terms])
    cosine = dot / np.sqrt(square[used])[:, None]
    template = cosine.argmax(axis=1)
    best = cosine[np.arange(len(used)), template]
    file_of = np.zeros(n_lines, np.int64)
    file_of[line] = owner
    order = np.lexsort((-np.arange(len(used)), best, file_of[used]))  # the best, earliest line last
    score[file_of[used][order]], which[file_of[used][order]] = best[order], template[order]
    return np.minimum(score, 1.0), which


def _better(found: Found, files: np.ndarray, scores: np.ndarray, template) -> None:
    """Take what is greater than the cosine known of a file; the template of least number of equal ones."""
    score, which = found
    template = np.broadcast_to(template, len(files))
    order = np.lexsort((-template, scores, files))  # the best of each file last
    last = order[np.append(files[order][1:] != files[order][:-1], True)] if len(order) else order
    last = last[scores[last] > score[files[last]] + 1e-9]
    score[files[last]], which[files[last]] = np.minimum(scores[last], 1.0), template[last]


def best_windows(found: Found, split, idf, unseen, matrix, lengths, threshold: float) -> None:
    """Runs of as many words as a template has, or the whole of a shorter file, at or above the threshold."""
    term, _, owner, codes = split
    if not len(term):
        return
    n = len(term)
    term = np.where(term < len(matrix), term, -1)
    weight = np.append(idf[:len(matrix)], unseen)[term]
    squares = np.concatenate(([0.0], np.cumsum(weight ** 2)))
    end_of = np.searchsorted(owner, owner, side="right")  # of each word's file
    start_of = np.searchsorted(owner, owner, side="left")
    at = np.arange(n)
    for k, length in enumerate(lengths):
        share = np.append(idf[:len(matrix)] * matrix[:, k], 0.0)[term]
        dots = np.concatenate(([0.0], np.cumsum(share)))
        stop = np.minimum(at + length, end_of)
        # A word told twice weighs more than twice in the norm: the sum of squares is its least value.
        dot, least = dots[stop] - dots[:-1], squares[stop] - squares[:-1]
        some = np.flatnonzero((dot > 0) & (dot ** 2 * (1 + 1e-6) >= threshold ** 2 * least)
                              & ((stop - at == length) | (at == start_of)))
        for a in range(0, len(some), 1 << 16):
            part = some[a:a + (1 << 16)]
            spots = part[:, None] + np.arange(length)
            inside = spots < stop[part][:, None]
            spots = np.minimum(spots, n - 1)
            code = np.where(inside, codes[spots], -1 - np.arange(length))
            size = np.where(inside, weight[spots], 0.0)
            # The norm: each word of the window counts with its weight as often as it meets its like.
            square = np.zeros(len(part))
            for i in range(length):
                square += size[:, i] ** 2 * (code == code[:, i:i + 1]).sum(axis=1)
            cosine = dot[part] / np.sqrt(square)
            enough = cosine >= threshold
            _better(found, owner[part[enough]], cosine[enough], k)


def best_whole(found: Found, split, idf, unseen, whole, named: np.ndarray) -> None:
    """The whole texts of files named like licence files."""
    term, _, owner, codes = split
    own = named.astype(bool)[owner] if len(owner) else np.zeros(0, bool)
    if not own.any():
        return
    term, owner, codes = term[own], owner[own], codes[own].astype(np.int64)
    span = int(codes.max()) + 1
    pair, first, times = np.unique(owner * span + codes, return_index=True, return_counts=True)
    files, place = np.unique(pair // span, return_inverse=True)
    weight = times * np.append(idf, unseen)[term[first]]
    dot = np.zeros((len(files), whole.shape[1]))
    known = term[first] >= 0
    np.add.at(dot, place[known], weight[known, None] * whole[term[first][known]])
    cosine = dot / np.sqrt(np.bincount(place, weight ** 2))[:, None]
    template = cosine.argmax(axis=1)
    _better(found, files, cosine[np.arange(len(files)), template], template)


def scan(files: DataFrame, path_column: str = "path", text_column: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """Licence of every file, its own or inherited; one row per row of ``files``.

    Returns all columns but the text, and ``licence`` (null if there is none), ``score`` (cosine
    of the file's best line, of a better run of words that reaches the threshold, or of the whole
    of a licence file), ``origin`` ("own", "inherited" or null) and ``licence_dir`` (the
    directory inherited from). Of several licence files of a directory the best score counts,
    then the licence by name. A null text has score 0; a null path inherits nothing.
    Columns of these names in the input are replaced.
    """
    files = files.drop("licence", "score", "origin", "licence_dir")
    found = own_licences(files, path_column, text_column, threshold=threshold)
    path = F.col(path_column)
    found = durable(found.withColumn("__dir", F.regexp_replace(path, r"/?[^/]*$", "")))
    named = F.element_at(F.split(path, "/"), -1).rlike(LICENCE_FILE)
    in_order = Window.partitionBy("__dir").orderBy(F.desc("score"), "licence")
    holders = (found.where(F.col("licence").isNotNull() & named)
               .groupBy("__dir", "licence").agg(F.max("score").alias("score"))
               .withColumn("place", F.row_number().over(in_order)).where("place = 1")
               .select(F.col("__dir").alias("licence_dir"), F.col("licence").alias("__licence")))
    parts = F.split("__dir", "/")
    above = (found.select("__dir").where(F.col("__dir").isNotNull()).distinct()
             .withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
             .withColumn("licence_dir", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")))
    nearest = (above.join(holders, "licence_dir").groupBy("__dir")
               .agg(F.max(F.struct("depth", "licence_dir", "__licence")).alias("from"))
               .select("__dir", "from.licence_dir", "from.__licence"))
    own = F.col("licence").isNotNull()
    return (found.join(nearest, "__dir", "left")
            .withColumn("origin", F.when(own, F.lit("own"))
                        .when(F.col("__licence").isNotNull(), F.lit("inherited")))
            .withColumn("licence_dir", F.when(~own, F.col("licence_dir")))
            .withColumn("licence", F.coalesce("licence", "__licence"))
            .select(*[c for c in files.columns if c != text_column], "licence", "score", "origin",
                    "licence_dir"))
