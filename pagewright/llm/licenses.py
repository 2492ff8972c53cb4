"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line, every paragraph (lines up to one without a word) and every whole text is a vector of its words; its cosine
to each template decides. Document frequencies of the templates' words are counted over all files; a word that no
template has weighs as much as the rarest word that one has, each time it occurs. The vocabulary is the templates', so
what is broadcast doesn't grow with the data. Texts are scored in blocks: words become places in the vocabulary by their
hashes, (unit, word) counts become sparse rows, and rows that could reach the threshold are multiplied with the templates.

A line or paragraph of ``THRESHOLD`` or more is a header. A file whose whole text is, or that is named as a licence file
and has a header, is the licence file of its directory; of several, the best counts, then the first by path. A file
without a header takes the licence of the nearest directory above it that has a licence file: distinct directories are
joined by their ancestors' paths, and files by their directory.

Defined results: a null or empty text has no header; a file with a null path neither gives nor inherits; of templates
with equal cosine the first in ``TEMPLATES`` counts; rows that repeat an id or path are scored each; an empty table
gives an empty result; columns other than id, path and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows, cut, text_blocks
from pagewright.llm.words import Words, words

THRESHOLD = 0.8
#: Directories up to which their licences are broadcast.
BROADCAST_ROWS = 200_000
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"

# Notices and short texts of public licences, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain, CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_IS_WORD = np.ones(256, bool)
_IS_WORD[:128] = [chr(i).isalnum() for i in range(128)]


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    for lo, hi, raw, at in text_blocks(column):
        yield lo, hi, raw, at, words(raw, at, is_word=_IS_WORD)


class Model(NamedTuple):
    names: list[str]  # of each template
    vocabulary: np.ndarray  # sorted hashes of the templates' words
    weight: np.ndarray  # idf of each, and at the end that of a word no template has
    templates: np.ndarray  # (words, templates): tf * idf, columns of length 1

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary of each hash, or its length."""
        return _places(self.vocabulary, hashes)


def _places(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, len(vocabulary))


def learn(files: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> Model:
    """Weights by the document frequencies, over all of ``files``, of the templates' words."""
    arrow_rows(files.sparkSession)
    (*_, own), = _words(pa.array([text for _, text in templates]))
    vocabulary = np.unique(own.hash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for lo, hi, _, _, found in _words(batch.column(0)):
                document = np.repeat(np.arange(hi - lo), np.diff(found.first))
                once = np.unique(document * len(count) + _places(vocabulary, found.hash))
                count += np.bincount(once % len(count), minlength=len(count))
        count[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count)], names=["word", "n"])

    rows = files.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(len(vocabulary) + 1)
    count[rows["word"].to_numpy(np.int64)] = rows["n"].to_numpy()
    weight = np.log((1 + count[-1]) / (1 + count)) + 1
    weight[-1] = weight[:-1].max()
    matrix = np.zeros((len(vocabulary), len(templates)))
    for t in range(len(templates)):
        np.add.at(matrix[:, t], _places(vocabulary, own.hash[own.first[t] : own.first[t + 1]]), 1)
    matrix *= weight[:-1, None]
    return Model([name for name, _ in templates], vocabulary, weight, matrix / np.linalg.norm(matrix, axis=0))


def similar(model: Model, unit: np.ndarray, place: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, template, cosine) of the units that reach the threshold; ``unit`` is the unit of each word, ascending."""
    none = np.zeros(0, np.int64)
    if not len(unit):
        return none, none, np.zeros(0)
    begins = np.flatnonzero(np.diff(unit, prepend=-1))
    number = np.cumsum(np.diff(unit, prepend=-1) != 0) - 1
    known, size = place < len(model.vocabulary), len(model.vocabulary)
    alone = np.bincount(number[~known], minlength=len(begins))
    key, tf = np.unique(number[known] * size + place[known], return_counts=True)
    row, word = key // size, key % size
    value = tf * model.weight[word]
    inside = np.bincount(row, weights=value**2, minlength=len(begins))
    norm = np.sqrt(inside + alone * model.weight[-1] ** 2)
    # The cosine is at most the share that the templates' words have of the length.
    hopeful = np.sqrt(inside) >= threshold * norm - 1e-9
    taken = hopeful[row] & (inside[row] > 0)
    row, word, value = row[taken], word[taken], value[taken]
    if not len(row):
        return none, none, np.zeros(0)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    cosine = np.add.reduceat(model.templates[word] * value[:, None], first, axis=0) / norm[row[first]][:, None]
    cosine = np.round(cosine, 12)
    best = cosine.argmax(axis=1)
    top = cosine[np.arange(len(best)), best]
    good = top >= threshold
    return begins[row[first]][good], best[good], top[good]


def headers(model: Model, column: pa.Array, threshold: float = THRESHOLD) -> tuple[list, list, list, list, list]:
    """Of each text: the best header's licence and cosine, all headers' licences, the whole text's licence and cosine."""
    n = len(column)
    name, score, every, whole, whole_score = [None] * n, [None] * n, [[] for _ in range(n)], [None] * n, [None] * n
    for lo, hi, raw, at, found in _words(column):
        document = np.repeat(np.arange(hi - lo), np.diff(found.first))
        place = model.places(found.hash)
        line = np.searchsorted(np.sort(np.concatenate([np.flatnonzero(raw == 10), at[1:-1]])), found.start, side="right")
        # A line without a word lies between paragraphs.
        paragraph = np.cumsum((np.diff(line, prepend=0) > 1) | (np.diff(document, prepend=0) > 0))
        for unit in (line, paragraph):
            for word, t, cosine in zip(*(x.tolist() for x in similar(model, unit, place, threshold)), strict=True):
                r = lo + int(document[word])
                if model.names[t] not in every[r]:
                    every[r].append(model.names[t])
                if score[r] is None or cosine > score[r]:
                    name[r], score[r] = model.names[t], cosine
        for word, t, cosine in zip(*(x.tolist() for x in similar(model, document, place, threshold)), strict=True):
            r = lo + int(document[word])
            whole[r], whole_score[r] = model.names[t], cosine
    return name, score, [sorted(x) for x in every], whole, whole_score


def marked(files: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """id, path, header, header_score, licenses, whole, whole_score of each of ``files`` (id, path, text)."""
    sent = files.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.string(), pa.float64())
        for batch in batches:
            columns = [pa.array(x, t) for x, t in zip(headers(sent.value, batch.column(2), threshold), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "path", "header", "header_score", "licenses", "whole", "whole_score"])

    return files.mapInArrow(run, "id long, path string, header string, header_score double, licenses array<string>, whole string, whole_score double")


def inherited(found: DataFrame) -> DataFrame:
    """dir, license, score, from_path: the licence of the nearest directory, itself or above, that has a licence file."""
    is_file = F.col("whole").isNotNull() | (F.col("header").isNotNull() & F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_NAME))
    best = F.struct(-F.coalesce("whole_score", "header_score"), "path", F.coalesce("whole", "header").alias("license"))
    given = found.where(F.col("path").isNotNull() & is_file).groupBy("dir").agg(F.min(best).alias("x"))
    given = given.select(F.col("dir").alias("above"), "x.license", (-F.col("x.col1")).alias("score"), F.col("x.path").alias("from_path"))
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    chain = found.where("path is not null").select("dir").distinct().select("dir", F.posexplode(above).alias("depth", "above"))
    nearest = chain.join(given, "above").groupBy("dir").agg(F.max_by(F.struct("license", "score", "from_path"), "depth").alias("x"))
    return nearest.select("dir", "x.*")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, path, license, score, origin, from_path, licenses.

    origin: 'header' if the file itself has the licence, 'inherited' if a directory gives it (from_path: by which file),
    null if there is none. licenses: those of all headers of the file.
    """
    arrow_rows(files.sparkSession)
    rows = files.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    folder = F.array_join(F.filter(F.split(F.regexp_extract("path", r"^(.*?)[^/]*$", 1), "/"), lambda x: x != ""), "/")
    found = cut(marked(rows, learn(rows), threshold).withColumn("dir", folder), "licences")
    given = cut(inherited(found).toDF("dir", "i_license", "i_score", "i_path"), "inherited")
    if given.count() <= BROADCAST_ROWS:
        given = F.broadcast(given)
    joined = found.join(given, "dir", "left")
    own = F.coalesce("header", "whole")
    return joined.select(
        F.col("id").alias("doc_id"),
        "path",
        F.coalesce(own, "i_license").alias("license"),
        F.when(own.isNotNull(), F.coalesce("header_score", "whole_score")).otherwise(F.col("i_score")).alias("score"),
        F.when(own.isNotNull(), "header").when(F.col("i_license").isNotNull(), "inherited").alias("origin"),
        F.when(own.isNull(), F.col("i_path")).alias("from_path"),
        "licenses",
    )
