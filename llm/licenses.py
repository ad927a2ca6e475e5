"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

A statement is a line that names a licence, the paragraph around it, or the whole file. Each becomes a sparse vector
(term counts times inverse document frequency over all files) and takes the template with the largest cosine if that is
at least ``COSINE``. A file named like a licence, or one whose statement is at least ``FILE_SHARE`` of its words, is a
licence file and speaks for its directory and everything below; a file without a statement of its own takes the
licence of the nearest such directory, found by joining directories with their ancestors.

Defined results: null and empty texts have no statement but can inherit; a null path lies in no directory; with several
licence files in a directory the larger cosine and then the smaller path speaks; ties between templates go to the
smaller name; equal rows get equal answers; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import small_batches, stored
from llm.decontam import words_of

COSINE = 0.6
FILE_SHARE = 0.1
NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
_MARK = re.compile(r"licen[cs]|copyright|spdx|permission is hereby|redistribution and use|free software|public domain|creative commons|cc by|cc0|gpl", re.I)

#: Short notices by which licences are stated.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
}


def term_counts(files: DataFrame, terms: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of files, and in how many each of the templates' terms occurs (whole texts, all files)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, count = 0, Counter()
        for batch in small_batches(batches, "text"):
            n += batch.num_rows
            for text in batch.column("text").to_pylist():
                count.update(terms.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"term": pa.array([b"", *count], pa.binary()), "n": pa.array([n, *count.values()], pa.int64())})

    got = files.select("text").mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["term"]): r["n"] for r in got}
    return counts.pop(b"", 0), counts


class Matcher:
    """TF-IDF vectors of the templates and the best template of a statement."""

    def __init__(self, n: int, counts: dict[bytes, int], templates: dict[str, list[str]]):
        self.rare = math.log(n + 1) + 1
        vocabulary = {w for texts in templates.values() for t in texts for w in words_of(t)}
        self.idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}
        self.vectors = [(name, self.vector(words_of(t))) for name, texts in sorted(templates.items()) for t in texts]

    def vector(self, words: list[bytes]) -> dict[bytes, float]:
        raw = {w: c * self.idf.get(w, self.rare) for w, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    def best(self, words: list[bytes]) -> tuple[float, str]:
        own = self.vector(words)
        found = [(sum(x * own.get(w, 0.0) for w, x in template.items()), name) for name, template in self.vectors]
        score = max(f[0] for f in found)
        return score, min(name for s, name in found if s == score)

    def statement(self, text: str | None) -> tuple[str | None, float, int, int]:
        """(licence, cosine, words of the statement, words of the file)."""
        if not text or not _MARK.search(text):
            return None, 0.0, 0, 0
        parts = [text]
        for paragraph in re.split(r"\n\s*\n", text):
            if _MARK.search(paragraph):
                parts += [paragraph, *(line for line in paragraph.split("\n") if _MARK.search(line))]
        best = (0.0, "", 0)
        for part in dict.fromkeys(parts):
            words = words_of(part)
            if words:
                score, name = self.best(words)
                if (score, -len(words)) > (best[0], -best[2]):
                    best = score, name, len(words)
        if best[0] < COSINE:
            return None, 0.0, 0, 0
        return best[1], best[0], best[2], len(words_of(text))


def _directory(path):
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def license_files(files: DataFrame, keep: list[str], templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``files`` has path and text. ``keep`` columns (none named like a result) with path, own_license, own_score,
    license_file, license and license_from (the directory that gave it; null for an own one)."""
    chosen = templates or TEMPLATES
    terms = frozenset(w for texts in chosen.values() for t in texts for w in words_of(t))
    matcher = Matcher(*term_counts(files, terms), chosen)
    sent = files.sparkSession.sparkContext.broadcast(matcher)  # the templates' terms only

    work = files.select(*keep, F.col("path").alias("__path"), F.col("text").alias("__text"))
    schema = work.select(*keep, "__path", F.lit(None).cast("string").alias("own_license"), F.lit(0.0).alias("own_score"), F.lit(0.0).alias("__share")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text"):
            found = [sent.value.statement(t) for t in batch.column("__text").to_pylist()]
            made = [
                pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] / f[3] if f[3] else 0.0 for f in found], pa.float64()),
            ]
            columns = [*(batch.column(c) for c in [*keep, "__path"]), *made]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "__path", "own_license", "own_score", "__share"])

    path = F.col("__path")
    stated = stored(
        work.mapInArrow(run, schema)
        .withColumn("license_file", F.coalesce(F.col("own_license").isNotNull() & (path.rlike(NAMED) | (F.col("__share") >= FILE_SHARE)), F.lit(False)))
        .withColumn("__dir", _directory(path)),
        "statements",
    )
    speaking = stated.where("license_file and __dir is not null").groupBy("__dir").agg(
        F.min(F.struct((-F.col("own_score")).alias("s"), path.alias("p"), "own_license"))["own_license"].alias("given")
    )
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    needed = stated.where("own_license is null and __dir is not null").select("__dir").distinct()
    ancestors = needed.select("__dir", F.explode(above).alias("a")).select(F.col("__dir").alias("__from"), "a.depth", F.col("a.dir").alias("__dir")).distinct()
    nearest = ancestors.join(speaking, "__dir").groupBy("__from").agg(F.max(F.struct("depth", F.col("__dir").alias("dir"), "given")).alias("n"))
    heirs = nearest.select(F.col("__from").alias("__dir"), F.col("n.given").alias("__given"), F.col("n.dir").alias("__giver"))
    own = F.col("own_license").isNotNull()
    return stated.join(heirs, "__dir", "left").select(
        *keep, path.alias("path"), "own_license", "own_score", "license_file", F.coalesce("own_license", "__given").alias("license"),
        F.when(~own, F.col("__giver")).alias("license_from"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the repository, the leading digits of the id are its directories."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.col("doc_id")
    path = F.concat_ws(
        "/", F.coalesce("source", F.lit("none")), F.floor(number / 1000).cast("string"), F.floor(number / 100).cast("string"),
        F.concat(F.coalesce(number.cast("string"), F.lit("none")), F.lit(".txt")),
    )
    return license_files(docs.select("doc_id", "text", path.alias("path")), ["doc_id"])
