"""Language identification by cross-parsing entropy.

For every language a bounded sample of its labelled texts becomes a suffix automaton. A text is cut greedily into
the longest phrases that occur in the sample; the number of phrases times the logarithm of the sample's length, per
letter, estimates the cross entropy, and the language with the smallest value wins (ties: the smaller name).

Phrases stay inside words (letters between word marks), so the phrase count of a text is a sum over its words and a
task parses each distinct word once.

``SAMPLE_BYTES`` is the documented bound of the classifier: bytes of labelled text per language, chosen by hash order
from all labelled rows. Texts are always read whole.

Defined results: null texts and texts without a letter give ``und`` and score 0, as does any text when nothing was
learned; rows with a null ``lang`` or text teach nothing; equal rows get equal answers; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import held_out, small_batches

SAMPLE_BYTES = 160_000
#: Words remembered per task before the memory is emptied (a speed bound, never a bound on what is parsed).
REMEMBERED = 300_000
REMEMBERED_LENGTH = 40
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def build_automaton(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton of all ``_word_``: keys ``state << 21 | code point`` and target states."""
    step: list[dict[str, int]] = [{}]
    link, length = [-1], [0]

    def clone(p: int, c: str, q: int) -> int:
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        new = len(step) - 1
        link[q] = new
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    for word in words:
        last = 0
        for c in f"_{word}_":
            known = step[last].get(c)
            if known is not None:  # another word has been here: no new state unless the lengths differ
                last = known if length[known] == length[last] + 1 else clone(last, c, known)
                continue
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            new, p = len(step) - 1, last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else clone(p, c, q)
            last = new
    pairs = [(state << 21 | ord(c), target) for state, out in enumerate(step) for c, target in out.items()]
    keys, targets = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    return keys, targets.astype(np.int32)


def count_phrases(word: str, step: dict[int, int]) -> int:
    """Greedy longest phrases of ``_word_``; a character the sample lacks is a phrase of its own."""
    phrases, state = 0, 0
    for c in f"_{word}_":
        code = ord(c)
        after = step.get(state << 21 | code)
        if after is None:
            phrases += state != 0
            after = step.get(code)
            if after is None:
                phrases += 1
                after = 0
        state = after
    return phrases + (state != 0)


def learn(docs: DataFrame, labelled: Column, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int, bytes, bytes]]:
    """(language, letters in the sample, transition keys, targets) of every language among the labelled rows."""
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    order = F.xxhash64("text")
    share = F.least(F.lit(1.0), F.lit(3.0 * sample_bytes) / F.greatest(F.col("bytes"), F.lit(1)))
    near = (
        rows.withColumn("order", order)
        .join(F.broadcast(sizes), "lang")
        .where(F.shiftrightunsigned("order", 11) < share * float(1 << 53))
        .drop("bytes")
    )

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "text"])
        size, words = 0, {}
        for text in part["text"]:
            if size >= sample_bytes:
                break
            size += len(text.encode("utf-8", "surrogatepass"))
            words.update(dict.fromkeys(words_of(text)))
        keys, targets = build_automaton(list(words))
        letters = sum(len(w) + 2 for w in words)
        return pd.DataFrame({"lang": [key[0]], "letters": [letters], "keys": [keys.tobytes()], "targets": [targets.tobytes()]})

    fitted = near.groupBy("lang").applyInPandas(fit, "lang string, letters long, keys binary, targets binary").collect()
    return sorted((r["lang"], r["letters"], bytes(r["keys"]), bytes(r["targets"])) for r in fitted if r["letters"])


class Parser:
    """Phrase counts of words for all languages at once."""

    def __init__(self, learned: list[tuple[str, int, bytes, bytes]]):
        self.languages = [x[0] for x in learned]
        self.steps = [dict(zip(np.frombuffer(k, np.int64).tolist(), np.frombuffer(t, np.int32).tolist(), strict=True)) for _, _, k, t in learned]
        self.cost = np.array([math.log2(x[1] + 2) for x in learned])
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.counts = np.zeros((1024, len(self.languages)), dtype=np.int32)

    def _new(self, word: str) -> int:
        at = self.seen[word] = len(self.seen)
        if at == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[at] = [count_phrases(word, s) for s in self.steps]
        return at

    def classify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        words = words_of(text)
        if not words:
            return UNKNOWN, 0.0
        if len(self.seen) > REMEMBERED:
            self.forget()
        total = np.zeros(len(self.languages), dtype=np.int64)
        known, get = [], self.seen.get
        for word in words:
            at = get(word)
            if at is None:
                if len(word) > REMEMBERED_LENGTH:
                    total += [count_phrases(word, s) for s in self.steps]
                    continue
                at = self._new(word)
            known.append(at)
        total += self.counts[known].sum(axis=0, dtype=np.int64) if known else 0
        value = total * self.cost
        order = np.argsort(value, kind="stable")
        best = value[order[0]]
        second = value[order[1]] if len(order) > 1 else np.inf
        return self.languages[order[0]], 1.0 if np.isinf(second) else float(second / (best + second))


def classify(docs: DataFrame, learned: list[tuple[str, int, bytes, bytes]]) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)  # bounded by SAMPLE_BYTES per language
    frame = docs.drop("lang_pred", "score")
    schema = frame.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(sent.value)
        for batch in small_batches(batches, "text"):
            found = [parser.classify(t) for t in batch.column("text").to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score"])

    return frame.mapInArrow(run, schema)


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = learn(docs.select("doc_id", "lang", "text"), ~held_out(F.col("doc_id"), 4))
    return classify(docs.select("doc_id", "text"), learned).select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")
