"""Spelling variants by finite-state composition.

Words are near if they differ by one inserted, deleted or replaced code point: the pairs that the vocabulary's acceptor
composed with a one-edit transducer and with the acceptor again accepts. The composed machine is enumerated in partitions.
Take ``m``, the shorter word's length, and a window of positions: pairs whose first difference lies in the window share
all code points before and after it, so the state that reading the shared ones leads to is the initial state of a
partition, which holds the words of ``m`` and ``m + 1`` code points that agree outside the window. A task builds the
minimised acceptor of the parts inside the window and walks it from there, before the edit as one state and after it as a
pair of states. Each pair has one first difference and so comes from one partition only.

Windows are quarters of a word at first. A partition of more than ``WORDS_AT_ONCE`` words is not walked but dealt again
with halved windows, until a window is one position, which bounds it by the alphabet; a task's memory is bounded so.

Defined results: null texts hold no words; a null id is written as an empty string; equal rows count apart; a vocabulary
without near pairs has only null forms; other columns are ignored; an empty table gives no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, stored, table

LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, ONE_IN, TIMES = 7, 2, 31, 10
WINDOWS = 4
WORDS_AT_ONCE = 4096
OPEN = "word string, n bigint, m int, a int, b int"
FOUND = "word string, near string, near_n bigint, n bigint, m int, a int, b int"


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """``word, n``: lower-cased runs of letters, one code point deleted where ``one_in`` divides the hash of id and run."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.col("h") % F.length("run")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = low.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """The minimised acyclic acceptor of sorted distinct strings: ``arcs[state]`` by letter, ``final[state]``, ``root``."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""

        def close(depth: int) -> None:
            """Give the states of ``last`` below ``depth`` their numbers; equal states are one."""
            while len(path) - 1 > depth:
                (final,), arcs = path.pop()
                key = (final, *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                path[-1][1][last[len(path) - 1]] = state

        for word in words:
            same = 0
            for x, y in zip(word, last, strict=False):
                if x != y:
                    break
                same += 1
            close(same)
            path.extend(([False], {}) for _ in range(len(word) - same))
            path[-1][0][0] = True
            last = word
        close(0)
        self.root = len(self.arcs)
        self.arcs.append(path[0][1])
        self.final.append(path[0][0][0])

    def shared(self, x: int, y: int) -> Iterator[str]:
        """Strings that lead from both states to acceptance: the composed machine after its edit."""
        todo = [(x, y, "")]
        while todo:
            x, y, text = todo.pop()
            if self.final[x] and self.final[y]:
                yield text
            other = self.arcs[y]
            todo.extend((state, other[c], text + c) for c, state in self.arcs[x].items() if c in other)

    def near(self, length: int, last_window: bool) -> Iterator[tuple[str, str]]:
        """Accepted pairs of one edit: equal lengths ``length``, or ``length`` and one more; the first difference lies
        before position ``length``, or also at it in the last window."""
        todo = [(self.root, "")]
        while todo:
            state, head = todo.pop()
            arcs = self.arcs[state]
            if len(head) < length:
                todo.extend((after, head + c) for c, after in arcs.items())
                for (c, x), (d, y) in combinations(arcs.items(), 2):
                    for tail in self.shared(x, y):
                        if len(head) + 1 + len(tail) == length:
                            yield head + c + tail, head + d + tail
            if len(head) < length or last_window:
                for c, after in arcs.items():
                    for tail in self.shared(state, after):
                        if tail[:1] != c:
                            yield head + tail, head + c + tail


def near_in(members: list[tuple[str, int]], m: int, a: int, b: int) -> list[tuple[str, int, str, int]]:
    """Near words among (word, n) that agree outside the window ``a..b``, once each."""
    inside = {word[a : len(word) - (m - b)]: (word, n) for word, n in members}
    if len(inside) < 2:
        return []
    return [(*inside[u], *inside[v]) for u, v in Acceptor(sorted(inside)).near(b - a, b == m)]


def _halves(a: int, b: int) -> list[tuple[int, int]]:
    return [(a, (a + b) // 2), ((a + b) // 2, b)]


def _key(word: Column, m: Column, a: Column, b: Column) -> Column:
    """Hash of what the words of a partition share; tasks compare the code points themselves."""
    return F.xxhash64(m, a, b, word.substr(F.lit(1), a), word.substr(F.length(word) - (m - b) + 1, F.length(word)))


def _windows(words: DataFrame, least_length: int) -> DataFrame:
    size = F.length("word")
    shorter = F.filter(F.array(size, size - 1), lambda m: m >= least_length)
    quarter = lambda m, k: F.floor(m * k / WINDOWS).cast("int")
    places = F.flatten(
        F.transform(shorter, lambda m: F.array(*(F.struct(m.alias("m"), quarter(m, k).alias("a"), quarter(m, k + 1).alias("b")) for k in range(WINDOWS))))
    )
    return words.select("word", "n", F.inline(places)).where(F.col("a") < F.col("b"))


def _walk(rows: DataFrame, words_at_once: int) -> DataFrame:
    """Near pairs of the partitions, and the rows of too large ones with halved windows (``near`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: dict[tuple, list[tuple[str, int]] | None] = {}  # partitions of the current key; None: dealt again
        current = None

        def close() -> None:
            for (m, a, b, _, _), members in held.items():
                for u, n, v, k in near_in(members, m, a, b) if members else ():
                    out.extend(((u, v, k, n, m, a, b), (v, u, n, k, m, a, b)))
            held.clear()

        def again(word: str, n: int, m: int, a: int, b: int) -> None:
            out.extend((word, None, None, n, m, *half) for half in _halves(a, b))

        def add(word: str, n: int, m: int, a: int, b: int) -> None:
            place = (m, a, b, word[:a], word[len(word) - (m - b) :])
            members = held.setdefault(place, [])
            if members is None:
                again(word, n, m, a, b)
                return
            members.append((word, n))
            if len(members) > words_at_once and b - a > 1:
                for w, k in members:
                    again(w, k, m, a, b)
                held[place] = None

        def packed() -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "near", "near_n", "n", "m", "a", "b"])

        for batch in batches:
            keys = batch.column("key").to_numpy()
            if not len(keys):
                continue
            change = np.concatenate([[True], keys[1:] != keys[:-1]])
            # Words alone in their partition have no near word in it; those at the batch's edges may go on in another batch.
            alone = change & np.concatenate([change[1:], [False]])
            alone[0] = False
            wanted = np.flatnonzero(~alone)
            part = batch.take(pa.array(wanted))
            for key, *row in zip(keys[wanted].tolist(), *(part.column(c).to_pylist() for c in ("word", "n", "m", "a", "b")), strict=True):
                if key != current:
                    close()
                    current = key
                add(*row)
                if len(out) >= 50_000:
                    yield packed()
                    out.clear()
        close()
        yield packed()

    keyed = rows.select(_key(F.col("word"), F.col("m"), F.col("a"), F.col("b")).alias("key"), "word", "n", "m", "a", "b")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """``word, n, near, near_n``: both directions of each near pair of distinct words of at least ``least_length``."""
    rows, found = _windows(words, least_length), None
    while True:
        walked = stored(_walk(rows, words_at_once), "spelling")
        pairs = walked.where(F.col("near").isNotNull()).select("word", "n", "near", "near_n")
        found = pairs if found is None else found.unionByName(pairs)
        rows = walked.where(F.col("near").isNull()).select("word", "n", "m", "a", "b")
        if rows.isEmpty():
            return found


def group_variants(words: DataFrame, least_length: int = LEAST_LENGTH, times: int = TIMES, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words with counts ``n``."""
    words = cut(words)
    best = (
        near_words(words, least_length, words_at_once).groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    )
    fits = -F.col("best.less") >= F.col("n") * times
    formed = cut(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # Each form occurs ``times`` as often as the word before it, which bounds the steps to the last; a round doubles them.
    most = formed.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    steps, spanned = 0, 1
    while times > 1 and most >= times:
        steps, most = steps + 1, most // times
    while spanned < steps:
        roots = cut(roots)
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        spanned *= 2
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE = f"""
WITH RECURSIVE bits AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
runs AS (
    SELECT DISTINCT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
spelt AS (
    SELECT run, times, flatten([CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]) AS bytes
    FROM runs WHERE length(run) >= {LEAST_LENGTH}),
hashed AS (
    SELECT run, times, xor(list_reduce(list_prepend(4294967295, [CAST(x AS BIGINT) FOR x IN bytes]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
    FROM spelt, bits),
words AS MATERIALIZED (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
        SELECT times, CASE WHEN h % {ONE_IN} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 : length(run)] ELSE run END AS word FROM hashed)
    WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
holes AS MATERIALIZED (
    SELECT word, n, word[1 : i] AS head, word[i + 2 : length(word)] AS tail, word[1 : i] || word[i + 2 : length(word)] AS shorter
    FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
pairs AS MATERIALIZED (
    SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT a.word, w.word, w.n FROM holes a JOIN words w ON a.shorter = w.word
    UNION SELECT w.word, a.word, a.n FROM holes a JOIN words w ON a.shorter = w.word),
best AS (
    SELECT word, CAST(count(*) OVER (PARTITION BY word) AS BIGINT) AS n_near, near, near_n FROM pairs
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
formed AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * n THEN near END AS form, CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n
    FROM words LEFT JOIN best USING (word)),
walk AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL),
roots AS (SELECT walk.word, walk.root FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
