"""Personal data: rules for four kinds, and a character BiLSTM with CRF transitions that adds spans beside them.

The rules read every whole text and always stay. The tagger is trained in numpy on windows of a bounded sample of
documents, labelled with the rules' spans and with rewritten spans (``(at)`` for ``@``, ``00`` for ``+``). It looks at
overlapping windows around every place where a span can be: all four kinds hold a digit or an at sign. Spans of all
windows of a text are reconciled together: sure ones first, spans cut by a window's edge last, none over another.
Spans that clash with a rule's span, or lack what defines their kind, are dropped.

``SAMPLE_DOCS`` is the documented bound of what the classifier learns from.

Defined results: null texts count as empty and have no spans; offsets are code points, ends exclusive; equal rows get
equal spans; other columns are ignored; without any window to learn from only the rules work.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 6_000
WINDOW = 64
OVERLAP = 24
MARGIN = 20
SURE = 0.95
HIDDEN = 16
STEPS = 220
BATCH = 24
SEED = 11

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PLACE = re.compile(r"[0-9@]|\(at\)|\[at\]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def rule_spans(text: str) -> list[Span]:
    """The rules' spans by kind, then start. Emails are found from their at sign, which no earlier start can move."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def plausible(kind: int, text: str) -> bool:
    """What an added span must hold to count as its kind."""
    digits = len(_digits(text))
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text)) and all(int(p) < 256 for p in text.split("."))
    if kind == 2:
        return 13 <= digits <= 19 and luhn(_digits(text)) and text[0].isdigit() and text[-1].isdigit()
    return bool(re.fullmatch(r"(?:\+|00)[0-9][ ().0-9-]+[0-9]", text)) and 9 <= digits <= 17


# Symbols: fixed characters that matter stand for themselves, the rest by kind.
_FIXED = "@.-+()[]%_ \n:/#=\"',"
SYMBOLS = len(_FIXED) + 8


def _symbol(c: str) -> int:
    at = _FIXED.find(c)
    if at >= 0:
        return at + 1
    kind = 1 if "0" <= c <= "9" else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if c.isalpha() else 5 if c.isspace() else 6
    return len(_FIXED) + kind


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows around every possible place of a span."""
    out, end, region = [], None, []
    for m in _PLACE.finditer(text):
        if end is not None and m.start() <= end + 2 * MARGIN:
            region[-1][1] = m.end()
        else:
            region.append([m.start(), m.end()])
        end = m.end()
    for low, high in region:
        low, high = max(0, low - MARGIN), min(len(text), high + MARGIN)
        spare = WINDOW - (high - low)
        if spare >= 0:
            out.append(max(0, low - spare // 2))
        else:
            out += [*range(low, high - WINDOW, WINDOW - OVERLAP), high - WINDOW]
    return out


def encode(text: str, starts: list[int]) -> np.ndarray:
    out = np.zeros((len(starts), WINDOW), dtype=np.int64)
    for i, s in enumerate(starts):
        piece = text[s : s + WINDOW]
        out[i, : len(piece)] = [_symbol(c) for c in piece]
    return out


def tag(spans: list[Span], start: int) -> np.ndarray:
    """0 outside, 1 + 2k where a span of kind k begins, 2 + 2k inside it; a later kind yields to an earlier one."""
    out = np.zeros(WINDOW, dtype=np.int64)
    for kind, s, e in sorted(spans, reverse=True):
        b, f = max(s - start, 0), min(e - start, WINDOW)
        if b < f:
            out[b:f] = 2 + 2 * kind
            if s >= start:
                out[b] = 1 + 2 * kind
    return out


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions. All arrays are (time, batch, feature)."""

    TAGS = 1 + 2 * len(KINDS)

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            rng = np.random.default_rng(SEED)
            size = 12
            normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
            weights = {"E": normal(SYMBOLS, size) * np.sqrt(SYMBOLS) * 0.3, "W": normal(2 * HIDDEN, self.TAGS), "c": np.zeros(self.TAGS), "A": np.zeros((self.TAGS, self.TAGS))}
            for d in "fb":
                weights |= {f"X{d}": normal(size, 4 * HIDDEN), f"H{d}": normal(HIDDEN, 4 * HIDDEN), f"d{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        self.w = weights

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        h = c = np.zeros((x.shape[1], HIDDEN))
        drive = x @ self.w[f"X{d}"] + self.w[f"d{d}"]
        out, memory = np.empty((len(x), x.shape[1], HIDDEN)), []
        for t in range(len(x)):
            z = drive[t] + h @ self.w[f"H{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            previous, before = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[t] = h
            memory.append((i, f, o, g, previous, th, before))
        return out, memory

    def _lstm_back(self, x: np.ndarray, d: str, memory: list, grad: np.ndarray, into: dict) -> np.ndarray:
        dz = np.empty((len(x), x.shape[1], 4 * HIDDEN))
        dh = dc = np.zeros((x.shape[1], HIDDEN))
        for t in reversed(range(len(x))):
            i, f, o, g, previous, th, _ = memory[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - th * th)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * previous * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dc = dc * f
            dh = dz[t] @ self.w[f"H{d}"].T
        into[f"X{d}"] = np.einsum("tbe,tbg->eg", x, dz)
        into[f"H{d}"] = np.einsum("tbe,tbg->eg", np.stack([m[6] for m in memory]), dz)
        into[f"d{d}"] = dz.sum((0, 1))
        return dz @ self.w[f"X{d}"].T

    def _forward(self, symbols: np.ndarray):
        x = self.w["E"][symbols.T]
        forward, memory_f = self._lstm(x, "f")
        backward, memory_b = self._lstm(x[::-1], "b")
        h = np.concatenate([forward, backward[::-1]], axis=2)
        return x, h, memory_f, memory_b, h @ self.w["W"] + self.w["c"]

    def _chances(self, score: np.ndarray):
        """Log-partition and the marginals of tags and of neighbouring tags (summed over the time)."""
        t_max, a = len(score), self.w["A"]
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        alpha[0] = score[0]
        total = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        for t in range(1, t_max):
            alpha[t] = score[t] + total(alpha[t - 1][:, :, None] + a, 1)
        for t in reversed(range(t_max - 1)):
            beta[t] = total(a + (score[t + 1] + beta[t + 1])[:, None, :], 2)
        z = total(alpha[-1], 1)
        single = np.exp(alpha + beta - z[None, :, None])
        pair = np.exp(alpha[:-1][:, :, :, None] + a + (score[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum(0)
        return z, single, pair

    def gradient(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a batch and its gradient."""
        x, h, memory_f, memory_b, score = self._forward(symbols)
        z, single, pair = self._chances(score)
        n, gold = len(symbols), tags.T
        right = np.take_along_axis(score, gold[:, :, None], 2).sum() + self.w["A"][gold[:-1], gold[1:]].sum()
        d_score = single.copy()
        np.put_along_axis(d_score, gold[:, :, None], np.take_along_axis(d_score, gold[:, :, None], 2) - 1, 2)
        d_score /= n
        d_a = pair.sum(0)
        np.subtract.at(d_a, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        out = {"A": d_a / n, "W": np.einsum("tbh,tbk->hk", h, d_score), "c": d_score.sum((0, 1))}
        d_h = d_score @ self.w["W"].T
        d_x = self._lstm_back(x, "f", memory_f, d_h[:, :, :HIDDEN], out)
        d_x += self._lstm_back(x[::-1], "b", memory_b, d_h[::-1, :, HIDDEN:], out)[::-1]
        out["E"] = np.zeros_like(self.w["E"])
        np.add.at(out["E"], symbols.T.ravel(), d_x.reshape(-1, d_x.shape[2]))
        return float(z.sum() - right) / n, out

    def fit(self, symbols: np.ndarray, tags: np.ndarray, steps: int = STEPS) -> list[float]:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(symbols), BATCH)
            loss, grad = self.gradient(symbols[pick], tags[pick])
            losses.append(loss)
            rate = 0.03 * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in grad.items():
                g = np.clip(g, -5, 5)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def decode(self, symbols: np.ndarray) -> list[list[tuple[Span, float]]]:
        """Best legal tag path of every window as spans, with the smallest marginal along the span."""
        *_, score = self._forward(symbols)
        _, single, _ = self._chances(score)
        legal = np.full((self.TAGS, self.TAGS), -1e9)
        for k in range(self.TAGS):
            legal[k, 0] = 0
            legal[k, 1::2] = 0
            if k:
                legal[k, k + k % 2] = 0  # a beginning or an inside may be followed by its own inside
        # An inside tag may open a window: its beginning is in the window before.
        best, back = score[0], []
        for t in range(1, len(score)):
            move = best[:, :, None] + self.w["A"] + legal
            back.append(move.argmax(1))
            best = move.max(1) + score[t]
        path = [best.argmax(1)]
        for b in reversed(back):
            path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
        tags = np.stack(path[::-1], axis=1)
        out = []
        for n, row in enumerate(tags.tolist()):
            spans, at = [], 0
            while at < len(row):
                if row[at] == 0:
                    at += 1
                    continue
                kind, end = (row[at] - 1) // 2, at + 1
                while end < len(row) and row[end] == 2 + 2 * kind:
                    end += 1
                spans.append(((kind, at, end), float(min(single[t, n, row[t]] for t in range(at, end)))))
                at = end
            out.append(spans)
        return out


def reconcile(text: str, starts: list[int], found: list[list[tuple[Span, float]]], fixed: list[Span]) -> list[Span]:
    """Added spans of one text from the spans of all its windows."""
    offered: dict[Span, float] = {}
    for s, spans in zip(starts, found, strict=True):
        for (kind, b, e), sure in spans:
            cut = (b == 0 and s > 0) or (e == WINDOW and s + WINDOW < len(text))
            span = (kind, s + b, min(s + e, len(text)))
            offered[span] = max(offered.get(span, 0.0), sure * (0.5 if cut else 1.0))
    taken = [(b, e) for _, b, e in fixed]
    out = []
    for span, sure in sorted(offered.items(), key=lambda x: (-x[1], x[0][1] - x[0][2], x[0])):
        kind, b, e = span
        if sure >= SURE and b < e and all(e <= x or b >= y for x, y in taken) and plausible(kind, text[b:e]):
            out.append(span)
            taken.append((b, e))
    return out


def _rewrite(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text with its spans written in another way, and where they are then."""
    out, at, moved = [], 0, []
    size = 0
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        if s < at:
            continue
        piece = text[s:e]
        piece = piece.replace("@", "(at)") if kind == 0 else "00" + piece[1:] if kind == 3 else piece
        out += [text[at:s], piece]
        size += s - at
        moved.append((kind, size, size + len(piece)))
        size += len(piece)
        at = e
    return "".join([*out, text[at:]]), moved


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """Weights learned from about ``sample_docs`` documents chosen by hash (empty if they hold no window)."""
    rows = docs.where("text is not null").select("text")
    n = rows.count()
    order = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "text"), 11)
    sample = rows.where((order < min(1.0, sample_docs / max(n, 1)) * float(1 << 53)) & F.col("text").rlike("[0-9@]"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            symbols, tags = [], []
            for text in batch.column("text").to_pylist():
                spans = rule_spans(text)
                versions = [(text, spans)] + ([_rewrite(text, spans)] if any(k in (0, 3) for k, _, _ in spans) else [])
                for t, own in versions:
                    for s in windows_of(t)[:40]:
                        symbols.append(encode(t, [s])[0].astype(np.uint8).tobytes())
                        tags.append(tag(own, s).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.binary()), pa.array(tags, pa.binary())], names=["symbols", "tags"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["symbols", "tags"])
        arrays = [np.stack([np.frombuffer(x, np.uint8) for x in part[c]]).astype(np.int64) for c in ("symbols", "tags")]
        model = Tagger()
        model.fit(*arrays)
        return pd.DataFrame({"weights": [pickle.dumps(model.w)]})

    windows = sample.mapInArrow(cut, "symbols binary, tags binary")
    fitted = windows.groupBy(F.lit(0).alias("one")).applyInPandas(fit, "weights binary").collect()
    return bytes(fitted[0]["weights"]) if fitted else b""


def find(docs: DataFrame, weights: bytes, keep: list[str]) -> DataFrame:
    """``keep`` columns (none named like a result) with ``base`` and ``spans``: arrays of kind:start:end, by kind and start."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # a few thousand numbers
    work = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = work.select(*keep, F.array(F.lit("")).alias("base"), F.array(F.lit("")).alias("spans")).schema
    write = lambda spans: [f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger(pickle.loads(sent.value)) if sent.value else None
        for batch in small_batches(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ruled = [rule_spans(t) for t in texts]
            starts = [windows_of(t) for t in texts]
            added: list[list[Span]] = [[] for _ in texts]
            flat = [(i, s) for i, own in enumerate(starts) for s in own]
            found: list = []
            for at in range(0, len(flat) if model else 0, 512):
                part = flat[at : at + 512]
                found += model.decode(np.concatenate([encode(texts[i], [s]) for i, s in part]))
            at = 0
            for i, own in enumerate(starts):
                if found and own:
                    added[i] = reconcile(texts[i], own, found[at : at + len(own)], ruled[i])
                at += len(own)
            made = [pa.array([write(r) for r in ruled], pa.list_(pa.string())), pa.array([write(r + a) for r, a in zip(ruled, added, strict=True)], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "base", "spans"])

    return work.mapInArrow(run, schema)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, train(docs), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans")
    )
