"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by a filter's width and cover the whole text (the
last one ends where the text ends). Filters learned over WIDTH bytes each give their largest response in a chunk; with
the chunk's share of distinct byte 8-grams they feed a hidden layer, whose units are max-pooled over all chunks and
combined into one probability. Parameters are fitted by Adam on the driver from a bounded sample of labelled documents
(labels.py), on up to CHUNKS random chunks of a document at a time; scoring reads every chunk.

Defined cases: null text counts as empty and is scored as one chunk of padding. Without labels of both kinds all scores
are the share of label 1 (0.5 if there are none). Null doc_ids are scored; held_out is null for them. Rows that repeat
a doc_id are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import odd
from tickloom.llm.labels import MOST, remainder, sample, sigmoid
from tickloom.llm.toxicity import scored

CHUNK, WIDTH, FILTERS, HIDDEN, CHUNKS = 512, 6, 16, 8, 6
GRAM = 8


def starts(n: int) -> np.ndarray:
    """Where the chunks of a text of n bytes begin."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    at = np.arange(0, n - CHUNK, CHUNK - WIDTH + 1)
    return np.append(at, n - CHUNK)


def cut(texts: list[bytes], pick=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks (zero-padded), the bytes that each has, and the text that each is of."""
    chosen = [starts(len(t)) if pick is None else pick(starts(len(t))) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in chosen])
    padded = [t if len(t) >= CHUNK else t.ljust(CHUNK, b"\0") for t in texts]
    data = np.frombuffer(b"".join(padded), np.uint8)
    size = np.array([len(t) for t in padded], np.int64)
    first = np.concatenate(chosen) + (np.cumsum(size) - size)[owner]
    have = np.minimum(np.array([len(t) for t in texts], np.int64), CHUNK)[owner]
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[first], have, owner


def novelty(x: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Of each chunk, the share of its byte 8-grams that are different."""
    h = np.zeros((len(x), CHUNK - GRAM + 1), np.uint64)
    base = odd(5)
    for i in range(GRAM):
        h = h * base + x[:, i : i + h.shape[1]].astype(np.uint64) + np.uint64(1)
    n = np.maximum(have - GRAM + 1, 1)
    h[np.arange(h.shape[1])[None, :] >= n[:, None]] = h[:, :1].repeat(h.shape[1], 1)[np.arange(h.shape[1])[None, :] >= n[:, None]]
    h.sort(axis=1)
    return (1 + (h[:, 1:] != h[:, :-1]).sum(axis=1)) / n


def responses(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Responses of the filters at every place of the chunks: (chunks, places, filters)."""
    n = CHUNK - WIDTH + 1
    out = np.take(table[0], x[:, :n], axis=0)
    for k in range(1, WIDTH):
        out += np.take(table[k], x[:, k : k + n], axis=0)
    return out


class Network:
    def __init__(self, rows: list[tuple[str, int]], steps: int = 700, batch: int = 48, rate: float = 0.01, seed: int = 7):
        self.share = sum(y for _, y in rows) / len(rows) if rows else 0.5
        self.fitted = bool(rows) and 0 < self.share < 1
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.a = rng.normal(0, 0.4, (FILTERS + 1, HIDDEN)).astype(np.float32)
        self.b, self.w, self.c = np.zeros(HIDDEN, np.float32), rng.normal(0, 0.4, HIDDEN).astype(np.float32), np.zeros(1, np.float32)
        if self.fitted:
            self.fit([(t.encode(), y) for t, y in rows], steps, batch, rate, rng)

    def fit(self, rows: list[tuple[bytes, int]], steps: int, batch: int, rate: float, rng: np.random.Generator) -> None:
        params = [self.table, self.a, self.b, self.w, self.c]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        kinds = [np.array([i for i, (_, y) in enumerate(rows) if y == k]) for k in (0, 1)]
        half = batch // 2

        def pick(s: np.ndarray) -> np.ndarray:
            return s if len(s) <= CHUNKS else rng.choice(s, CHUNKS, replace=False)

        for step in range(1, steps + 1):
            which = np.concatenate([rng.choice(kinds[0], half), rng.choice(kinds[1], half)])
            y = np.repeat(np.array([0, 1], np.float32), half)
            x, have, owner = cut([rows[i][0] for i in which], pick)
            gradients = self.gradients(x, have, owner, y)
            decay = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for q, g, mm, vv in zip(params, gradients, m, v, strict=True):
                g = g + 1e-5 * q
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                q -= decay * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-7)
        # Batches have as many rows of either kind; the intercept takes up the odds that the kinds really have.
        self.c += np.float32(np.log(self.share / (1 - self.share)))

    def gradients(self, x: np.ndarray, have: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the mean cross-entropy of texts, given as chunks, by table, a, b, w and c. Of equal maxima the first counts."""
        r = responses(x, self.table)
        place = r.argmax(axis=1)
        top = np.take_along_axis(r, place[:, None, :], 1)[:, 0]
        u = np.hstack([np.maximum(top, 0), novelty(x, have)[:, None]]).astype(self.a.dtype)
        z = np.maximum(u @ self.a + self.b, 0)
        edge = np.flatnonzero(np.diff(owner, prepend=-1))
        pooled = np.maximum.reduceat(z, edge)
        p = sigmoid(pooled @ self.w + self.c)
        d = ((p - y) / len(y)).astype(self.w.dtype)
        gw, gc = pooled.T @ d, d.sum(keepdims=True)
        gp = d[:, None] * self.w
        hit = (z == pooled[owner]) & (z > 0)
        first = np.maximum.reduceat(np.where(hit, -np.arange(len(z))[:, None], -(1 << 30)), edge)
        only = hit & (-np.arange(len(z))[:, None] == first[owner])
        gz = np.where(only, gp[owner], 0)
        ga, gb, gu = u.T @ gz, gz.sum(axis=0), gz @ self.a.T
        gt = np.zeros_like(self.table)
        gtop = np.where(top > 0, gu[:, :FILTERS], 0)
        f = np.broadcast_to(np.arange(FILTERS), place.shape)
        rows_ = np.arange(len(x))[:, None]
        for k in range(WIDTH):
            np.add.at(gt[k], (x[rows_, place + k], f), gtop)
        return gt, ga, gb, gw, gc

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.share)
        raw = [t.encode() for t in texts]
        out = np.zeros((len(texts), HIDDEN), np.float32)
        at = 0
        while at < len(raw):  # about a megabyte at a time
            stop, held = at, 0
            while stop < len(raw) and (held < 1 << 20):
                held += len(raw[stop])
                stop += 1
            x, have, owner = cut(raw[at:stop])
            for k in range(0, len(x), 64):
                part = x[k : k + 64]
                top = responses(part, self.table).max(axis=1)
                u = np.hstack([np.maximum(top, 0), novelty(part, have[k : k + 64])[:, None]]).astype(np.float32)
                np.maximum.at(out, at + owner[k : k + 64], np.maximum(u @ self.a + self.b, 0))
            at = stop
        return sigmoid(out @ self.w + self.c)


def quality(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, text: str = "text", doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels are learned only where crc32 mod fold isn't held."""
    learn: Column = remainder(F.col("doc_id"), fold) != held
    model = Network(sample(docs, labels, "quality", learn, text, doc_id, most))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    result = scored(rows, model)
    return result.select("doc_id", (remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
