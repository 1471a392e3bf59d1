"""Mixing to target weights with soft membership.

A classifier fitted on the table of labels gives each document a posterior over domains. Domains are the classes of
that table: bit d is a label column, so `quality` and `toxic` make four. Nonnegative rates r of the documents are then
fitted so that the expected tokens of each domain, sum of r * tokens * posterior, come to the targets:

    minimise  sum_d (E_d(r) - target_d)**2 / share_d  +  pull * sum_i tokens_i * (r_i - 1)**2,   r >= 0

(in shares of all tokens; share_d is what a domain has at first)
by projected gradient steps with momentum, until they no longer move. The gradient of a document needs only the residuals of the domains, so a step is one
distributed sum of a few numbers; a document's rate follows from the residuals of all steps so far, which are sent out
(steps * domains numbers), and no state is kept between steps. The pull makes the solution unique and keeps rates near
one where the targets allow. Rows are summed by partition first, so a source with a third of all rows adds no skew.

The classifier is a logistic regression for each label, over statistics of whole texts' bytes and their hits of words
that tell the label's classes apart, fitted on a bounded sample (labels.py). Defined cases: null text counts as empty and has no tokens; documents without tokens keep
rate 1. Without labels of both kinds a label's posterior is its share. A domain that no document belongs to cannot be
filled; its target is missed and the others are met as far as they can be. Null doc_ids get rates like any others.
Resampled rows of one doc_id and text are rounded alike, those of other texts by themselves.
An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import LOWER, Scratch, WordHash, batches, fresh, released, utf8, word_hashes
from tickloom.llm.labels import MOST, logistic, sample, sigmoid

SHAPES = 6
SEED = 21


def shapes(texts: list[bytes], h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A few shares of each text's bytes and words; h: the words' hashes."""
    owner = np.repeat(np.arange(len(texts)), counts)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    out = np.zeros((len(texts), SHAPES))
    out[:, 0] = np.bincount(owner, again, len(texts)) / np.maximum(counts, 1)
    for i, t in enumerate(texts):
        if t:
            n = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
            upper, lower = n[65:91].sum(), n[97:123].sum()
            out[i, 1:] = upper / max(1, upper + lower), (n[33:48].sum() - n[44] - n[46] + n[124]) / len(t), n[128:].sum() / len(t), n[10] / len(t), np.log1p(counts[i]) / 10
    return out


def hashed(texts: list[bytes], hasher: WordHash) -> tuple[np.ndarray, np.ndarray]:
    (h,), counts = word_hashes([t.translate(LOWER) for t in texts], [hasher])
    return h, counts


class Label:
    """The probability of a label: a logistic regression over shapes and the hits of telling words on either side."""

    def __init__(self, rows: list[tuple[str, int]], strong: float = 30.0, most_words: int = 4096):
        y = np.array([v for _, v in rows], float)
        self.share, self.weights = float(y.mean()) if len(y) else 0.5, None
        if not len(y) or not 0 < self.share < 1:
            return
        texts = [t.encode() for t, _ in rows]
        h, counts = hashed(texts, WordHash(SEED))
        owner = np.repeat(np.arange(len(texts)), counts)
        by = np.lexsort((owner, h))
        new = np.ones(len(by), bool)
        new[1:] = (h[by][1:] != h[by][:-1]) | (owner[by][1:] != owner[by][:-1])
        words, which = np.unique(h[by][new], return_inverse=True)
        n = np.bincount(which).astype(float)
        n1 = np.bincount(which, y[owner[by][new]])
        n0 = n - n1
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(n1 > 0, n1 * np.log(n1 / (n * self.share)), 0) + np.where(n0 > 0, n0 * np.log(n0 / (n * (1 - self.share))), 0))
        top = np.argsort(-ratio, kind="stable")[:most_words]
        top = np.sort(top[ratio[top] >= strong])
        self.words, self.side = words[top], (n1[top] / n[top] > self.share).astype(np.int64)
        x = self.features(texts, h, counts)
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.weights = logistic((x - self.center) / self.scale, y)

    def features(self, texts: list[bytes], h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(texts)), counts)
        hits = np.zeros((len(texts), 2))
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            hits = np.bincount(2 * owner[hit] + self.side[at[hit]], minlength=2 * len(texts)).reshape(-1, 2)
        return np.hstack([shapes(texts, h, counts), np.log1p(hits), np.log1p(100 * hits / np.maximum(counts, 1)[:, None])])

    def __call__(self, texts: list[bytes], h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        return sigmoid((self.features(texts, h, counts) - self.center) / self.scale @ self.weights[:-1] + self.weights[-1])


class Domains:
    """Posteriors of the joint classes of some labels, taken as independent given the text."""

    def __init__(self, samples: list[list[tuple[str, int]]]):
        self.labels = [Label(rows) for rows in samples]

    def __call__(self, texts: list[bytes], hasher: WordHash) -> tuple[np.ndarray, np.ndarray]:
        """(texts, domains) posteriors, domain d having bit k for label k; and the texts' tokens."""
        h, counts = hashed(texts, hasher)
        out = np.ones((len(texts), 1))
        for label in self.labels:
            p = label(texts, h, counts)[:, None]
            out = np.hstack([out * (1 - p), out * p])  # a later label is a higher bit
        return out, counts


def posteriors(docs: DataFrame, model: Domains, text: str, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """The chosen columns of docs with tokens (words) and the posteriors, under the names given."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    own = fresh("text_read", docs)
    rows = docs.select(*columns, F.col(text).alias(own))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(SEED)
        for b in batches(it, own, 1 << 20):
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                p, n = sent.value(utf8(s.column(own)), hasher)
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in columns), pa.array(n.astype(np.int64)), pa.array(list(p))], names=[*columns, *names])

    kind = T.StructType([*docs.select(*columns).schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(released(run), kind)


def momentum(step: int, pull: float) -> float:
    """The share of a step's move that the next one is begun with."""
    root = (pull / (1.0 + pull)) ** 0.5
    return min((step - 1) / (step + 2), (1 - root) / (1 + root)) if step > 1 else 0.0


def rates(tokens: np.ndarray, p: np.ndarray, residuals: np.ndarray, rate: float, pull: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps whose residuals over shares are given; and the point that the next step starts from."""
    r = y = np.ones(len(tokens))
    for k, u in enumerate(residuals, 1):
        before, r = r, np.maximum(0.0, y + rate * (p @ u - pull * (y - 1)))
        y = r + momentum(k, pull) * (r - before)
    none = tokens == 0
    return np.where(none, 1.0, r), np.where(none, 1.0, y)


def matrix(b: pa.RecordBatch, column: str, domains: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def expected(rows: DataFrame, names: tuple[str, str], residuals: np.ndarray, domains: int, rate: float, pull: float) -> np.ndarray:
    """Expected tokens of each domain (first row) at the rates that follow from the residuals, and (second) at the next start."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * domains)
        for b in it:
            n, p = b.column(names[0]).to_numpy(), matrix(b, names[1], domains)
            total += np.concatenate([(x * n) @ p for x in rates(n, p, residuals, rate, pull)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * domains)), pa.array(total)], names=["d", "e"])

    got = rows.select(*names).mapInArrow(run, "d long, e double").groupBy("d").agg(F.sum("e").alias("e")).collect()
    out = np.zeros(2 * domains)
    for d, e in got:  # two rows a domain
        out[d] = e
    return out.reshape(2, domains)


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: its rate, rounded up or down by a hash of its key with the rate's expectation."""
    u = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def fit_rates(rows: DataFrame, names: tuple[str, str], targets: np.ndarray, domains: int, budget: float = 1.0, pull: float = 0.001, steps: int = 120, near: float = 1e-4) -> tuple[np.ndarray, float]:
    """Residuals of all steps, over the domains' shares; and the length of a step.

    Steps have momentum and end when no domain's expected tokens have moved by more than `near` of all tokens in any of
    three steps in a row. If that doesn't happen within `steps`, a warning says what the targets are missed by.
    """
    now, start = expected(rows, names, np.zeros((0, domains)), domains, 0.0, pull)
    total = now.sum()
    # Weighted by mass, the map from rates to residuals over shares is a column-stochastic matrix, of norm one at most.
    rate = 1.0 / (1.0 + pull)
    residuals = np.zeros((0, domains))
    if not total:
        return residuals, rate
    share = np.maximum(now / total, 1e-3)
    still = 0
    for _ in range(steps):
        residuals = np.vstack([residuals, (budget * targets - start / total) / share])
        before, (now, start) = now, expected(rows, names, residuals, domains, rate, pull)
        still = still + 1 if np.abs(now - before).max() < near * total else 0
        if still == 3:
            return residuals, rate
    warnings.warn(f"rates still move after {steps} steps; expected shares {np.round(now / total, 4).tolist()}", stacklevel=2)
    return residuals, rate


def mixing(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = ("quality", "toxic"), targets: tuple[float, ...] = (0.04, 0.95, 0.0, 0.01), budget: float = 1.0, text: str = "text", doc_id: str = "doc_id", whole: tuple[str, str, str] | None = None, learn: Column | None = None, most: int = MOST, pull: float = 0.001, steps: int = 120) -> DataFrame:
    """doc_id, tokens, p and rate. targets: shares of tokens of domains 0, 1, .., by label bits.

    budget: expected tokens in all, as a multiple of what there are. whole: names for tokens, p and rate beside all of
    the columns of docs, which are then given instead.
    """
    if len(targets) != 1 << len(names) or min(targets) < 0 or abs(sum(targets) - 1) > 1e-9:
        raise ValueError("one target for each joint class of the labels, none negative, of sum one")
    scratch = Scratch(docs.sparkSession, "mixing")
    domains = len(targets)
    free = F.lit(True) if learn is None else learn
    model = Domains([sample(docs, labels, n, free, text, doc_id, most) for n in names])
    columns = docs.columns if whole else [doc_id]
    tokens, share, out = whole or (fresh("tokens", docs), fresh("p", docs), fresh("rate", docs))
    own = scratch.write(posteriors(docs, model, text, columns, (tokens, share)), "posteriors")
    residuals, rate = fit_rates(own, (tokens, share), np.array(targets), domains, budget, pull, steps)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            r, _ = rates(b.column(tokens).to_numpy(), matrix(b, share, domains), residuals, rate, pull)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], names=[*b.schema.names, out])

    done = own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(out, T.DoubleType())]))
    return done if whole else done.select(F.col(doc_id).alias("doc_id"), F.col(tokens).alias("tokens"), F.col(share).alias("p"), F.col(out).alias("rate"))


def resampled(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents with all their columns, each as often as its rate asks for; options as of mixing()."""
    names = tuple(fresh(n, docs) for n in ("tokens", "p", "rate"))
    done = mixing(docs, labels, text=text, doc_id=doc_id, whole=names, **options)
    often = copies(F.col(names[2]), F.struct(F.col(doc_id), F.xxhash64(F.col(text))))
    copy = fresh("copy", docs)
    return done.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), often)).alias(copy)).drop(copy)
