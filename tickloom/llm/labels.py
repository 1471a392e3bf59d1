"""Labelled documents for training, all of them or bounded samples, and what the classifiers share.

A sample holds at most `most` labelled documents, chosen by the smallest hashes of their doc_ids among the rows that
may be learned from, so it is the same on every run and does not depend on how the tables are dealt. `most` and
`signs` bound what reaches the driver; scoring has no such bounds and reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier learns from at most, and code points that they may have in all.
MOST, SIGNS = 4000, 64_000_000


def remainder(doc_id: F.Column, fold: int) -> F.Column:
    """crc32 of the doc_id as text, modulo `fold`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(fold))


def remainders(doc_ids: list, fold: int) -> list[int | None]:
    return [None if i is None else zlib.crc32(str(i).encode()) % fold for i in doc_ids]


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column, text: str = "text", doc_id: str = "doc_id", most: int = MOST, signs: int = SIGNS) -> list[tuple[str, int]]:
    """(text, label) of labelled documents for which `learn`, a condition on the column doc_id, holds.

    There is one row for each doc_id: of several texts with one doc_id the one with the least hash, of several labels
    the largest. Rows are taken in the order of a hash of their doc_ids, `most` of them and no more than `signs` code
    points in all; a text that would go beyond that is left out, and the next ones are tried.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    marks = marks.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    both = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.select("doc_id", F.xxhash64("text").alias("h"), F.char_length("text").cast("long").alias("n"))
    one = size.join(both, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct("h", "n")).alias("of"))
    ids = one.select("doc_id", "y", "of.h", "of.n").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas()
    take, held = [], 0
    for n in ids["n"].tolist():
        take.append(held + n <= signs)
        held += n * take[-1]
    few = docs.sparkSession.createDataFrame(ids[["doc_id", "h", "y"]][np.array(take, bool)], "doc_id long, h long, y int")  # at most `most` rows
    got = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(few), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("text", "y", "doc_id").toPandas()
    got = got.sort_values("doc_id")
    return list(zip(got["text"], got["y"].astype(int), strict=True))


def learned(docs: DataFrame, labels: DataFrame, label: str, learn: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, y of all labelled documents for which `learn`, a condition on the column doc_id, holds.

    There is one row for each doc_id, chosen as in a sample. Texts are shuffled once.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    marks = marks.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    both = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & learn)
    rows = rows.withColumn("h", F.xxhash64("text"))
    one = rows.select("doc_id", "h").join(both, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("h").alias("h"))
    return rows.join(one, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "y")


def logistic_rows(rows: DataFrame, names: list[str], l2: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and scales of the columns `names`, and the weights that `logistic` gives of them; y is the label.

    A step of Newton's method is one distributed sum. What comes out is rounded, as the order of sums is open.
    """
    k = len(names) + 1
    got = rows.agg(*(f(n) for n in names for f in (F.avg, F.stddev_pop)), F.count(F.lit(1))).first()
    center, scale, n = np.round(got[:-1:2], 9), np.round(got[1:-1:2], 9) + 1e-6, got[-1]
    keep = np.full(k, l2)
    keep[-1] = 0
    w = np.zeros(k)
    upper = np.triu_indices(k)
    out = [f"s{i}" for i in range(k + len(upper[0]))]

    def sums(at: np.ndarray):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(out))
            for b in it:
                x = (np.stack([b.column(c).to_numpy() for c in names], 1) - center) / scale
                x = np.hstack([x, np.ones((len(x), 1))])
                p = sigmoid(x @ at)
                total[:k] += x.T @ (p - b.column("y").to_numpy())
                total[k:] += ((x * (p * (1 - p))[:, None]).T @ x)[upper]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=out)

        return run

    for _ in range(steps):
        total = rows.select(*names, "y").mapInArrow(sums(w), ", ".join(f"{c} double" for c in out)).agg(*(F.sum(c) for c in out)).first()
        grad = np.array(total[:k]) / n + keep * w
        hess = np.zeros((k, k))
        hess[upper] = np.array(total[k:]) / n
        hess = np.triu(hess) + np.triu(hess, 1).T + np.diag(keep + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, np.round(w, 9)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression, the last one the intercept; columns of x are standardised by the caller."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    keep = np.full(x.shape[1], l2)
    keep[-1] = 0
    for _ in range(min(steps, 40)):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + keep * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(keep + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
