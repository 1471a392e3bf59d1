"""Removal of repeated passages with a log-structured index of window fingerprints.

A window is `size` consecutive words of a document. The index holds, in buckets of the hash space, immutable runs of
sorted window fingerprints: a 64-bit hash to merge by and a second, independent 32-bit one to verify a match with (96
bits in all: among 1e14 windows a wrong match is expected 0.1 times). A
new batch of documents is hashed, its fingerprints are dealt by bucket and merge-joined with each historical run and
with each other; what was not there before becomes a further run. When an index has `most_runs` runs, the next batch
merges them into one. Runs are a bucketed table, so that they are never shuffled again; the batch alone is.

An input task sends each different window on once, with the smallest document that has it, and answers for its other
documents itself, so a passage that a third of all documents share adds one entry for each task to a bucket. Answers,
the hashes of repeated windows of a document, meet the texts in groups of documents of bounded size.

remove_repeats() reads a whole table as `batches` batches in the order of doc_id. Defined cases: null text has no words.
A window counts as repeated when its word sequence also starts in a document with a smaller doc_id; repetition within
one document, or between rows with equal doc_ids, does not count. Rows with a null doc_id are given back whole and
are no one's history. Documents shorter than a window stay whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, Scratch, WordHash, batches, long_hash, parts, plan_bytes, released, rolling, shuffles_dropped, utf8, word_hashes

#: Seeds of the hash that buckets, sorts and merges, and of the one that verifies.
MERGE, VERIFY = 11, 12
#: Bytes of input for each bucket. A bucket has up to one file a run and one of answers for each batch, and for each file
#: Hadoop's local file system starts two processes (chmod) where it lacks its native library.
BUCKET_BYTES = 8 << 20
BUCKET = "bucket int, grp int, h binary, tag binary, doc binary, docs binary"
FOUND = "kind string, bucket int, grp int, h binary, tag binary, doc binary"
ANSWER = "grp int, doc binary, h binary"


def windows(texts: list[bytes], size: int, hashers: list[WordHash]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of all windows of the texts; the text of each window; and each text's number of words."""
    hashes, counts = word_hashes(texts, hashers)
    last = np.cumsum(counts)
    n = max(0, int(counts.sum()) - size + 1)
    text = np.repeat(np.arange(len(texts)), counts)[:n]
    whole = np.arange(n) + size <= last[text] if n else np.zeros(0, bool)
    return [rolling(h, size, s)[whole] for h, s in zip(hashes, (MERGE, VERIFY), strict=False)], text[whole], counts


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group of a doc_id; as pmod(xxhash64(doc_id), groups) in SQL."""
    return (long_hash(doc) % groups).astype(np.int32)


def answers(doc: np.ndarray, h: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(group, doc_ids, hashes) of repeated windows."""
    g = group_of(doc, groups)
    order = np.argsort(g, kind="stable")
    g, doc, h = g[order], doc[order], h[order]
    edge = np.flatnonzero(np.diff(g, prepend=-1, append=-1)) if len(g) else np.zeros(0, np.int64)
    for b, e in zip(edge[:-1], edge[1:], strict=True):
        yield int(g[b]), doc[b:e].tobytes(), h[b:e].tobytes()


def batch_windows(size: int, buckets: int, groups: int):
    """Fingerprints of a batch by bucket (grp -1), and answers that need no other task, dealt to the buckets by group."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [WordHash(MERGE), WordHash(VERIFY)]
        for b in batches(it, "text", 2 << 20):
            ids = b.column("doc_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            texts = utf8(b.column("text"))
            (h, tag), text, _ = windows([texts[i] for i in order], size, hashers)
            tag = tag.astype(np.uint32)
            by = np.lexsort((tag, h))  # stable: within a window, in the order of doc_id
            h, tag, doc = h[by], tag[by], text[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])
            first = doc[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else doc
            again = ~new & np.concatenate([[False], doc[1:] == doc[:-1]])[: len(doc)]
            own = ~again & (ids[doc] > ids[first])
            rows = [(g % buckets, g, x, b"", d, b"") for g, d, x in answers(ids[doc[own]], h[own], groups)]
            h, tag, doc = h[new], tag[new], doc[new].astype(np.uint32)
            table = ids.tobytes()
            at = np.searchsorted(h >> np.uint64(40), np.arange(buckets + 1, dtype=np.uint64) * np.uint64((1 << 24) // buckets))
            rows += [(k, -1, h[s:e].tobytes(), tag[s:e].tobytes(), doc[s:e].tobytes(), table) for k, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)) if e > s]
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "grp", "h", "tag", "doc", "docs"])

    return released(run)


def column(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in table.column(name).to_pylist()]


def known(h: np.ndarray, tag: np.ndarray, run_h: np.ndarray, run_tag: np.ndarray) -> np.ndarray:
    """Which sorted fingerprints a sorted run holds, verified by their tags."""
    at = np.searchsorted(run_h, h)
    found = np.zeros(len(h), bool)
    for step in range(len(run_h)):
        k = np.minimum(at + step, len(run_h) - 1)
        same = (run_h[k] == h) & (at + step < len(run_h))
        if not same.any():
            break
        found |= same & (run_tag[k] == tag)
    return found


def merge(compact: bool, groups: int, keep: bool):
    """Joins a bucket of a batch with the historical runs: the new run (or, compacting, all in one) and the answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = int((left if left.num_rows else right).column("bucket")[0].as_py())
        own = left.filter(pc.greater_equal(left.column("grp"), 0))
        left = left.filter(pc.less(left.column("grp"), 0))
        rows = [("answer", bucket, g, h, b"", d) for g, h, d in zip(*(own.column(c).to_pylist() for c in ("grp", "h", "doc")), strict=True)]
        h, tag = column(left, "h", np.uint64), column(left, "tag", np.uint32)
        doc = [t[d] for t, d in zip(column(left, "docs", np.int64), column(left, "doc", np.uint32), strict=True)]
        h, tag, doc = (np.concatenate([np.zeros(0, k), *x]) for x, k in ((h, np.uint64), (tag, np.uint32), (doc, np.int64)))
        by = np.lexsort((doc, tag, h))
        h, tag, doc = h[by], tag[by], doc[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])
        which = np.cumsum(new) - 1
        fresh_h, fresh_tag = h[new], tag[new]
        old = np.zeros(len(fresh_h), bool)
        runs = list(zip(column(right, "h", np.uint64), column(right, "tag", np.uint32), strict=True))
        for run_h, run_tag in runs:
            old |= known(fresh_h, fresh_tag, run_h, run_tag)
        repeated = old[which] | (doc > doc[np.flatnonzero(new)[which]]) if len(h) else np.zeros(0, bool)
        rows += [("answer", bucket, g, x, b"", d) for g, d, x in answers(doc[repeated], h[repeated], groups)]
        if keep:
            made_h, made_tag = fresh_h[~old], fresh_tag[~old]
            if compact:
                made_h, made_tag = np.concatenate([made_h, *(r[0] for r in runs)]), np.concatenate([made_tag, *(r[1] for r in runs)])
                by = np.lexsort((made_tag, made_h))
                made_h, made_tag = made_h[by], made_tag[by]
            if len(made_h):
                rows.append(("run", bucket, -1, made_h.tobytes(), made_tag.tobytes(), b""))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "bucket", "grp", "h", "tag", "doc"])

    return run


class FingerprintIndex:
    """The historical window fingerprints: a bucketed table of runs in the warehouse, which all executors share."""

    def __init__(self, spark: SparkSession, size: int = 13, buckets: int = 64, groups: int = 64, most_runs: int = 4):
        self.spark, self.size, self.groups, self.most_runs = spark, size, groups, most_runs
        self.buckets = 1 << min(16, max(0, (buckets - 1).bit_length()))
        self.name, self.runs, self.batch = f"fingerprints_{uuid.uuid4().hex}", 0, 0
        self.scratch = Scratch(spark, "substring")
        self.tables: list[str] = []

    def add(self, docs: DataFrame, keep: bool = True) -> None:
        """Takes a batch with the columns doc_id (not null) and text. keep: whether it becomes part of the history."""
        spark, compact = self.spark, keep and self.runs >= self.most_runs
        dealt = docs.mapInArrow(batch_windows(self.size, self.buckets, self.groups), BUCKET).repartition(self.buckets, "bucket")
        if self.runs:
            old = spark.table(self.tables[0]).where("kind = 'run'").select("bucket", "h", "tag")
        else:
            old = spark.createDataFrame([], "bucket int, h binary, tag binary")
        found = dealt.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(merge(compact, self.groups, keep), FOUND)
        name = self.tables[0] if self.runs and not compact else f"{self.name}_{self.batch}"
        if keep and name not in self.tables:
            self.tables.append(name)  # so that it goes even if writing it fails
        if keep:
            written = found.withColumn("batch", F.lit(self.batch))
            with shuffles_dropped(spark):
                written.write.mode("append").option("compression", "zstd").partitionBy("kind", "batch").bucketBy(self.buckets, "bucket").saveAsTable(name)
            found = spark.table(name).where(f"kind = 'answer' AND batch = {self.batch}")
        self.scratch.write(found.select("grp", "doc", "h"), f"answers/batch={self.batch}", compression="zstd")
        if keep:
            for old_name in self.tables[:-1]:
                self.spark.sql(f"DROP TABLE IF EXISTS {old_name}")
            self.runs = 1 if compact else self.runs + 1
            self.tables = [name]
        self.batch += 1

    def answers(self) -> DataFrame:
        return self.scratch.read("answers").select("grp", "doc", "h")

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []


def repeated(texts: pa.ChunkedArray, some: list[int], known_: list[np.ndarray], size: int, hashers: list[WordHash]) -> Iterator[np.ndarray]:
    """For each of some texts a mark at every word that a window among its known ones covers; a few megabytes at a time."""
    at = 0
    while at < len(some):
        part, held = [], 0
        while at + len(part) < len(some) and held < 2 << 20:
            part.append(texts[some[at + len(part)]].as_py() or b"")
            held += len(part[-1])
        (own,), text, counts = windows(part, size, hashers)
        edge = np.searchsorted(text, np.arange(len(part) + 1))
        for k, n in enumerate(counts.tolist()):
            hit = np.flatnonzero(np.isin(own[edge[k] : edge[k + 1]], known_[at + k]))
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + size, -1)
            yield np.cumsum(cover[:n]) > 0
        at += len(part)


def cleaned(size: int, with_text: bool):
    """Removes the words that repeated windows cover from a group of documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hashers = [WordHash(MERGE)]
        doc = np.concatenate([np.zeros(0, np.int64), *column(right, "doc", np.int64)])
        h = np.concatenate([np.zeros(0, np.uint64), *column(right, "h", np.uint64)])
        by = np.argsort(doc, kind="stable")
        doc, h = doc[by], h[by]
        ids = left.column("doc_id").to_pylist()
        texts = left.column("text").cast(pa.binary())
        found = [(0, 0) if i is None else tuple(np.searchsorted(doc, [i, i + 1]).tolist()) for i in ids]
        some = [k for k, (b, e) in enumerate(found) if e > b]
        gone = dict(zip(some, repeated(texts, some, [h[slice(*found[k])] for k in some], size, hashers), strict=True))
        rows = []
        for k, (i, text) in enumerate(zip(ids, texts.to_pylist(), strict=True)):
            words = WORD.findall(text or b"")
            n = len(words)
            if k in gone:
                words = [w for w, c in zip(words, gone[k].tolist(), strict=True) if not c]
            kept = b" ".join(words)
            rows.append((i, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 13, batch_count: int = 4, most_runs: int = 4, with_text: bool = True) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless with_text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known_ids = rows.where("doc_id IS NOT NULL")
    size_bytes = plan_bytes(docs)
    groups = parts(docs, 6 << 20)
    index = FingerprintIndex(spark, size, size_bytes // BUCKET_BYTES + 1, groups, most_runs)
    # Batches by ranges of doc_id, so that all history has smaller doc_ids. The bounds only balance the batches.
    bounds = sorted(set(known_ids.approxQuantile("doc_id", [k / batch_count for k in range(1, batch_count)], 0.01))) if batch_count > 1 else []
    try:
        for k in range(len(bounds) + 1):
            part = known_ids
            if k:
                part = part.where(F.col("doc_id") > int(bounds[k - 1]))
            if k < len(bounds):
                part = part.where(F.col("doc_id") <= int(bounds[k]))
            index.add(part, keep=k < len(bounds))
    finally:
        index.drop()
    # Rows without a doc_id have no answers and are dealt by their texts.
    grp = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")), F.lit(groups)).cast("int").alias("grp")
    left = rows.select(grp, "doc_id", "text").repartition(groups, "grp")
    return left.groupBy("grp").cogroup(index.answers().groupBy("grp")).applyInArrow(cleaned(size, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS win FROM starts
), judged AS (
  SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY win) AS again FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM judged WHERE again
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
