"""Document fingerprints by order MinHash.

The k-mers of a text (k code points) are numbered by occurrence and hashed. For each of `size` orders the `tuple_size`
least are selected, put back into the order in which they stand in the text, and hashed together: one component of the
signature. So components change with the edit distance, not only with the set of k-mers. An order ranks the k-mers'
hashes by its own odd multiple and shift of them, so the orders are independent of each other. The likeness of two fingerprints is the share of components that are equal.

edited_pairs() compares each document with the next one in the order of doc_id and with an edited text that the two
make. Documents are dealt by ranges of doc_id; the first of each range is given to the range before as well.

Defined cases: null text counts as empty; an empty text has one k-mer of length zero, a text shorter than k one k-mer.
A null doc_id comes before all others. Rows that repeat a doc_id follow each other by the hash of their texts. The only
document of a table is its own next one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batches, mix, odd, parts, released

K, SIZE, TUPLE = 8, 64, 2
#: K-mers that are ranked at a time, which bounds the memory for very long texts.
BLOCK = 4096
#: Ranges of doc_id and tasks at most; beyond about 800 GB of documents tasks grow, and are read as sorted streams.
MOST_RANGES, MOST_TASKS = 1 << 17, 1 << 16
FIRST = -(1 << 63)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def kmers(code: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers of a text's code points."""
    k = min(k, max(1, len(code)))
    if not len(code):
        return mix(np.zeros(1, np.uint64))
    c = code.astype(np.uint64) + np.uint64(1)
    n = len(c) - k + 1
    h = np.zeros(n, np.uint64)
    base = odd(31)
    for i in range(k):
        h *= base
        h += c[i : i + n]
    return mix(h)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of k-mers together with which occurrence of its k-mer each is."""
    n = len(h)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    packed = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    packed.sort()
    at = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    top = packed >> bits
    new = np.ones(n, bool)
    np.not_equal(top[1:], top[:-1], out=new[1:])
    place = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[at] = place - np.maximum.accumulate(np.where(new, place, 0))
    return mix(h + occurrence * odd(32))


def ranks(h: np.ndarray, size: int) -> np.ndarray:
    """The ranks of hashes in each of `size` orders, (orders, hashes): an odd multiple of their upper halves, and a shift."""
    own = mix(np.arange(1, size + 1, dtype=np.uint64) * odd(34))
    factor, shift = (own >> np.uint64(32)).astype(np.uint32) | np.uint32(1), own.astype(np.uint32)
    out = (h >> np.uint64(32)).astype(np.uint32)[None, :] * factor[:, None]
    out += shift[:, None]
    return out


def least(h: np.ndarray, size: int, tuple_size: int) -> np.ndarray:
    """Where the least ranks of each order are, (orders, tuple_size); with fewer hashes than that, some twice."""
    row = np.arange(size)
    values, places = [], []
    for at in range(0, len(h), BLOCK):
        v = ranks(h[at : at + BLOCK], size)
        for _ in range(min(tuple_size, v.shape[1])):
            i = v.argmin(axis=1)
            values.append(v[row, i])
            places.append(at + i)
            v[row, i] = np.uint32(0xFFFFFFFF)
    places, values = np.stack(places, 1), np.stack(values, 1)
    if len(h) > BLOCK:
        places = np.take_along_axis(places, np.argsort(values, axis=1, kind="stable"), 1)
    return places[:, np.arange(tuple_size) % min(len(h), places.shape[1])]


def signature(text: str, k: int = K, size: int = SIZE, tuple_size: int = TUPLE) -> np.ndarray:
    """The components of a text's fingerprint, as 16-bit integers."""
    h = numbered(kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k))
    chosen = np.sort(least(h, size, tuple_size), axis=1)
    out = np.arange(size, dtype=np.uint64)
    for i in range(tuple_size):
        out = out * odd(33) + h[chosen[:, i]]
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def compared(k: int, size: int, tuple_size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in SCHEMA.split(", ")]
        held = None  # bucket, doc_id, text, signature of a document whose next one is to come
        for b in batches(it, "text"):
            rows = []
            for bucket, extra, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")), strict=True):
                if held is None and extra:
                    continue
                own = signature(text, k, size, tuple_size)
                if held is not None and held[0] == bucket:
                    cut = len(held[2]) // 4
                    edited = held[2][: len(held[2]) - cut] + text[:cut]
                    other = signature(edited, k, size, tuple_size) if edited != held[2] else held[3]
                    rows.append((held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), held[3].astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(), likeness(held[3], other), likeness(held[3], own)))
                held = None if extra else (bucket, doc_id, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return released(run)


def buckets(key: F.Column, bounds: list[int]) -> F.Column:
    """How many of the sorted bounds are below the key, by two steps of about the root of their number."""
    wide = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)] or [[]]

    def below(values: F.Column) -> F.Column:
        return F.size(F.filter(values, lambda x: x < key))

    def listed(values: list) -> F.Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")

    heads = listed([g[0] for g in groups if g])
    coarse = F.greatest(below(heads) - 1, F.lit(0))
    fine = F.array(*[listed(g) for g in groups])
    return (coarse * wide + below(F.get(fine, coarse))).cast("int")


def edited_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K, size: int = SIZE, tuple_size: int = TUPLE) -> DataFrame:
    """One row for each document, see SCHEMA: its fingerprint, that of its edited text, and the likenesses."""
    spark = docs.sparkSession
    n = min(parts(docs, 12 << 20), MOST_TASKS)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(FIRST)))
    # Several ranges a partition, so that those which hashing deals to one partition come to about the same everywhere.
    ranges = min(8 * n, MOST_RANGES) if n > 1 else 1
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))}) if n > 1 else []
    rows = rows.withColumn("bucket", buckets(F.col("key"), bounds))
    heads = [tuple(r) for r in rows.groupBy("bucket").agg(F.min("key")).orderBy("bucket").collect()]  # one row a bucket
    before = [(heads[i - 1][0], key) for i, (_, key) in enumerate(heads)]
    first = spark.createDataFrame(before, "bucket int, key long")
    extra = rows.drop("bucket").join(F.broadcast(first), "key")
    both = rows.select("bucket", F.lit(0).alias("extra"), "key", "doc_id", "text").unionAll(extra.select("bucket", F.lit(1), "key", "doc_id", "text"))
    dealt = both.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", "key", F.xxhash64("text"))
    return dealt.select("bucket", "extra", "doc_id", "text").mapInArrow(compared(k, size, tuple_size), SCHEMA)
