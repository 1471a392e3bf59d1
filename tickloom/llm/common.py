"""What the corpus operators share: tables, scratch folders, partition counts and vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters [\x20\x09-\x0D]; nothing else separates words here.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of input that one Python task should handle at most.
TASK_BYTES = 24 << 20
#: Bytes of the tables that a table of links comes from, for each file of it.
FILE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Python workers started from now on find this package where the driver has it."""
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, one in the warehouse; in local mode, where all run on one machine, one among its temporary files.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if spark.sparkContext.master.split("[")[0] == "local":
        return os.path.join(tempfile.gettempdir(), "checkpoints", "tickloom")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path of the shared folder, and the path in it; for tasks, which have no session."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like the one given that no frame has, whatever the case of its letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(run):
    """A task's function that gives memory back to the system when it ends, as workers are used for many tasks."""

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def long_hash(x: np.ndarray) -> np.ndarray:
    """XXH64 of integers with seed 42, as the SQL function xxhash64 gives of a long."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: v << np.uint64(n) | v >> np.uint64(64 - n)
    h = np.uint64(42) + p5 + np.uint64(8) ^ turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return (h ^ h >> np.uint64(32)).view(np.int64)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within this, what a query has shuffled is deleted as soon as its result is written, and Arrow batches are small."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder. They cut lineage, outlive lost executors and go when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        with shuffles_dropped(self.spark):
            df.write.options(**options).parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        try:
            fs, p = _fs(self.spark, f"{self.path}/{name}" if name else self.path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone by now
            pass


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size; of a scan, the size of its files. 0 where it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else 0


def parts(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for a shuffle of df: at least the session's count, more where the input asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(plan_bytes(df) / task_bytes))


def gathered(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """df in a partition for FILE_BYTES of its sources, one for each core at least; as it is where their size isn't known.

    For tables without Python in their last stage that are written: files are few then, however many partitions a shuffle has.
    """
    sizes = [plan_bytes(s) for s in sources]
    if not all(sizes):
        return df
    return df.coalesce(min(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(sizes) / FILE_BYTES)), 1 << 20))


def batches(it: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of the column each; one row at least."""
    for b in it:
        if not b.num_rows:
            continue
        ends = np.cumsum(text_lengths(b.column(column)))
        start = 0
        while start < b.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def text_lengths(col: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)


def joined(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by sep; and where each begins, with the end as a last entry."""
    data = np.frombuffer(sep.join(texts) + sep, np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(sep) for t in texts], out=starts[1:])
    return data, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(seed: int) -> np.uint64:
    return np.uint64(int(mix(np.array([seed + 1], np.uint64))[0]) | 1)


#: Bytes of a word that is hashed by chunks; and masks of the bytes of a chunk, by their number.
LONG_WORD = 256
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte array begin and end; the array ends with a space."""
    edge = np.diff(np.concatenate([[True], IS_SPACE[data]]).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


class WordHash:
    """64-bit hashes of words, for a whole byte array at once.

    A word's eight-byte chunks (the last one padded with zeros) are each mixed together with a random number for their
    place in the word; the sum, with the word's length, is mixed again. Words over LONG_WORD bytes are hashed by XXH64.
    """

    def __init__(self, seed: int):
        self.seed = seed
        self.places = mix(np.arange(1, LONG_WORD // 8 + 1, dtype=np.uint64) * odd(2 * seed) + odd(2 * seed + 1))

    def __call__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        chunks = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
        length = (end - begin).astype(np.int64)
        total = np.zeros(len(begin), np.uint64)
        left = np.flatnonzero(length > 0)
        far = np.flatnonzero(length > LONG_WORD)
        if len(far):
            left = left[length[left] <= LONG_WORD]
        for place, step in zip(self.places, range(0, LONG_WORD, 8), strict=True):
            if not len(left):
                break
            got = np.ascontiguousarray(chunks[begin[left] + step]).view(np.uint64).ravel()
            have = length[left] - step
            short = have < 8
            got[short] &= MASKS[have[short]]
            total[left] += mix(got + place)
            left = left[~short & (have > 8)]
        out = mix(total + length.astype(np.uint64) * odd(2 * self.seed))
        for i in far.tolist():
            out[i] = xxhash.xxh64_intdigest(data[begin[i] : end[i]].tobytes(), self.seed)
        return out


def rolling(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of every k consecutive entries of h."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    base = odd(seed)
    for i in range(k):
        out = out * base + h[i : i + n]
    return mix(out)


def word_hashes(texts: list[bytes], hashers: list[WordHash], most: int = 2 << 20) -> tuple[list[np.ndarray], np.ndarray]:
    """For each hasher the hashes of all words of all texts, in order; and the number of words of each text.

    The bytes are handled in stretches of about `most`, cut between words.
    """
    data, starts = joined(texts, b" ")
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in hashers]
    begins = [np.zeros(0, np.int64)]
    at = 0
    while at < len(data):
        stop = min(at + most, len(data))
        while stop < len(data) and not IS_SPACE[data[stop - 1]]:
            ahead = np.flatnonzero(IS_SPACE[data[stop : stop + most]])
            stop = stop + int(ahead[0]) + 1 if len(ahead) else min(stop + most, len(data))
        piece = data[at:stop]
        b, e = words(piece)
        for hasher, got in zip(hashers, out, strict=True):
            got.append(hasher(piece, b, e))
        begins.append(b + at)
        at = stop
    counts = np.diff(np.searchsorted(np.concatenate(begins), starts))
    return [np.concatenate(got) for got in out], counts


def utf8(col: pa.Array) -> list[bytes]:
    """The texts' bytes; null counts as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def words_column(text: F.Column) -> F.Column:
    """The words of a text column as an array, by the same separators."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")
