"""Exact deduplication by Patricia tries.

Texts are equal when they are identical once every character of [\\x20\\x09-\\x0D] is deleted. Every input task puts its
texts into a compressed radix trie and sends each different text on once, so a text that a third of all rows share
crosses the network once for each task. The texts are dealt by length and content hash to owners; an owner's trie holds
full byte strings, and its terminal nodes the best row seen and the number of rows. A trie over its memory limit spills
its largest subtree to a file in the shared folder, which is read back as a trie of its own once the rest has been given
out, and deleted; what failed tasks leave there goes when the session ends.

Defined cases: null text counts as empty, and all empty texts are one group. Of equal texts the row with the most code
points in its original text stays, then the smallest doc_id, a null doc_id after all others. Rows that repeat a doc_id
count as rows of their own; each that carries keep_id has kept = true. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES, Scratch, batches, fresh, parts, place, released

LAST = (1 << 63) - 1
OWNER = "sha binary, norm binary, len long, h long, n long, id long, rows long"


def better(a: tuple, b: tuple) -> tuple:
    """Payloads (n, id, rows, sha, len, h): the row that stays of two groups of equal texts, and the rows of both."""
    top = a if (-a[0], a[1]) <= (-b[0], b[1]) else b
    return (top[0], top[1], a[2] + b[2], *top[3:])


class Node:
    __slots__ = ("label", "children", "payload", "spill")

    def __init__(self, label: bytes, payload: tuple | None = None):
        self.label, self.children, self.payload, self.spill = label, {}, payload, None


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Spill:
    """Records of a subtree in a file of a folder that all machines share: appended one by one, then read once."""

    def __init__(self, folder: str):
        self.system, folder = place(folder)
        self.system.create_dir(folder, recursive=True)
        self.path = f"{folder}/{uuid.uuid4().hex}"
        self.out = io.BufferedWriter(self.system.open_output_stream(self.path), 1 << 16)

    def add(self, record: tuple[bytes, tuple]) -> None:
        pickle.dump(record, self.out)

    def records(self) -> Iterator[tuple[bytes, tuple]]:
        self.out.close()
        with io.BufferedReader(self.system.open_input_stream(self.path), 1 << 16) as file:
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    break
        self.system.delete_file(self.path)


class Trie:
    """A Patricia trie from byte strings to payloads; what exceeds `most` bytes is spilled by subtree to the folder."""

    def __init__(self, most: int, folder: str):
        self.root, self.most, self.folder, self.bytes = Node(b""), most, folder, 0

    def add(self, key: bytes, payload: tuple) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.payload = payload if node.payload is None else better(node.payload, payload)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], payload)
                self.bytes += len(key) - at + 400
                break
            if child.spill is not None:
                child.spill.add((key, payload))
                return
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            k = common(child.label, key[at : at + len(child.label)])
            upper = Node(child.label[:k])
            child.label = child.label[k:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            self.bytes += 300
            node, at = upper, at + k
        while self.bytes > self.most and self.spill():
            pass

    def spill(self) -> bool:
        """Moves the largest subtree below the first branching to a file."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.payload is None:
            (only,) = node.children.values()
            if only.spill is not None:
                return False
            node, prefix = only, prefix + only.label
        held = [(sum(len(x.label) + 400 for _, x in walk(c, b"")), k) for k, c in node.children.items() if c.spill is None]
        if not held or len(node.children) == 1:
            return False
        size, k = max(held)
        file = Spill(self.folder)
        for key, x in walk(node.children[k], prefix):
            if x.payload is not None:
                file.add((key, x.payload))
            if x.spill is not None:  # an earlier spill, from when this was above the first branching
                for record in x.spill.records():
                    file.add(record)
        gone = Node(node.children[k].label[:1])
        gone.spill = file
        node.children[k] = gone
        self.bytes -= size
        return True

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        later = []
        for key, x in walk(self.root, b""):
            if x.payload is not None:
                yield key, x.payload
            if x.spill is not None:
                later.append(x.spill)
        self.root = Node(b"")
        for file in later:
            sub = Trie(self.most, self.folder)
            for record in file.records():
                sub.add(*record)
            yield from sub.items()


def walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
    stack = [(prefix + node.label, node)]
    while stack:
        key, x = stack.pop()
        yield key, x
        stack.extend((key + c.label, c) for c in x.children.values())


def entries(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, tuple]]:
    for b in batches(it, "norm"):
        cols = [b.column(c).to_pylist() for c in ("norm", "n", "id", "rows", "sha", "len", "h")]
        for norm, *payload in zip(*cols, strict=True):
            yield norm, tuple(payload)


def give(found: Iterator[tuple[bytes, tuple]], norms: bool) -> Iterator[pa.RecordBatch]:
    kind = {"sha": pa.binary(), "norm": pa.binary(), "len": pa.int64(), "h": pa.int64(), "n": pa.int64(), "id": pa.int64(), "rows": pa.int64()}
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        sha, norm, length, h, n, i, count = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((sha, norm, length, h, n, i, count), kind.values(), strict=True)], names=list(kind))

    for key, (n, i, count, sha, length, h) in found:
        rows.append((sha, key if norms else b"", length, h, n, i, count))
        held += len(key) * norms + 100
        if held > 8 << 20:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def grouped(most: int, norms: bool, folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(most, folder)
        for key, payload in entries(it):
            trie.add(key, payload)
            if norms and trie.bytes > most // 2:  # an input task needn't hold all it has seen: its owner does
                yield from give(trie.items(), True)
                trie = Trie(most, folder)
        yield from give(trie.items(), norms)

    return released(run)


def keys(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    norm = F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"), norm.alias("s"))


def owners(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = 64 << 20) -> DataFrame:
    """One row for each group of two or more equal texts: sha (of the normalised text), keep_id, group_size."""
    rows = keys(docs, text, doc_id).select(
        F.unhex(F.sha2("s", 256)).alias("sha"),
        F.col("s").cast("binary").alias("norm"),
        F.octet_length("s").cast("long").alias("len"),
        F.xxhash64("s").alias("h"),
        "n",
        F.coalesce("id", F.lit(LAST)).alias("id"),
        F.lit(1).cast("long").alias("rows"),
    )
    folder = f"{Scratch(docs.sparkSession, 'exact').path}/spilled"
    first = rows.mapInArrow(grouped(most, True, folder), OWNER)
    owned = first.repartition(parts(docs), "len", "h").mapInArrow(grouped(most, False, folder), OWNER)
    return owned.where("rows > 1").select("sha", F.nullif(F.col("id"), F.lit(LAST)).alias("keep_id"), F.col("rows").alias("group_size"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = 64 << 20) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256. See the module for the defined cases."""
    rows = keys(docs, text, doc_id).select("id", F.unhex(F.sha2("s", 256)).alias("sha"))
    owned = owners(docs, text, doc_id, most)
    found = rows.join(owned, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts.

    Where rows repeat a doc_id (or have none) several may be called for; then any one of them stays.
    """
    sha, keep, group = fresh("sha", docs), fresh("keep_id", docs), fresh("grouped", docs)
    marked = docs.withColumn(sha, F.unhex(F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, ""), 256)))
    owned = owners(docs, text, doc_id).select(F.col("sha").alias(sha), F.col("keep_id").alias(keep), F.lit(True).alias(group))
    found = marked.join(owned.hint("merge"), sha, "left").where(F.col(group).isNull() | F.col(keep).eqNullSafe(F.col(doc_id)))
    if docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return found.select(*docs.columns)
    found = Scratch(docs.sparkSession, "copies").write(found, "kept")
    several = found.where(F.col(group).isNotNull()).dropDuplicates([sha])
    return found.where(F.col(group).isNull()).unionByName(several).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       sha256(s) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""
