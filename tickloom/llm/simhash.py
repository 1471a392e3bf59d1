"""Near-duplicates by SimHash with deletion variants.

A fingerprint of 64 bits takes the majority of each bit over the XXH64 hashes (seed 42) of a text's word shingles.
Two fingerprints with at most 4 differing bits, cut into three segments, have a segment with at most one differing bit.
So each fingerprint is indexed under every segment with one bit deleted (64 variants), variants are matched by equality
and the pairs verified. Equal fingerprints are one entry of the index, so groups of copies cost nothing.

A variant's entries arrive sorted; those of a task are compared in numpy, and a task gives a spanning forest of the
links it has verified, never all pairs of a group. A variant with more entries than `block` is not compared by the task
that reads it: its entries are cut into blocks, each pair of blocks goes to a task of its own, and these give spanning
forests again. Components follow from the forests by star contraction (components.py).

Defined cases: null text counts as empty. A text with fewer words than a shingle has makes one shingle of all; a text
without words has fingerprint zero, which is linked like any other. Rows that repeat a doc_id are rows of their own;
rows with a null doc_id link like others and get, as component_id, the smallest doc_id of the component, or null.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import LOWER, WORD, Scratch, WordHash, batches, fresh, gathered, mix, odd, released, rolling, utf8, word_hashes
from tickloom.llm.components import components

SEED = 42
#: First bit and width of the three segments; 4 differing bits leave one of them with at most one.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MASKS = tuple(((1 << w) - 1) << b for b, w in SEGMENTS)
#: Entries of a variant that one task compares with each other.
BLOCK = 4096
#: Bands of minhashes by which keep_one finds what fingerprints leave unconnected, and minhashes of each.
BANDS, ROWS = 32, 4


def fingerprint(text: bytes, size: int = 4) -> int:
    found = WORD.findall(text.translate(LOWER))
    if not found:
        return 0
    line = b" ".join(found)
    stop = np.cumsum([len(w) + 1 for w in found]) - 1
    begin = np.concatenate([[0], stop[:-1] + 1])
    n = max(1, len(found) - size + 1)
    digest = xxhash.xxh64_intdigest
    ends = stop[min(size, len(found)) - 1 :]
    h = np.fromiter((digest(line[b:e], SEED) for b, e in zip(begin[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        count += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4) -> DataFrame:
    """doc_id and fp: the fingerprint, as a signed long."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text"):
            fps = np.array([fingerprint(t, size) for t in utf8(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(rows: DataFrame) -> DataFrame:
    """key, fp, id: an entry for each segment and each deleted bit of it."""
    keys = []
    for base, (first, width) in zip((0, 22, 43), SEGMENTS, strict=True):
        seg = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        for p in range(width):
            low = seg.bitwiseAND(F.lit((1 << p) - 1))
            high = F.shiftleft(F.shiftrightunsigned(seg, p + 1), p)
            keys.append(F.lit((base + p) << 21).cast("long").bitwiseOR(high).bitwiseOR(low).cast("int"))
    return rows.select(F.explode(F.array(*keys)).alias("key"), "fp", "id")


class Forest:
    """Disjoint sets of ids; remembers the links that joined two of them."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.links.append((min(x, y), max(x, y)))


def near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def compare(forest: Forest, fp: np.ndarray, ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, most: int) -> None:
    """Adds the links between all entries of two blocks."""
    for at in range(0, len(fp), 256):
        i, j = np.nonzero(near(fp[at : at + 256, None], other[None, :], most))
        i += at
        new = ids[i] != other_ids[j]
        forest.add(ids[i[new]], other_ids[j[new]])


def sorted_groups(it: Iterator[pa.RecordBatch], block: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links of the variants of one partition, and what is left over: entries (a: id, b: fp, key, cut) of large ones."""
    key = np.zeros(0, np.int32)
    fp, ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    large, cut, seen = -1, 0, 0

    def links(forest: Forest) -> pa.RecordBatch:
        a, b = np.array(forest.links, np.int64).reshape(-1, 2).T
        return pack(a, b, np.full(len(a), -1), np.full(len(a), -1))

    def pack(a, b, k, c) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(c, pa.int32())], names=["a", "b", "key", "cut"])

    def leftover(n: int) -> pa.RecordBatch:
        nonlocal seen
        c = (seen + np.arange(n)) // block
        seen += n
        return pack(ids[:n], fp[:n].view(np.int64), np.full(n, large), c)

    def small(n: int) -> pa.RecordBatch:
        """All variants among the first n entries, which end with a whole variant."""
        forest = Forest()
        k, f, i = key[:n], fp[:n], ids[:n]
        edge = np.flatnonzero(np.diff(k, prepend=-1, append=-1))
        size = np.diff(edge)
        left = np.flatnonzero(np.repeat(size, size) > 1)
        for lag in range(1, min(int(size.max(initial=1)), 33)):
            left = left[left + lag < n]
            left = left[k[left] == k[left + lag]]
            hit = left[near(f[left], f[left + lag], most)]
            forest.add(i[hit], i[hit + lag])
        for e, s in zip(edge[:-1][size > 33], size[size > 33], strict=True):
            compare(forest, f[e : e + s], i[e : e + s], f[e : e + s], i[e : e + s], most)
        return links(forest)

    for b in it:
        key = np.concatenate([key, b.column("key").to_numpy()])
        fp = np.concatenate([fp, b.column("fp").to_numpy().view(np.uint64)])
        ids = np.concatenate([ids, b.column("id").to_numpy()])
        if large >= 0:
            n = int(np.searchsorted(key, large, side="right"))
            if n:
                yield leftover(n)
                key, fp, ids = key[n:], fp[n:], ids[n:]
            if len(key):
                large = -1
        while len(key):
            first = int(np.searchsorted(key, key[-1]))  # where the last variant begins, which may go on
            sizes = np.diff(edges := np.flatnonzero(np.diff(key[:first], prepend=-1, append=-1)))
            over = edges[:-1][sizes > block]
            n = int(over[0]) if len(over) else first
            if n:
                yield small(n)
                key, fp, ids = key[n:], fp[n:], ids[n:]
                first -= n
            if len(over):
                large, seen = int(key[0]), 0
                n = int(np.searchsorted(key, large, side="right"))
                yield leftover(n)
                key, fp, ids, large = key[n:], fp[n:], ids[n:], -1
                continue
            if len(key) > block:
                large, seen = int(key[0]), 0
                yield leftover(len(key))
                key, fp, ids = key[:0], fp[:0], ids[:0]
            break
    if len(key):
        yield small(len(key))


def block_links(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a large variant; rows arrive sorted by pair of blocks."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    now = None

    def done() -> pa.RecordBatch:
        forest = Forest()
        (fp, ids), (other, other_ids) = held[min(held)], held[max(held)]
        compare(forest, fp, ids, other, other_ids, most)
        a, b = np.array(forest.links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in it:
        pair = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y", "cut")], 1)
        fp, ids = batch.column("fp").to_numpy().view(np.uint64), batch.column("id").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1), [True]]))
        for b, e in zip(edge[:-1], edge[1:], strict=True):
            k = tuple(pair[b, :3].tolist())
            if k != now:
                if held:
                    yield done()
                now, held = k, {}
            f, i = held.get(int(pair[b, 3]), (fp[:0], ids[:0]))
            held[int(pair[b, 3])] = np.concatenate([f, fp[b:e]]), np.concatenate([i, ids[b:e]])
    if held:
        yield done()


def link_forests(rows: DataFrame, scratch: Scratch, most: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between entries (fp, id) that connect whatever at most `most` differing bits connect."""
    entries = variants(rows)
    dealt = entries.repartition("key").sortWithinPartitions("key")
    found = scratch.write(dealt.mapInArrow(lambda it: sorted_groups(it, block, most), "a long, b long, key int, cut int"), "found")
    small = found.where("key < 0").select("a", "b")
    large = found.where("key >= 0").select("key", "cut", F.col("a").alias("id"), F.col("b").alias("fp"))
    cuts = large.groupBy("key").agg(F.max("cut").alias("last"))
    pairs = large.join(cuts, "key").select("key", "cut", "id", "fp", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    pairs = pairs.select("key", F.least("cut", "other").alias("x"), F.greatest("cut", "other").alias("y"), "cut", "fp", "id")
    dealt = pairs.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return small.unionAll(dealt.mapInArrow(lambda it: block_links(it, most), "a long, b long"))


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, most: int = 4, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id. most: differing bits of a link, 0 to 4."""
    if not 0 <= most <= 4:
        raise ValueError("three segments find up to 4 differing bits")
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, text, doc_id, size), "fingerprints")
    # A fingerprint is its own number in the graph, so those that only rows without a doc_id have link others too.
    rows = scratch.write(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    low = components(link_forests(rows.select("fp", F.col("fp").alias("id")), scratch, most, block), scratch)
    rooted = scratch.write(rows.join(low.select(F.col("b").alias("fp"), "a"), "fp", "left").select("fp", "least", F.coalesce("a", "fp").alias("root")), "rooted")
    named = rooted.drop("least").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    result = marked.join(named, "fp", "left")
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: list[bytes], size: int, hasher: WordHash) -> list[np.ndarray]:
    """Ascending 64-bit hashes of each text's different word shingles; one of all words where they are fewer than `size`."""
    (h,), counts = word_hashes([t.translate(LOWER) for t in texts], [hasher], 1 << 18)
    ends = np.cumsum(counts)
    return [np.unique(rolling(h[e - n : e], max(1, min(size, n)), SEED)) if n else np.zeros(1, np.uint64) for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]


def bands(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of ROWS minhashes of the set."""
    least = np.full(len(factor), (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096, None] * factor + shift).min(axis=0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * odd(SEED) + least[r * BANDS : (r + 1) * BANDS])
    return out


def set_rows(docs: DataFrame, text: str, doc_id: str, size: int) -> DataFrame:
    """doc_id, th, fp, set, keys of every document: its text's hash and fingerprint, the hash of its set of shingles, the set's bands."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = WordHash(SEED), mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
        factor, shift = own[::2] | np.uint64(1), own[1::2]
        for b in batches(it, "text", 1 << 18):
            texts = utf8(b.column("text"))
            fps = np.array([fingerprint(t) for t in texts], np.uint64)
            sets = shingle_sets(texts, size, hasher)
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            keys = np.concatenate([bands(s, factor, shift) for s in sets])
            keys = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fps.view(np.int64)), pa.array(ids.view(np.int64)), keys], names=["doc_id", "th", "fp", "set", "keys"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, th long, fp long, set long, keys array<long>")


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def neighbours(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of entries next to each other in one band; rows arrive sorted by key and id."""
    key, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in it:
        key = np.concatenate([key[-1:], b.column("key").to_numpy()])
        ids = np.concatenate([ids[-1:], b.column("id").to_numpy()])
        at = np.flatnonzero(key[1:] == key[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(ids[at]), pa.array(ids[at + 1])], names=["key", "a", "b"])


def jaccard(x: np.ndarray, y: np.ndarray, share: float) -> bool:
    """Whether two ascending sets have a similarity of `share` or more."""
    if min(len(x), len(y)) < share * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= share * (len(x) + len(y) - both)


def apart(it: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Links between entries of one band that are in different components (low); rows arrive sorted by key.

    A pair is compared in the first band that it shares, unless links found in the band connect it already.
    """
    held: list[tuple] = []
    now = None

    def done() -> pa.RecordBatch:
        forest = Forest()
        low, ids = np.array([r[0] for r in held]), np.array([r[1] for r in held])
        keys, sets = np.stack([r[2] for r in held]), [np.frombuffer(r[3], np.uint64) for r in held]
        kinds, which, count = np.unique(low, return_inverse=True, return_counts=True)
        rank = np.argsort(np.argsort(count, kind="stable"), kind="stable")[which]
        for i in np.flatnonzero(rank < len(kinds) - 1):  # the largest component is only a partner
            other = np.flatnonzero(rank > rank[i])
            first = (keys[other] == keys[i]).argmax(axis=1)
            for j in other[keys[i][first] == now]:
                if forest.find(int(low[i])) != forest.find(int(low[j])) and jaccard(sets[i], sets[j], share):
                    forest.up[forest.find(int(low[i]))] = forest.find(int(low[j]))
                    forest.links.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        a, b = np.array(forest.links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for b in it:
        keys = np.asarray(b.column("keys").flatten()).reshape(-1, BANDS)
        for k, *row in zip(b.column("key").to_pylist(), b.column("low").to_pylist(), b.column("id").to_pylist(), keys, b.column("shingles").to_pylist(), strict=True):
            if k != now:
                if held:
                    yield done()
                now, held = k, []
            held.append(row)
    if held:
        yield done()


def alike(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of `share` or more. sets: set, shingles."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            both = zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)
            keep = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share) for x, y in both]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def fingerprint_links(marked: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """Links (a, b) between sets that connect those whose texts' fingerprints differ by at most `most` bits. marked: fp, set."""
    both = marked.select("fp", "set").distinct()
    least = scratch.write(gathered(both.groupBy("fp").agg(F.min("set").alias("own")), marked), "prints")
    forests = link_forests(least.select("fp", F.col("fp").alias("id")), scratch, most)
    ends = [least.select(F.col("fp").alias(c), F.col("own").alias(f"own_{c}")) for c in ("a", "b")]
    across = forests.join(ends[0], "a").join(ends[1], "b").select("own_a", "own_b")
    links = gathered(both.join(least, "fp").select("own", "set"), marked).unionAll(across).toDF("x", "y")  # equal fingerprints, then close ones
    return scratch.write(links.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "close")


def near_copies(docs: DataFrame, scratch: Scratch, text: str, doc_id: str, size: int, share: float, most: int) -> DataFrame:
    """doc_id, th and component of every document: one component for what links of fingerprints or of similarity `share` connect."""
    marked = scratch.write(set_rows(docs, text, doc_id, size), "sets")
    printed = fingerprint_links(marked, scratch, most)
    entries = marked.select(F.explode("keys").alias("key"), F.col("set").alias("id")).distinct()
    dealt = entries.repartition("key").sortWithinPartitions("key", "id")
    close = scratch.write(dealt.mapInArrow(neighbours, "key long, a long, b long"), "neighbours")
    shared = close.select("key", F.col("a").alias("id")).unionAll(close.select("key", F.col("b").alias("id"))).distinct()

    def shingles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(SEED)
        for b in batches(it, "text", 1 << 18):
            found = shingle_sets(utf8(b.column("text")), size, hasher)
            yield pa.RecordBatch.from_arrays([b.column("set"), b.column("keys"), pa.array([s.tobytes() for s in found], pa.binary())], names=["set", "keys", "shingles"])

    # The texts behind the entries that share a band: one for each set.
    wanted = marked.join(shared.select(F.col("id").alias("set")).distinct(), "set", "left_semi").groupBy("set").agg(F.min(F.struct("th", "keys")).alias("of"))
    wanted = wanted.select("set", "of.*")
    texts = docs.select(text_hash(text).alias("th"), F.col(text).alias("text"))
    found = texts.join(wanted.hint("merge"), "th").select("set", "keys", "text").mapInArrow(released(shingles), "set long, keys array<long>, shingles binary")
    sets = scratch.write(gathered(found.dropDuplicates(["set"]), docs), "shingles")

    tried = scratch.write(gathered(close.select("a", "b").distinct(), close), "tried")
    links = printed.unionAll(scratch.write(alike(tried, sets, share), "alike"))
    low = components(links, Scratch(docs.sparkSession, "near"))
    # Entries of a band that are not connected yet are compared with all others of it that they are not connected with.
    named = shared.join(low.select(F.col("b").alias("id"), "a"), "id", "left").select("key", "id", F.coalesce("a", "id").alias("low"))
    mixed = named.groupBy("key").agg(F.min("low").alias("x"), F.max("low").alias("y")).where("x <> y").select("key")
    rest = named.join(mixed, "key").join(sets.withColumnRenamed("set", "id"), "id").repartition("key").sortWithinPartitions("key")
    more = scratch.write(rest.mapInArrow(lambda it: apart(it, share), "a long, b long"), "apart")
    if not more.isEmpty():
        low = components(low.select("a", "b").unionAll(more), Scratch(docs.sparkSession, "near"))
    low = low.select(F.col("b").alias("set"), "a")
    return marked.join(low, "set", "left").select("doc_id", "th", F.coalesce("a", "set").alias("component"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, share: float = 0.8, most: int = 4) -> DataFrame:
    """Of documents that near copies connect the one with the smallest doc_id, with all its columns.

    A null doc_id comes after all others; of several texts with the smallest doc_id the one with the least hash stays,
    and of rows that repeat both any one.

    Near copies have fingerprints that differ by at most `most` bits, found by deletion variants as in simhash_dedup.
    Texts whose sets of `size` words have a Jaccard similarity of `share` or more are near copies too. Their fingerprints
    differ by about 10 of 64 bits and by 13 or more often enough, which segments can't find without comparing nearly
    everything; so what fingerprints leave unconnected is looked for among texts that share one of 32 bands of 4 minhashes (a
    pair of similarity 0.8 has none in common once in 2e7), and sets are compared whole. Neighbours of each band are
    compared first; of the rest only what isn't connected by then, by fingerprints or by sets.
    """
    if not 0 <= most <= 4:
        raise ValueError("three segments find up to 4 differing bits")
    scratch = Scratch(docs.sparkSession, "near")
    found = near_copies(docs, scratch, text, doc_id, size, share, most).withColumn("none", F.col("doc_id").isNull())
    order = F.struct("none", "doc_id", "th")
    kept = found.groupBy("component").agg(F.min(order).alias("of")).select("of.doc_id", "of.th")
    own_id, own_th = fresh("kept_id", docs), fresh("kept_hash", docs)
    kept = kept.distinct().select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th))
    out = docs.join(kept.hint("merge"), F.col(own_id).eqNullSafe(F.col(doc_id).cast("long")) & (F.col(own_th) == text_hash(text)))
    if found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return out.select(*docs.columns)
    return out.dropDuplicates([own_id, own_th]).select(*docs.columns)
