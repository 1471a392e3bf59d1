"""Language-model scores by an Elias-Fano n-gram trie.

A bigram model is counted over all training documents and stored as a trie in two levels. Words are known by 64-bit
hashes; the first level holds the sorted hashes of all training words, as an Elias-Fano sequence whose ranks are word
ids, with the running sum of counts as another. The second level holds the successors of each context that were seen
`least` times or more: a monotone sequence of pointers gives a context's range, in which a successor is searched for in
an Elias-Fano sequence of context * V + word; its discounted probability is one of 256 quantised values, as is a context's
backoff weight. Levels are cut into segments by the first word's hash, files in the shared folder that every scoring
process maps into memory and reads only where it looks; where that folder isn't a file system that can be mapped, a
process keeps copies of the segments it has used.

Counts are summed within a task before they are shuffled, by segment, so a word with a third of all tokens is one entry
for each task. A context with more tokens than a segment has on average is cut by its successors into cells of its own,
so that no task gets all successors of a frequent word; the cells' shares of its weight are added up afterwards. The
model grows with the training text: about six bytes for a different word and four for a kept pair.

P(w | v) = max(c(v w) - d, 0) / c(v) + weight(v) * P(w), over the kept pairs; P(w) = (c(w) - e) / N, the rest being the
probability of the unknown word. A text's first context is the end of a text.

Defined cases: null text counts as empty: one token, the end. Rows with a null doc_id are scored and not learned from,
held_out is null for them. Rows that repeat a doc_id count each. Without training documents every text has score 0.
An empty table gives an empty result.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import LOWER, Scratch, WordHash, batches, mix, place, plan_bytes, released, shuffles_dropped, utf8, word_hashes
from tickloom.llm.labels import remainder

SEED = 41
END = mix(np.array([97], np.uint64))[0]
COUNTED = "segment int, k binary, c binary"
MADE = "segment int, words long, tokens long, once long, twice long, often binary, counts binary, taken double"
#: The most frequent words of a segment that may be cut as contexts. Any others stay whole, with the same results.
OFTEN = 16
ALL64 = (1 << 64) - 1


class EliasFano:
    """A monotone sequence of integers: packed low bits, and unary high bits with counts of ones for each word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.l, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        """values: ascending uint64, none above top."""
        n = len(values)
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((((top >> bits) + n + 2) // 64 + 1) * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.zeros(len(high) + 1, np.uint64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return cls(n, bits, low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.l, len(self.low), len(self.high)], np.uint64), self.low, self.high, self.ones]

    @classmethod
    def read(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, bits, a, b = (int(x) for x in data[at : at + 4])
        at += 4
        return cls(n, bits, data[at : at + a], data[at + a : at + a + b], data[at + a + b : at + a + 2 * b + 1]), at + a + 2 * b + 1

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        up = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> shift | up) & np.uint64((1 << self.l) - 1)

    def select(self, i: np.ndarray, zeros: bool) -> np.ndarray:
        """Positions of the i-th ones (zeros) of the high bits."""
        before = (np.arange(len(self.ones), dtype=np.uint64) * np.uint64(64) - self.ones) if zeros else self.ones
        word = np.searchsorted(before, i.astype(np.uint64), side="right") - 1
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), 1 << 16):
            w = word[at : at + (1 << 16)]
            x = self.high[w]
            bits = np.unpackbits((~x if zeros else x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rank = i[at : at + (1 << 16)] - before[w].astype(np.int64) + 1
            out[at : at + (1 << 16)] = w * 64 + (np.cumsum(bits, axis=1, dtype=np.uint8) < rank[:, None]).sum(axis=1)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.select(i, False) - i).astype(np.uint64) << np.uint64(self.l) | self.lows(i)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Where the values x are between begin and end; -1 for those that aren't."""
        top = (x >> np.uint64(self.l)).astype(np.int64)
        lo = np.zeros(len(x), np.int64)
        some = top > 0
        lo[some] = self.select(top[some] - 1, True) - (top[some] - 1)
        hi = self.select(top, True) - top
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        stop = hi.copy()
        want = x & np.uint64((1 << self.l) - 1)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = np.zeros(len(x), bool)
            less[open_] = self.lows(mid[open_]) < want[open_]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        hit = lo < stop
        hit[hit] = self.lows(lo[hit]) == want[hit]
        return np.where(hit, lo, -1)


class Store:
    """Files of 64-bit integers in the shared folder, written whole and mapped into memory."""

    def __init__(self, path: str):
        self.path = path

    def place(self) -> tuple[fs.FileSystem, str]:
        return place(self.path)

    def write(self, name: str, arrays: list[np.ndarray]) -> None:
        system, folder = self.place()
        system.create_dir(folder, recursive=True)
        own = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            for a in arrays:
                out.write(np.ascontiguousarray(a).tobytes())
        system.move(own, f"{folder}/{name}")

    def map(self, name: str) -> np.ndarray:
        system, folder = self.place()
        path = f"{folder}/{name}"
        if not isinstance(system, fs.LocalFileSystem):
            own = tempfile.NamedTemporaryFile(prefix=f"{urlparse(self.path).scheme}-{name}-")
            with system.open_input_stream(path) as a, open(own.name, "wb") as b:
                shutil.copyfileobj(a, b)
            path = own.name  # the mapping outlives the file's name
            return np.memmap(path, np.uint64, "r")
        return np.memmap(path, np.uint64, "r") if os.path.getsize(path) else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Facts:
    """What all segments have in common: where ids begin, and the totals of the training text."""

    path: str
    segments: int
    offsets: tuple[int, ...]
    tokens: int
    words: int
    once: int
    twice: int
    #: Ids of contexts that are cut into cells, ascending, and into how many; their weights; cells without pairs.
    cut_ids: tuple[int, ...] = ()
    cut_parts: tuple[int, ...] = ()
    cut_weights: tuple[float, ...] = ()
    blank: frozenset[int] = frozenset()

    def cells(self) -> np.ndarray:
        """First pair keys (context * V + word) of the cells, and the end: whole contexts of a segment, or a part of one."""
        v = self.words
        first = {o * v for o in self.offsets}
        for c, n in zip(self.cut_ids, self.cut_parts, strict=True):
            first |= {c * v + j * v // n for j in range(n + 1)}
        return np.array(sorted(first), np.uint64)

    @property
    def cut(self) -> float:
        """What is taken off the count of each word for the unknown one; less than one, so that no word loses all."""
        return min(0.95, max(0.05, self.once / (self.once + 2 * self.twice))) if self.once else 0.05

    def single(self, c: np.ndarray) -> np.ndarray:
        """P(w) by counts."""
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, c - self.cut, self.cut * self.words) / self.tokens

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + self.words + 1.0))


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    bits = segments.bit_length() - 1
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


class Trie:
    """The mapped levels; segments are opened when they are first looked at."""

    def __init__(self, facts: Facts):
        self.facts, self.store = facts, Store(facts.path)
        self.vocab: dict[int, tuple[EliasFano, EliasFano]] = {}
        self.pairs: dict[int, tuple] = {}
        self.cells = facts.cells()
        self.cut_ids, self.cut_weights = np.array(facts.cut_ids, np.int64), np.array(facts.cut_weights)

    def words(self, s: int) -> tuple[EliasFano, EliasFano]:
        if s not in self.vocab:
            data = self.store.map(f"words-{s}")
            hashes, at = EliasFano.read(data, 0)
            self.vocab[s] = hashes, EliasFano.read(data, at)[0]
        return self.vocab[s]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of ascending word hashes."""
        f = self.facts
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        edge = np.searchsorted(segment_of(h, f.segments), np.arange(f.segments + 1))
        for s, (b, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if e > b and f.offsets[s + 1] > f.offsets[s]:
                hashes, sums = self.words(s)
                at = hashes.find(h[b:e] - np.uint64(s * (1 << 64) // f.segments))
                hit = np.flatnonzero(at >= 0)
                ids[b + hit] = at[hit] + f.offsets[s]
                counts[b + hit] = (sums.get(at[hit] + 1) - sums.get(at[hit])).astype(np.int64)
        return ids, counts

    def level(self, s: int) -> tuple[EliasFano, EliasFano, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if s not in self.pairs:
            data = self.store.map(f"pairs-{s}")
            pointers, at = EliasFano.read(data, 0)
            after, at = EliasFano.read(data, at)
            books = data[at : at + 512].view(np.float64)
            at += 512
            n = (after.n + 7) // 8
            self.pairs[s] = pointers, after, books[:256], books[256:], data[at : at + n].view(np.uint8), data[at + n :].view(np.uint8)
        return self.pairs[s]

    def counts(self, first: int, n: int) -> np.ndarray:
        """Counts of n consecutive words of one segment."""
        s = int(np.searchsorted(self.facts.offsets, first, side="right")) - 1
        return np.diff(self.words(s)[1].get(np.arange(n + 1) + (first - self.facts.offsets[s])).astype(np.int64))

    def successors(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The discounted P(w | v), 0 where the pair isn't kept; and the weight of v. v, w: ids, by v and w ascending."""
        many = np.uint64(self.facts.words)
        out, weight = np.zeros(len(v)), np.ones(len(v))
        key = v.astype(np.uint64) * many + w.astype(np.uint64)
        edge = np.searchsorted(key, self.cells)
        for s, (b, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if e == b or s in self.facts.blank:
                continue
            pointers, after, book, weights, codes, backoff = self.level(s)
            own = v[b:e] - int(self.cells[s] // many)
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            which = np.cumsum(new) - 1
            contexts = own[new]
            first, last = pointers.get(contexts).astype(np.int64), pointers.get(contexts + 1).astype(np.int64)
            weight[b:e] = np.where(last > first, weights[backoff[contexts]], 1.0)[which]
            some = np.flatnonzero((last > first)[which])
            if len(some):
                at = after.find(key[b:e][some] - self.cells[s], first[which[some]], last[which[some]])
                hit = at >= 0
                out[b + some[hit]] = book[codes[at[hit]]]
        if len(self.cut_ids):
            at = np.minimum(np.searchsorted(self.cut_ids, v), len(self.cut_ids) - 1)
            weight = np.where(self.cut_ids[at] == v, self.cut_weights[at], weight)
        return out, weight


def tokens(texts: list[bytes], hasher: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens, each text's end among them, and the number of tokens of each."""
    (h,), counts = word_hashes([t.translate(LOWER) for t in texts], [hasher])
    return np.insert(h, np.cumsum(counts), END), counts + 1


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(k, kind="stable")
    k, c = k[by], c[by]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[edge], np.add.reduceat(c, edge) if len(k) else c


def dealt(k: np.ndarray, c: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """A row for each segment; bounds: the first keys of segments 1 and on."""
    edge = [0, *np.searchsorted(k, bounds).tolist(), len(k)]
    rows = [(s, k[b:e].tobytes(), c[b:e].astype(np.uint32).tobytes()) for s, (b, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if e > b]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["segment", "k", "c"])


def counted(each, bounds: np.ndarray, most: int = 3 << 20):
    """Counts of what `each` gives for batches of texts, summed in the task as far as memory allows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = each()
        keys, counts, held = [], [], 0
        for b in batches(it, "text", 2 << 20):
            k, c = np.unique(count(utf8(b.column("text"))), return_counts=True)
            keys.append(k)
            counts.append(c.astype(np.int64))
            held += len(k)
            if held > most:
                k, c = summed(keys, counts)
                if len(k) > most // 2:
                    yield dealt(k, c, bounds)
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [k], [c], len(k)
        if held:
            yield dealt(*summed(keys, counts), bounds)

    return released(run)


def gathered(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    k = [np.frombuffer(x, np.uint64) for x in table.column("k").to_pylist()]
    c = [np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("c").to_pylist()]
    return table.column("segment")[0].as_py(), *summed(k, c)


def made(s: int, h: np.ndarray, c: np.ndarray, often: np.ndarray, taken: float = 0.0) -> pa.Table:
    numbers = (pa.array([int(x)], pa.int64()) for x in (len(h), c.sum(), (c == 1).sum(), (c == 2).sum()))
    top = (pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (often, c[often]))
    names = ["segment", "words", "tokens", "once", "twice", "often", "counts", "taken"]
    return pa.table([pa.array([s], pa.int32()), *numbers, *top, pa.array([float(taken)])], names=names)


def write_words(path: str, segments: int):
    def run(table: pa.Table) -> pa.Table:
        s, h, c = gathered(table)
        width = (1 << 64) // segments
        sums = np.concatenate([[0], np.cumsum(c)]).astype(np.uint64)
        Store(path).write(f"words-{s}", [*EliasFano.of(h - np.uint64(s * width), width - 1).arrays(), *EliasFano.of(sums, int(sums[-1])).arrays()])
        return made(s, h, c, np.argsort(-c, kind="stable")[:OFTEN])

    return run


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A book of 256 values, evenly spaced in their logarithms, so that no error is above half their distance; and the code of each of x."""
    if not len(x):
        return np.zeros(256), np.zeros(0, np.uint8)
    x = np.log10(x)
    low, high = x.min(), x.max()
    step = (high - low) / 255 or 1.0
    return 10 ** (low + step * np.arange(256)), np.rint((x - low) / step).astype(np.uint8)


def padded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros(-len(x) % 8, np.uint8)])


def write_pairs(facts: Facts, least: int, discount: float):
    def run(table: pa.Table) -> pa.Table:
        s, k, c = gathered(table)
        trie = Trie(facts)
        keep = c >= least
        k, c = k[keep], c[keep]
        begin, end = trie.cells[s], trie.cells[s + 1]
        many = np.uint64(facts.words)
        first = int(begin // many)
        own = (k // many).astype(np.int64) - first
        n = int((end - np.uint64(1)) // many) - first + 1
        share = np.maximum((c - discount) / trie.counts(first, n)[own], 1e-18)
        taken = np.bincount(own, share, n)
        book, codes = quantised(share)
        weights, backoff = quantised(np.maximum(1 - taken, 1e-6))
        pointers = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.uint64)
        files = [*EliasFano.of(pointers, len(k)).arrays(), *EliasFano.of(k - begin, int(end - begin) - 1).arrays(), book, weights, padded(codes), padded(backoff)]
        Store(facts.path).write(f"pairs-{s}", files)
        return made(s, k, c, np.zeros(0, np.int64), taken.sum())

    return run


def pair_keys(facts: Facts):
    def start():
        trie, hasher = Trie(facts), WordHash(SEED)

        def keys(texts: list[bytes]) -> np.ndarray:
            h, _ = tokens(texts, hasher)
            uniq, which = np.unique(h, return_inverse=True)
            ids = trie.look(np.append(uniq, END) if END not in uniq else uniq)[0][which].astype(np.uint64)
            end = trie.look(np.array([END]))[0].astype(np.uint64)
            return np.concatenate([end, ids[:-1]]) * np.uint64(facts.words) + ids

        return keys

    return start


def word_keys():
    hasher = WordHash(SEED)
    return lambda texts: tokens(texts, hasher)[0]


@dataclass
class Model:
    facts: Facts
    scratch: Scratch

    def drop(self) -> None:
        self.scratch.drop()


def train(docs: DataFrame, text: str = "text", least: int = 1, discount: float = 0.75, segments: int | None = None, split: int = 1 << 16) -> Model:
    """Counts the model over all documents given and writes its levels to the shared folder.

    segments: files of a level, a power of two; by the input's size where it isn't given. split: tokens of a context that is
    cut into cells, unless a segment has more on average.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    path = f"{scratch.path}/levels"
    segments = segments or 1 << min(14, max(0, (plan_bytes(docs) >> 23).bit_length()))
    rows = docs.select(F.col(text).alias("text"))
    width = (1 << 64) // segments

    def job(count, at: np.ndarray, write) -> dict:
        # A task for each segment: hashed, several would meet in one.
        out = rows.mapInArrow(counted(count, at), COUNTED).repartitionById(len(at) + 1, F.col("segment")).groupBy("segment").applyInArrow(write, MADE)
        with shuffles_dropped(docs.sparkSession):
            return {r.segment: r for r in out.collect()}  # one row a segment or cell, at most four for each of 16384

    done = job(word_keys, np.array([s * width for s in range(1, segments)], np.uint64), write_words(path, segments))
    sizes = [done[s].words if s in done else 0 for s in range(segments)]
    offsets = (0, *np.cumsum(sizes).tolist())
    facts = Facts(path, segments, offsets, *(sum(getattr(r, k) for r in done.values()) for k in ("tokens", "words", "once", "twice")))
    if facts.words >= 1 << 32:
        raise ValueError("word ids have 32 bits")
    if facts.tokens:
        hot = max(split, facts.tokens // segments)
        often = sorted((offsets[s] + i, -(-c // hot)) for s, r in done.items() for i, c in zip(np.frombuffer(r.often, np.int64).tolist(), np.frombuffer(r.counts, np.int64).tolist(), strict=True) if c > hot)
        ids, ways = tuple(i for i, _ in often), tuple(min(n, facts.words) for _, n in often)
        facts = replace(facts, cut_ids=ids, cut_parts=ways)
        cells = facts.cells()
        got = job(pair_keys(facts), cells[1:-1], write_pairs(facts, least, discount))
        owner = (cells[:-1] // np.uint64(facts.words)).astype(np.int64)
        blank = frozenset(range(len(owner))) - got.keys()
        missing = [s for s in blank if owner[s] not in ids]
        if missing:
            raise RuntimeError(f"words without successors in cells {missing[:3]}")
        taken = dict.fromkeys(ids, 0.0)
        for s, r in got.items():
            if owner[s] in taken:
                taken[int(owner[s])] += r.taken
        facts = replace(facts, cut_weights=tuple(max(1 - taken[i], 1e-6) for i in ids), blank=blank)
    return Model(facts, scratch)


def scores(model: Model, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document."""
    facts = model.facts

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, hasher = Trie(facts), WordHash(SEED)
        for b in batches(it, "text", 2 << 20):
            h, counts = tokens(utf8(b.column("text")), hasher)
            owner = np.repeat(np.arange(len(counts)), counts)
            uniq, which = np.unique(np.append(h, END), return_inverse=True)
            ids, seen = trie.look(uniq)
            end, which = which[-1], which[:-1]
            v, w = ids[np.append(end, which[:-1])], ids[which]
            base = facts.base(seen)[which]
            single = facts.single(seen)[which]
            score = np.log10(single)
            both = np.flatnonzero((v >= 0) & (w >= 0))
            many = np.uint64(max(1, facts.words))  # pairs of 32-bit ids need all 64 bits
            key, at = np.unique(v[both].astype(np.uint64) * many + w[both].astype(np.uint64), return_inverse=True)
            share, weight = trie.successors((key // many).astype(np.int64), (key % many).astype(np.int64))
            score[both] = np.log10(share[at] + weight[at] * single[both])
            lone = np.flatnonzero((v >= 0) & (w < 0))
            if len(lone):
                some, at = np.unique(v[lone], return_inverse=True)
                score[lone] += np.log10(trie.successors(some, np.zeros(len(some), np.int64))[1][at])
            total = [np.bincount(owner, x, len(counts)) for x in (seen[which] > 0, base, score)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(total[0].astype(np.int64)), pa.array(total[1]), pa.array(total[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, fold: int = 7, held: int = 2, text: str = "text", doc_id: str = "doc_id", least: int = 1, segments: int | None = None, split: int = 1 << 16) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the doc_id modulo fold isn't held."""
    learn: Column = remainder(F.col(doc_id), fold)
    model = train(docs.where(F.coalesce(learn != held, F.lit(False))), text, least, segments=segments, split=split)
    done = scores(model, docs, text, doc_id)
    return done.select("doc_id", (remainder(F.col("doc_id"), fold) == held).alias("held_out"), "n_tokens", "n_known", F.lit(model.facts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
