"""Order-preserving packing of tokenised documents into sequences by dynamic programming.

Each input task keeps its documents in their order as one stream of token ids and chooses the cuts of the stream. Cuts
are cheap at the end of a document, dearer at the end of a sentence and dearest elsewhere; a sequence costs the tokens
that pad it to the sequence length, or nothing where its length is a power of two, plus the penalty of its cut. The
recurrence f[j] = pen[j] + min(f[i] + size - (pos[j] - pos[i])) over the cuts i within one sequence length of j has a
sliding minimum of f[i] + pos[i], kept in a monotone queue, and beside it the f[i] of the few cuts a power of two away,
so a stream of n cuts takes O(n). A long stream is solved in parts; a part gives out the sequences up to the last cut
that the best ways to all of its last cuts have in common, so the cuts are those of the whole stream. Only the last
sequence of a task's stream, if it would be padded, is laid out in pieces whose lengths are powers of two.

Nothing is shuffled: tasks pack what they read, and sequence ids carry the partition's number in their upper bits.

Defined cases: null and empty texts are documents of the closing id alone. A document longer than a sequence is cut.
Rows that repeat a doc_id are packed as documents of their own. An empty table gives an empty result.

Ids are those of the vocabulary file's own tokenizer. Words between white space are encoded independently of each other
by it, so each task encodes its different words once: plain words by merging pairs for all words at once in numpy,
anything else by the tokenizer itself. Splitting and finding the different words is Arrow's.
"""

from __future__ import annotations

import json
import string
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickloom.llm.common import batches, released

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SIZE = 2048
#: What a cut costs, in tokens: at the end of a document, at the end of a sentence, elsewhere.
PENALTIES = (0, 2, 6)
#: Tokens between the cuts that are allowed inside sentences.
STEP = 32
#: Tokens that are added before what is held is packed.
STREAM = 1 << 20
#: Bytes of a word whose pairs are merged here; and bits that hold a place in such a word, below the rank of a merge.
LONGEST = 40
PLACE, NONE = 6, 1 << 30
#: Words whose lower case and composed form are themselves: letters of ASCII and Latin-1 in lower case, and Chinese ones.
EASY = "^[a-zß-öø-ÿ\\x{4e00}-\\x{9fff}]+$"


class Words:
    """Token ids of words, for many different words at once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.many = np.int64(max(vocab.values()) + 2)
        key = np.array([vocab[a] * int(self.many) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.into = key[order], order.astype(np.int32), np.array([vocab[a + b] for a, b in pairs], np.int32)
        # Printable bytes stand for themselves in this kind of vocabulary, the others for the code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.first = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[sign[b] + spec["model"]["end_of_word_suffix"]] for b in range(256)], np.int64)
        self.simple = regex.compile(r"[\p{L}]+").fullmatch

    def look(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs, with the pairs' places in the lowest bits; NONE where there is none."""
        k = a * self.many + b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at] << PLACE | place, NONE).astype(np.int32)

    def merged(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of like length, in one array, and how many each has.

        Each word is a column; first and last rows are edges that nothing merges with. A round merges every word's best
        pair: the left one takes the new id, the right one leaves the chain of its neighbours.
        """
        n, wide = len(begin), int(length.max())
        rows = np.arange(wide + 2)[:, None]
        raw = data[np.clip(begin + rows - 1, 0, len(data) - 1)]
        ids = np.ascontiguousarray(np.where(rows == length, self.final[raw], self.first[raw]))
        ids[(rows > length) | (rows == 0)] = self.many - 1
        live = (rows <= length) & (rows > 0)
        ahead, back = (np.repeat(rows + step, n, axis=1).astype(np.int32) for step in (1, -1))
        rank = np.full(ids.shape, NONE, np.int32)
        rank[1:-1] = self.look(ids[1:-1], ids[2:], rows[1:-1])
        done, kept, place = np.empty(ids.shape, np.int32), np.zeros(ids.shape, bool), np.arange(n)
        while True:
            best = rank.min(axis=0)
            todo = np.flatnonzero(best < NONE)
            if len(todo) < 0.7 * len(place):  # words that are done leave the arrays
                over = best == NONE
                done[:, place[over]], kept[:, place[over]] = ids[:, over], live[:, over]
                ids, live, ahead, back, rank = (np.take(x, todo, axis=1) for x in (ids, live, ahead, back, rank))
                place, best, todo = place[todo], best[todo], np.arange(len(todo))
            if not len(todo):
                break
            many, best = len(place), best[todo]
            flat = [x.reshape(-1) for x in (ids, live, ahead, back, rank)]  # views: the arrays are contiguous
            own = (best & ((1 << PLACE) - 1)).astype(np.int64)
            left = own * many + todo
            gone = flat[2][left].astype(np.int64) * many + todo
            right, before = flat[2][gone].astype(np.int64), flat[3][left].astype(np.int64)
            new = self.into[best >> PLACE].astype(np.int64)
            flat[0][left], flat[2][left] = new, right
            flat[1][gone], flat[4][gone] = False, NONE
            flat[3][right * many + todo] = own
            flat[4][left] = self.look(new, flat[0][right * many + todo], own)
            flat[4][before * many + todo] = self.look(flat[0][before * many + todo], new, before)
        done[:, place], kept[:, place] = ids, live
        return done.T[kept.T], kept.sum(axis=0)

    def plain(self, word: str) -> bytes:
        """The lower-cased bytes of a word of letters beyond ASCII; empty if only the tokenizer itself knows its ids."""
        s = word.lower()
        # Python lower-cases a final sigma by its place; the tokenizer goes by the character alone.
        good = word.isalpha() and self.simple(s) and len(s) == len(word) and "\u03a3" not in word and unicodedata.is_normalized("NFC", word)
        return s.encode() if good else b""

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, in order, and how many each has. Words of ASCII are in lower case."""
        easy = np.array(pc.match_substring_regex(words, EASY))
        bytes_ = words.cast(pa.binary())
        rest = ~easy & ~np.asarray(pc.string_is_ascii(words))
        if rest.any():
            lower = [self.plain(w) for w in strings(words.filter(pa.array(rest)))]
            easy[rest] = [len(x) > 0 for x in lower]
            bytes_ = pc.replace_with_mask(bytes_, pa.array(rest), pa.array(lower, pa.binary()))
        begin, data = buffers(bytes_)
        length = np.diff(begin)
        kind = np.where(easy & (length <= LONGEST), (length + 3) // 4, 0)
        count = np.zeros(len(words), np.int64)
        found = []
        for k in np.unique(kind).tolist():
            which = np.flatnonzero(kind == k)
            if k:
                ids, count[which] = self.merged(data, begin[which], length[which])
            else:
                lists = [e.ids for e in self.tokenizer.encode_batch_fast(strings(words.take(pa.array(which))), add_special_tokens=False)]
                count[which] = [len(x) for x in lists]
                ids = np.array([x for xs in lists for x in xs], np.int32)
            found.append((which, ids))
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for which, ids in found:
            out[gather(first[which], count[which])] = ids
        return out, count


def gather(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indexes begin[i] .. begin[i] + count[i] - 1 of all i, in order."""
    stop = np.cumsum(count)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - count), count)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings of an array begin, with the end as a last entry, and the bytes of all."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


def strings(col: pa.Array) -> list[str]:
    return col.to_numpy(zero_copy_only=False).tolist()


class Pool:
    """Integers of many runs, one after another, in an array that doubles when it is full."""

    def __init__(self, kind: type):
        self.array, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.array):
            bigger = np.zeros(2 * (self.n + len(more)), self.array.dtype)
            bigger[: self.n] = self.array[: self.n]
            self.array = bigger
        self.array[self.n : self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    """Ids of whole texts by way of their different words.

    A word is cut into its root, lower-cased if it is ASCII, and the punctuation that follows its last letter or number,
    which is a token run of its own. Ids of the different roots are kept, up to a number of them.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.words, self.most = Words(path), most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.ids, self.start, self.count = Pool(np.int32), Pool(np.int64), Pool(np.int64)
        self.start.extend(np.zeros(1, np.int64))
        self.count.extend(np.zeros(1, np.int64))

    def roots(self, words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The words without the punctuation that follows their last letter or number, and how long that is."""
        bare = pc.utf8_rtrim(words, characters=string.punctuation)
        last = pc.utf8_slice_codeunits(bare, -1)
        whole = pc.and_not(pc.invert(pc.utf8_is_alnum(last)), pc.equal(last, ""))
        for s in self.words.specials:
            whole = pc.or_(whole, pc.match_substring(words, s))
        bare = pc.if_else(whole, words, bare)
        lower = pc.if_else(pc.or_(whole, pc.invert(pc.string_is_ascii(bare))), bare, pc.ascii_lower(bare))
        return lower, np.asarray(pc.binary_length(words)).astype(np.int64) - np.asarray(pc.binary_length(bare))

    def known(self, words: pa.StringArray) -> np.ndarray:
        """Numbers of different roots; new ones are encoded."""
        number = np.fromiter(map(self.index.get, strings(words), repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            some = words.take(pa.array(new))
            ids, count = self.words.encode(some)
            number[new] = len(self.index) + np.arange(len(new))
            self.index.update(zip(strings(some), number[new].tolist(), strict=True))
            self.start.extend(self.ids.n + np.cumsum(count) - count)
            self.count.extend(count)
            self.ids.extend(ids)
        return number

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of ids of each text, and a mark at each id that ends a sentence."""
        if len(self.index) > self.most:
            self.clear()
        # Splits at ASCII white space alone, which the tokenizer drops; a special token's string never holds any.
        begin, data = buffers(texts)
        spaced = data[begin[0] : begin[-1]].tobytes().translate(BLANK)
        lists = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer((begin - begin[0]).astype(np.int32)), pa.py_buffer(spaced)), " ")
        flat = lists.flatten().dictionary_encode()
        words, at = flat.dictionary, np.asarray(flat.indices)
        root, tail = self.roots(words)
        root = root.dictionary_encode()
        first = self.known(root.dictionary)[np.asarray(root.indices)]
        begin, data = buffers(words)
        second = np.zeros(len(words), np.int64)
        one, more = np.flatnonzero(tail == 1), np.flatnonzero(tail > 1)
        signs, which = np.unique(data[begin[one + 1] - 1], return_inverse=True)
        second[one] = self.known(pa.array(map(chr, signs.tolist()), pa.string()))[which]
        tails = pa.array([data[e - n : e].tobytes().decode() for e, n in zip(begin[more + 1].tolist(), tail[more].tolist(), strict=True)], pa.string()).dictionary_encode()
        second[more] = self.known(tails.dictionary)[np.asarray(tails.indices)]
        both = np.stack([first, second], 1).ravel()
        own = self.ids.array[gather(self.start.array[both], self.count.array[both])]  # the ids of the batch's words
        size = self.count.array[first] + self.count.array[second]
        ends = (size > 0) & np.isin(data[np.maximum(begin[1:] - 1, 0)], STOPS)
        each = size[at]
        ids = own[gather((np.cumsum(size) - size)[at], each)]
        stop = np.cumsum(each)
        marks = np.zeros(len(ids), bool)
        marks[stop[ends[at]] - 1] = True
        return ids, np.diff(np.concatenate([[0], stop])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]), marks


STOPS = np.frombuffer(b".!?", np.uint8)
#: Tabs, line feeds and carriage returns as spaces.
BLANK = bytes(32 if b in (9, 10, 13) else b for b in range(256))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(docs: np.ndarray, marks: np.ndarray, step: int, penalties: tuple[int, int, int], base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, from 0 to its end, and their penalties.

    docs: the lengths of documents. base: the place of position 0 in the task's whole stream.
    """
    n = len(marks)
    pen = np.full(n + 1, -1, np.int64)
    pen[-base % step :: step] = penalties[2]
    pen[np.flatnonzero(marks) + 1] = penalties[1]
    pen[np.cumsum(docs)] = penalties[0]
    pen[0] = 0
    at = np.flatnonzero(pen >= 0)
    return at, pen[at]


def exact_steps(pos: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """For each position the earlier ones that are a power of two below `size` away: all, and where each one's begin."""
    at = np.full(int(pos[-1]) + 1, -1, np.int64)
    at[pos] = np.arange(len(pos))
    where, who = [], []
    for k in range(size.bit_length()):
        if 1 << k < size:
            j = np.flatnonzero(pos >= 1 << k)
            i = at[pos[j] - (1 << k)]
            where.append(j[i >= 0])
            who.append(i[i >= 0])
    j, i = np.concatenate([pos[:0], *where]), np.concatenate([pos[:0], *who])
    return i[np.argsort(j, kind="stable")].tolist(), np.concatenate([[0], np.cumsum(np.bincount(j, minlength=len(pos)))]).tolist()


def best_cuts(pos: np.ndarray, pen: np.ndarray, size: int) -> list[int]:
    """For each position, the number of the position before it on the way of least cost from the first one.

    Gaps between positions are at most `size`.
    """
    jump, begin = exact_steps(pos, size)
    at, price = pos.tolist(), pen.tolist()
    n = len(at)
    cost, value, back = [0] * n, [0] * n, [0] * n
    value[0] = at[0]
    queue: deque[int] = deque()
    for j in range(1, n):
        i, p = j - 1, at[j]
        v = value[i]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(i)
        while at[queue[0]] < p - size:
            queue.popleft()
        come = queue[0]
        low = value[come] + size - p
        for k in jump[begin[j] : begin[j + 1]]:  # a power of two needs no padding
            if cost[k] < low:
                low, come = cost[k], k
        low += price[j]
        cost[j], back[j], value[j] = low, come, low + p
    return back


def way(back: list[int], j: int) -> list[int]:
    """The positions' numbers on the way to j, without the first."""
    out = []
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def settled(back: list[int], pos: np.ndarray, size: int) -> int:
    """The last position that the best ways to all later cuts pass, whatever follows: they start in the last `size` tokens."""
    some = set(range(int(np.searchsorted(pos, pos[-1] - size)), len(pos)))
    while len(some) > 1:
        last = max(some)
        some.remove(last)
        some.add(back[last])
    return some.pop()


class Packer:
    """Takes documents' ids in order and gives their pieces."""

    def __init__(self, size: int, step: int, penalties: tuple[int, int, int], first: int, stream: int = STREAM):
        self.size, self.step, self.penalties, self.next, self.stream = size, min(step, size), penalties, first, stream
        self.docs: list[tuple] = []  # doc_id, ids that were given out before, ids, marks, ids of the whole document
        self.held, self.base, self.goal = 0, 0, stream

    def add(self, doc_id: int | None, ids: np.ndarray, marks: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, 0, ids, marks, len(ids)))
        self.held += len(ids)
        if self.held >= self.goal:
            yield from self.flush(False)
            self.goal = self.held + self.stream

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        marks = np.concatenate([d[3] for d in self.docs])
        pos, pen = cuts(np.array([len(d[2]) for d in self.docs]), marks, self.step, self.penalties, self.base)
        back = best_cuts(pos, pen, self.size)
        ends = pos[way(back, len(pos) - 1 if last else settled(back, pos, self.size))].tolist()
        if last:
            ends = self.tail([0, *ends])
        begin = 0
        todo = deque(self.docs)
        for end in ends:
            offset = 0
            while begin + offset < end:
                doc_id, start, ids, mark, total = todo.popleft()
                take = min(len(ids), end - begin - offset)
                yield doc_id, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), total, self.next, offset
                offset += take
                if take < len(ids):
                    todo.appendleft((doc_id, start + take, ids[take:], mark[take:], total))
            self.next += 1
            begin = end
        self.docs, self.held, self.base = list(todo), self.held - begin, self.base + begin

    def tail(self, ends: list[int]) -> list[int]:
        """The ends of all sequences; the last sequence, if it would be padded, as pieces of a power of two each."""
        stop, begin = ends.pop(), ends[-1]
        if stop - begin < self.size:
            for k in range(self.size.bit_length(), -1, -1):
                if (stop - begin) >> k & 1:
                    ends.append(begin := begin + (1 << k))
        else:
            ends.append(stop)
        return ends[1:]


def packer(path: str, size: int, step: int, penalties: tuple[int, int, int], close: int, stream: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        pack = Packer(size, step, penalties, TaskContext.get().partitionId() << 40, stream)
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        rows: list[tuple] = []
        for b in batches(it, "text", 3 << 20):
            ids, count, marks = encode(pc.fill_null(b.column("text").cast(pa.string()), ""))
            end = np.cumsum(count)
            for doc_id, e, n in zip(b.column("doc_id").to_pylist(), end, count, strict=True):
                own = np.append(ids[e - n : e], np.int32(close))
                rows.extend(pack.add(doc_id, own, np.append(marks[e - n : e], True)))
            if len(rows) > 1 << 16:
                yield out(rows)
                rows = []
        rows.extend(pack.flush(True))
        if rows:
            yield out(rows)

    return released(run)


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, step: int = STEP, penalties: tuple[int, int, int] = PENALTIES, close: int = 1, stream: int = STREAM) -> DataFrame:
    """One row for each piece of a document: see SCHEMA. path: the tokenizer's file, found on every executor."""
    from pyspark.sql import functions as F

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(packer(path, size, step, penalties, close, stream), SCHEMA)
