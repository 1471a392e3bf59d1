"""Toxicity by noisy-channel deobfuscation.

Writers hide words by look-alike signs, spaces between letters, separators and repeated letters. A token that shows any
of these becomes a lattice of readings with channel costs; Viterbi decoding under a character trigram model finds the
likeliest word, with a bonus for words known from training; a hidden letter (*) is one of the 40 commonest, or any that
goes on with a known word. The restored texts are scored by a lexicon of words and
beginnings of words, and a logistic regression over what the lexicon finds in a text. Character model, known words, lexicon and regression are all learned
from all labelled documents, by distributed counts and sums. Only the model reaches the driver: trigrams of letters, words that are at least KNOWN_SHARE
of all words (so at most 1 / KNOWN_SHARE), and the lexicon's units that pass its test.

Plain words are their own only reading and are not decoded unless they have a letter three times in a row, or twice and
aren't known. Tokens of more than LONG_TOKEN signs are decoded in stretches that overlap by half. Letters with gaps between
them are cut at wider gaps, and what they give as a whole is cut into its likeliest words too. Tokens of signs alone that
may all be letters are decoded; a number only counts as what it reads as if that is a known word.

Defined cases: null text counts as empty; texts without words score as the regression's intercept says. Without any
labels of either kind all scores are the share of label 1 (0 if there are none). Null doc_ids are scored; held_out is
null for them. Rows that repeat a doc_id are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Scratch, batches, fresh, mix, odd, released, rolling
from tickloom.llm.labels import learned, logistic_rows, remainder, sigmoid

#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "¡": "i", "&": "", "*": "", "#": "", "%": ""}
#: Channel costs, in nats: a sign read as a letter, such a sign left out, a separator left out, a hidden letter, letters
#: run together. And what a reading gains that is a known word of four letters or more.
READ, DROP, SKIP, HIDDEN, RUN = 0.5, 5.0, 1.0, 3.0, 0.5
KNOWN_BONUS = 7.0
#: Share of all words that a known word has at least, beside three occurrences.
KNOWN_SHARE = 1.5e-6
#: Minhashes by which near copies are found; different words that a task counts before it gives them.
COPIES, COUNTED = 4, 1 << 18
#: Signs of a stretch that is decoded at a time; longer tokens are decoded in stretches that overlap by half.
LONG_TOKEN = 40
#: Where a path has left all known words.
NO_WORD = "-"
LETTERS = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*~]{1,2}){2,}[^\W_](?!\S)")
EDGE = ".,;:?!\"'()[]{}<>…*%&#~^-_/\\"
REPEATED = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"(.)\1")
RUNS = re.compile(r"(.)\1{3,}")
GAPS = re.compile(r"[ .\-_*~]+")
SEPARATORS = re.compile(r"[ .\-_*~]")
LONG_RUN = re.compile(r"([^\w\s])\1\1+$")


def triples(words: Counter) -> Counter:
    """Counts of the trigrams of words, two blanks before each and one after."""
    out: Counter = Counter()
    for w, n in words.items():
        s = f"  {w} "
        for i in range(2, len(s)):
            out[s[i - 2 : i + 1]] += n
    return out


class CharModel:
    """Trigrams of the letters of words, with added counts and a fall back on single letters."""

    def __init__(self, triple: Counter):
        single: Counter = Counter()
        pair: Counter = Counter()
        for t, n in triple.items():
            single[t[2]] += n
            pair[t[:2]] += n
        total = sum(single.values()) + len(single) + 1
        self.single = {c: (n + 1) / total for c, n in single.items()}
        self.unknown = 1 / total
        self.triple, self.pair = dict(triple), dict(pair)

    @lru_cache(1 << 18)  # noqa: B019  one model lives as long as its process
    def cost(self, a: str, c: str) -> float:
        base = self.single.get(c, self.unknown)
        return -math.log((self.triple.get(a + c, 0) + 2 * base) / (self.pair.get(a, 0) + 2))


class Restorer:
    def __init__(self, words: Counter, known: set[str], triple: Counter | None = None):
        """triple: counts of the words' trigrams, where they have been taken already."""
        self.model, self.known = CharModel(triples(words) if triple is None else triple), known
        self.letters = "".join(c for c, _ in Counter({c: p for c, p in self.model.single.items() if c.isalpha()}).most_common(40))
        self.ready()

    def ready(self) -> None:
        """What is derived from the rest: beginnings of known words with the letters that go on, and the caches."""
        self.beginnings: dict[str, str] = {"": ""}
        for w in sorted(self.known):
            for i, c in enumerate(w):
                have = self.beginnings.setdefault(w[:i], "")
                if c not in have:
                    self.beginnings[w[:i]] = have + c
            self.beginnings.setdefault(w, "")
        self.decode = lru_cache(1 << 16)(self._decode)
        self.split = lru_cache(1 << 14)(self._split)

    def __getstate__(self) -> dict:
        return {"words": None, "model": (self.model.single, self.model.unknown, self.model.triple, self.model.pair), "known": self.known, "letters": self.letters}

    def __setstate__(self, state: dict) -> None:
        self.model = CharModel(Counter())
        self.model.single, self.model.unknown, self.model.triple, self.model.pair = state["model"]
        self.known, self.letters = state["known"], state["letters"]
        self.ready()

    def readings(self, sign: str, count: int) -> list[tuple[str, float]]:
        if sign.isalpha():
            if count == 1:
                return [(sign, 0.0)]
            return [(sign * 2, 0.0 if count == 2 else RUN), (sign, RUN * 2 if count == 2 else RUN)]
        if sign == "*":
            return [(c, HIDDEN) for c in self.letters] + [("", SKIP)] if count == 1 else [("", SKIP)]
        out = [(c, READ) for c in SIGNS.get(sign, "")] + [("", DROP if SIGNS.get(sign) else SKIP)]
        if count > 1:
            out += [(c * 2, READ) for c in SIGNS.get(sign, "")]
        return out

    def _decode(self, token: str) -> str:
        """The likeliest word behind a token: Viterbi over pairs of letters and beginnings of known words.

        A path's state is the beginning of a known word that it spells, or else its last two letters; what follows costs
        the same for all paths in a state, so the best one of each is enough.
        """
        paths: dict[tuple[str, str], tuple[float, str]] = {("  ", ""): (0.0, "")}
        cost, begin = self.model.cost, self.beginnings
        for run in re.finditer(r"(.)\1*", token):
            ahead: dict[tuple[str, str], tuple[float, str]] = {}
            if (c := run[0]).isalpha() and len(c) == 1:  # its own only reading
                for (pair, _), (paid, word) in paths.items():
                    own = word + c
                    key, add = (pair[1] + c, own if own in begin else NO_WORD), paid + cost(pair, c)
                    if key not in ahead or (add, own) < ahead[key]:
                        ahead[key] = (add, own)
                paths = ahead
                continue
            options = self.readings(run[1], len(run[0]))
            for (pair, start), (paid, word) in paths.items():
                known = begin.get(word, "") if run[0] == "*" and start == word else ""
                for letters, price in options + [(c, HIDDEN) for c in known if c not in self.letters]:
                    state, add = pair, paid + price
                    for c in letters:
                        add += cost(state, c)
                        state = state[1] + c
                    own = word + letters
                    key = (state, own if own in begin else NO_WORD)
                    if key not in ahead or (add, own) < ahead[key]:
                        ahead[key] = (add, own)
            paths = ahead
        return min((s + cost(k, " ") - KNOWN_BONUS * (len(w) > 3 and w in self.known), w) for (k, _), (s, w) in paths.items())[1]

    def token(self, token: str) -> list[str]:
        """The words of a token that isn't letters alone: those between its signs, and the one that they may hide."""
        out = LETTERS.findall(token)
        bare = LONG_RUN.sub("", token).strip(EDGE)
        if out and not bare.isalpha():
            out += self.restored(bare)
        elif not out and bare and all(SIGNS.get(c) for c in bare):
            out += self.hidden(bare)
        return out

    def hidden(self, token: str) -> list[str]:
        """The readings of a token without letters; a number stays one unless it reads as known words."""
        return [w for w in self.restored(token) if w in self.known or not token.isdigit()]

    def restored(self, token: str, glued: bool = False) -> list[str]:
        """The word that a token hides, of a long one those of overlapping stretches. glued: several may stand together."""
        token = RUNS.sub(r"\1\1\1", token)
        step = LONG_TOKEN // 2
        found = [self.decode(token[i : i + LONG_TOKEN]) for i in range(0, max(1, len(token) - step), step)]
        if glued or len(token) > LONG_TOKEN:
            found += [w for d in found for w in self.split(d)]
        return [w for w in found if w]

    def _split(self, word: str) -> list[str]:
        """The likeliest words behind letters without boundaries between words; none if that is one word."""
        cost, best, back = self.model.cost, [0.0] + [math.inf] * len(word), [0] * (len(word) + 1)
        for i in range(len(word)):
            state, price = "  ", best[i]
            for j in range(i + 1, min(len(word), i + LONG_TOKEN) + 1):
                price += cost(state, word[j - 1])
                state = state[1] + word[j - 1]
                total = price + cost(state, " ") - KNOWN_BONUS * (j - i > 3 and word[i:j] in self.known)
                if total < best[j]:
                    best[j], back[j] = total, i
        out, at = [], len(word)
        while at:
            out.append(word[back[at] : at])
            at = back[at]
        return out[::-1] if len(out) > 1 else []

    def words(self, text: str) -> list[str]:
        """The words of a text and, where signs, spaces or repetition may hide others, those too."""
        low = text.lower()
        tokens = low.split()
        out = list(filter(str.isalpha, tokens))
        for t in filterfalse(str.isalpha, tokens):
            if (s := t.strip(EDGE)).isalpha():
                out.append(s)
            else:
                out += self.token(t)
        for w in list(filter(DOUBLED.search, set(out))):
            if REPEATED.search(w):
                out += self.restored(w)
            elif w not in self.known:
                out += [x for x in self.restored(w) if x != w]
        for m in SPACED.finditer(low):
            for part in spaced_words(m[0]):
                token = SEPARATORS.sub("", part)
                if len(token) > 2:
                    out += self.hidden(token) if token.isdigit() else self.restored(token, glued=True)
        return out


def spaced_words(run: str) -> list[str]:
    """Single letters with separators between them, cut where gaps are wider, or blank where others aren't."""
    gaps = GAPS.findall(run)
    wide = {len(g) for g in gaps} == {1, 2}
    blank = not wide and {not g.strip() for g in gaps} == {True, False}
    out = [run[0]]
    for g, letter in zip(gaps, GAPS.split(run)[1:], strict=True):
        if wide and len(g) == 2 or blank and not g.strip():
            out.append(letter)
        else:
            out[-1] += g + letter
    return out if len(out) < 2 else [*out, run]


def minhashes(words: list[str]) -> list[int]:
    """COPIES minhashes of a text's sets of three words; one set of all words where they are fewer."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    sets = rolling(h, max(1, min(3, len(h))), 0) if len(h) else np.zeros(1, np.uint64)
    return [int(mix(sets * odd(s)).min()) for s in range(COPIES)]


def firsts(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Of texts (doc_id, text) the doc_ids without near copies, whose words would count as often as there are copies.

    A near copy shares two or more minhashes with texts of smaller doc_ids. Texts that share all are one before shuffles by minhash.
    """
    names = [f"m{s}" for s in range(COPIES)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text", 1 << 20):
            least = [minhashes(LETTERS.findall(t.lower())) for t in b.column("text").to_pylist()]
            columns = np.array(least, np.uint64).view(np.int64).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns)], names=["doc_id", *names])

    marked = texts.select("doc_id", "text").mapInArrow(released(run), "doc_id long, " + ", ".join(f"{n} long" for n in names))
    alone = scratch.write(marked.groupBy(*names).agg(F.min("doc_id").alias("doc_id")), "minhashes")
    each = alone.select("doc_id", F.posexplode(F.array(*names)).alias("s", "m"))
    own = each.groupBy("s", "m").agg(F.min("doc_id").alias("first"))
    seen = each.join(own, ["s", "m"]).groupBy("doc_id").agg(F.sum((F.col("first") < F.col("doc_id")).cast("int")).alias("n"))
    return scratch.write(seen.where("n < 2").select("doc_id"), "firsts")


#: Letters of the beginnings of words that the lexicon may hold besides whole words.
BEGIN = (4, 5, 6)


def units(words: set[str]) -> set[str]:
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in BEGIN))


class Toxicity:
    """A fitted scorer: call it with texts. Without a lexicon and weights, all scores are `share`."""

    def __init__(self, share: float, restore: Restorer, lexicon: dict[str, float]):
        self.share, self.restore, self.lexicon = share, restore, lexicon
        self.heads = {w[: BEGIN[0]] for w in lexicon if w[-1] == "*"}
        self.center = self.scale = self.weights = None

    def weight(self, word: str) -> float:
        """What the lexicon says about a word, by itself or its beginning; 0 if nothing."""
        get = self.lexicon.get
        own = get(word, 0.0)
        if word[: BEGIN[0]] in self.heads:
            own = max(own, *(get(word[:k] + "*", 0.0) for k in BEGIN if len(word) > k), 0.0)
        return own

    def features(self, words: list[str]) -> tuple[float, float, float, float]:
        """Of a text's restored words."""
        heads, n = self.heads, BEGIN[0]
        hits = [w for w in words if w in self.lexicon or w[:n] in heads]
        kinds = {w: x for w in set(hits) if (x := self.weight(w))}
        count = sum(w in kinds for w in hits)
        return (max(kinds.values(), default=0.0), math.log1p(count), math.log1p(len(kinds)), math.log1p(100 * count / max(1, len(words))))

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = (np.array([self.features(self.restore.words(t)) for t in texts]).reshape(-1, 4) - self.center) / self.scale
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def units_of(words: str) -> set[str]:
    return units(set(words.split(" "))) if words else set()


def counted(rows: DataFrame, column: str, find: Callable[[str], Iterable[str]], kinds: int = 1) -> DataFrame:
    """word, and n0 and on: how often `find` gives it of the column's texts, by their y if there are several kinds."""
    names = [f"n{k}" for k in range(kinds)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in names]

        def out() -> pa.RecordBatch:
            words = list(set().union(*held))
            counts = [pa.array([h[w] for w in words], pa.int64()) for h in held]
            for h in held:
                h.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *counts], names=["word", *names])

        for b in batches(it, column, 1 << 20):
            for t, y in zip(b.column(column).to_pylist(), b.column("y").to_pylist(), strict=True):
                held[y if kinds > 1 else 0].update(find(t))
            if sum(map(len, held)) > COUNTED:
                yield out()
        yield out()

    found = rows.select(column, "y").mapInArrow(released(run), "word string, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("word").agg(*(F.sum(n).alias(n) for n in names))


def restorer(texts: DataFrame, scratch: Scratch) -> Restorer:
    """The character model and the known words of all texts."""
    words = scratch.write(counted(texts, "text", plain_words), "words")
    total = words.agg(F.sum("n0")).first()[0] or 0
    known = words.where(F.col("n0") > max(2, KNOWN_SHARE * total)).select("word").toPandas()["word"]
    padded = F.concat(F.lit("  "), "word", F.lit(" "))
    grams = words.select("n0", padded.alias("s")).select("n0", "s", F.explode(F.sequence(F.lit(1), F.char_length("s") - 2)).alias("at"))
    grams = grams.groupBy(F.expr("substring(s, at, 3)").alias("gram")).agg(F.sum("n0").alias("n")).toPandas().sort_values("gram")
    return Restorer(Counter(), set(known), Counter(dict(zip(grams["gram"], grams["n"].tolist(), strict=True))))


def plain_words(text: str) -> list[str]:
    return [w for w in LETTERS.findall(text.lower()) if len(w) <= LONG_TOKEN]


def lexicon(counts: DataFrame, total: list[int]) -> dict[str, float]:
    """Log odds of units (word, n0, n1) whose counts of documents by class differ by a log-likelihood ratio of `strong`.

    That is what chance gives one of all the units that stand in three documents or more, 20 at most. total: documents.
    """
    seen = counts.where("n1 > 0").withColumn("n", F.col("n0") + F.col("n1"))
    strong = min(20.0, 2 * math.log(max(seen.where("n > 2").count(), 20)))
    share = total[1] / sum(total)
    n0, n1, n = F.col("n0"), F.col("n1"), F.col("n")
    ratio = 2 * (n1 * F.log(n1 / (n * share)) + F.when(n0 > 0, n0 * F.log(n0 / (n * (1 - share)))).otherwise(0.0))
    odds = F.log((n1 + 0.5) / (total[1] + 1)) - F.log((n0 + 0.5) / (total[0] + 1))
    found = seen.where((n1 / n > share) & (ratio >= strong)).select("word", odds.alias("odds")).where("odds >= 2").toPandas()
    return dict(zip(found["word"], found["odds"].tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Toxicity:
    """Learns from all documents with a label for which `learn`, a condition on the column doc_id, holds.

    Texts, and then their restored words, are kept in the shared folder while the fit lasts.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    texts = scratch.write(learned(docs, labels, label, learn, text, doc_id), "texts")
    n, ones = texts.agg(F.count(F.lit(1)), F.sum("y")).first()
    share = ones / n if n else 0.0
    if not 0 < share < 1:
        scratch.drop()
        return Toxicity(share, Restorer(Counter(), set()), {})
    restore = restorer(texts, scratch)
    sent = spark.sparkContext.broadcast(restore)

    def restored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "text"):
            words = [" ".join(sent.value.words(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("first"), pa.array(words, pa.string())], names=["y", "first", "words"])

    marked = texts.join(firsts(texts, scratch).withColumn("first", F.lit(True)), "doc_id", "left")
    rows = scratch.write(marked.select("y", "first", "text").mapInArrow(released(restored), "y int, first boolean, words string"), "restored")
    scratch.drop("texts")
    alone = rows.where("first")
    by = dict(alone.groupBy("y").agg(F.count(F.lit(1))).collect())
    total = [by.get(0, 0), by.get(1, 0)]
    counts = scratch.write(counted(alone, "words", units_of, 2), "units")
    model = Toxicity(share, restore, lexicon(counts, total) if min(total) else {})
    whole = spark.sparkContext.broadcast(model)
    names = ["f0", "f1", "f2", "f3"]

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "words"):
            x = np.array([whole.value.features(t.split(" ") if t else []) for t in b.column("words").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), b.column("y")], names=[*names, "y"])

    found = rows.select("words", "y").mapInArrow(released(features), ", ".join(f"{c} double" for c in names) + ", y int")
    model.center, model.scale, model.weights = logistic_rows(scratch.write(found, "features"), names)
    for b in (sent, whole):
        b.unpersist()
    scratch.drop()
    return model


def scored(docs: DataFrame, model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a column that holds the model's scores of the texts. model: called with a list of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = fresh("text_read", docs)
    rows = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    names = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, own):
            score = np.asarray(sent.value(b.column(own).to_pylist()), np.float64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(score)], names=[*names, column])

    kind = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return rows.mapInArrow(released(run), kind)


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels are learned only where crc32 mod fold isn't held."""
    model = fit(docs, labels, remainder(F.col("doc_id"), fold) != held, text, doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    result = scored(rows, model)
    return result.select("doc_id", (remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with a score below 0.5, with all their columns; learns from all labels."""
    model = fit(docs, labels, F.lit(True), text, doc_id)
    score = fresh("score", docs)
    return scored(docs, model, text, score).where(F.col(score) < 0.5).select(*docs.columns)
