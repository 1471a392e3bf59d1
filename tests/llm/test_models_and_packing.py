"""Fingerprints, classifiers, the language model, mixing, packing and the pipeline."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import labels, lm, mixing, order_minhash, packing, quality, queries, toxicity
from tickloom.llm.common import long_hash
from tickloom.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signature_expected(text: str, k: int = 8, size: int = 64, tuple_size: int = 2) -> list[tuple]:
    """The selected k-mers of each order, in text order, by the operator's own hashes and no short cuts."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = order_minhash.numbered(order_minhash.kmers(code, k))
    out = []
    for rank in order_minhash.ranks(h, size).tolist():
        chosen = sorted((sorted(range(len(h)), key=lambda i: (rank[i], i)) * tuple_size)[:tuple_size])
        out.append(tuple(h[chosen].tolist()))
    return out


def test_signatures_select_the_least_of_each_order():
    rng = np.random.default_rng(2)
    texts = ["", "ab", "abcdefgh", "ab" * 300, "".join(map(chr, rng.integers(97, 110, 3000))), "中文字" * 40 + "x", "".join(map(chr, rng.integers(97, 99, 9000)))]
    texts += [texts[4][:2500] + texts[5], texts[6][100:]]
    for a in texts:
        for b in texts:
            x, y = signature_expected(a), signature_expected(b)
            same = np.array([p == q for p, q in zip(x, y, strict=True)])
            assert ((order_minhash.signature(a) == order_minhash.signature(b)) >= same).all()
            assert ((order_minhash.signature(a) == order_minhash.signature(b)) != same).sum() <= 1  # 16 bits a component


def test_occurrences_are_numbered_in_text_order():
    h = np.array([7, 9, 7, 7, 9], np.uint64) << np.uint64(40)
    n = order_minhash.numbered(h)
    assert len(set(n.tolist())) == 5 and n[:2].tolist() == order_minhash.numbered(h[:2]).tolist()


def test_signatures_depend_on_order():
    a = "".join(f"{i:04d}" for i in range(400))
    half = len(a) // 2
    swapped = order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(a[half:] + a[:half]))
    assert swapped < 0.8 < order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(a[:-8]))


def test_likeness_falls_with_edits_and_orders_are_independent():
    rng = np.random.default_rng(12)
    text = "".join(map(chr, rng.integers(97, 123, 2000)))
    likes = []
    for edits in (0, 2, 10, 40, 200):
        t = list(text)
        for i in rng.choice(2000, edits, replace=False):
            t[i] = "A"
        likes.append(order_minhash.likeness(order_minhash.signature(text), order_minhash.signature("".join(t))))
    assert likes[0] == 1 and all(a > b for a, b in zip(likes, likes[1:], strict=False)) and likes[-1] < 0.3
    # A text of four k-mers has six pairs; independent orders choose them all.
    h = order_minhash.numbered(order_minhash.kmers(np.arange(97, 108, dtype=np.uint32), 8))
    assert len({tuple(x) for x in np.sort(order_minhash.least(h, 64, 2), axis=1).tolist()}) == 6


def test_edited_pairs(docs, corpus):
    got = {r.doc_id: r for r in order_minhash.edited_pairs(docs(corpus)).collect()}
    rows = sorted(corpus)
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        a, b, c = (order_minhash.signature(x) for x in (t, edited, nxt))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == a.astype(">u2").tobytes().hex() and r.edited_fingerprint == b.astype(">u2").tobytes().hex()
        assert (r.near_edited, r.near_next) == (order_minhash.likeness(a, b), order_minhash.likeness(a, c))


def test_edited_pairs_odd_rows(docs):
    assert order_minhash.edited_pairs(docs([])).collect() == []
    (one,) = order_minhash.edited_pairs(docs([(5, "abcdefgh")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1
    many = order_minhash.edited_pairs(docs([(None, "first text"), (3, "x"), (3, "x"), (-8, None)])).collect()
    assert sorted(str(r.doc_id) for r in many) == ["-8", "3", "3", "None"]


def labelled(n: int, seed: int = 3) -> list[tuple[int, str, int, int]]:
    """doc_id, text, quality, toxic."""
    rng = np.random.default_rng(seed)
    plain = [f"{a}{b}" for a in ("ba", "de", "mi", "ro", "su") for b in ("ka", "lo", "ne", "ti", "pu")]
    out = []
    for i in range(n):
        words = list(rng.choice(plain, rng.integers(20, 120)))
        bad, junk = i % 3 == 0, i % 4 == 0
        if bad:
            for k in rng.integers(0, len(words), 3):
                words[k] = str(rng.choice(["scoundrel", "sc0undrel", "fiendish", "f i e n d i s h", "fiiiiendish"]))
        if junk:
            words = [w + "!!!" for w in words] if i % 8 else [words[0]] * len(words)
            words = [w.upper() for w in words] if i % 8 else words
            if bad:
                words[3] = "scoundrel"
        out.append((i, " ".join(words), int(not junk), int(bad)))
    return out


@pytest.fixture(scope="module")
def marked():
    return labelled(500)


@pytest.fixture(scope="module")
def label_table(spark, marked):
    return spark.createDataFrame([(i, q, t) for i, _, q, t in marked] + [(10_000, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "fold", "held", "column", "least"), [(toxicity.toxicity, 5, 0, 3, 0.95), (quality.quality, 3, 1, 2, 0.95)])
def test_classifiers_on_held_out_rows(docs, marked, label_table, score, fold, held, column, least):
    rows = [(i, t) for i, t, _, _ in marked] + [(900, None), (901, ""), (902, "\x00 ퟿" * 4000), (None, "some text"), (7, marked[7][1])]
    got = score(docs(rows), label_table, fold, held).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[column] for r in marked}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % fold == held)
    out = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(out) >= least, np.mean(out)


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_classifiers_without_rows_or_labels(spark, docs, score):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score(docs([]), empty).collect() == []
    (r,) = score(docs([(1, "a")]), empty).collect()
    assert 0 <= r.score <= 1


def test_sample_is_bounded_and_leaves_out_what_is_held(docs, label_table, marked):
    rows = docs([(i, t) for i, t, _, _ in marked])
    from pyspark.sql import functions as F

    learn = labels.remainder(F.col("doc_id"), 5) != 0
    got = labels.sample(rows, label_table, "toxic", learn, most=50)
    held = {t for i, t, _, _ in marked if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(got) == 50 and not held & {t for t, _ in got} and got == labels.sample(rows.repartition(3), label_table, "toxic", learn, most=50)


def test_sample_takes_one_text_a_doc_id_and_long_ones_too(docs, spark):
    from pyspark.sql import functions as F

    marks = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = docs([(1, "copy")] * 60 + [(1, "other"), (2, "x" * 50_000), (3, None)])
    got = labels.sample(rows, marks, "toxic", F.lit(True), most=50)
    assert len(got) == 3 and {len(t) for t, _ in got if t not in ("copy", "other")} == {0, 50_000}
    assert sorted(len(t) for t, _ in labels.sample(rows, marks, "toxic", F.lit(True), signs=100)) in ([0, 4], [0, 5])


def test_toxicity_learns_from_all_labelled_rows(docs, spark):
    """Of more labelled documents than a sample holds, words that only the later ones have count too."""
    n = 5600
    by = [i for i in np.argsort(long_hash(np.arange(n)), kind="stable").tolist() if zlib.crc32(str(i).encode()) % 5]
    late = set(by[labels.MOST :])
    assert len(late) > 200
    rng = np.random.default_rng(8)
    words = np.array([f"{a}{b}" for a in ("ba", "de", "mi", "ro", "su") for b in ("ka", "lo", "ne", "ti", "pu")])
    plain = [" ".join(words[rng.integers(0, len(words), 12)]) for _ in range(n + 40)]
    bad = lambda i: i % 4 == 0
    rows = [(i, plain[i] + (" fiendish" if i in late else " scoundrel") * bad(i)) for i in range(n)]
    rows += [(n + i, plain[n + i] + " fiendish" * bad(i)) for i in range(40)]
    marks = spark.createDataFrame([(i, 1, int(bad(i))) for i in range(n)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs(rows), marks).collect()}
    assert [got[n + i] for i in range(40)] == [int(bad(i)) for i in range(40)]


def test_toxicity_counts_are_those_of_plain_loops(docs, marked, label_table):
    """Known words, trigrams, lexicon and weights, with near copies left out of the lexicon."""
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t, _, _ in marked] + [(10_000, marked[1][1] + " baka")]
    got = toxicity.fit(docs(rows).repartition(5), label_table, F.lit(True))
    y = {i: t for i, _, _, t in marked} | {10_000: 0}
    counts = Counter(w for _, t in rows for w in toxicity.plain_words(t))
    plain = toxicity.Restorer(counts, {w for w, n in counts.items() if n > 2})
    assert got.restore.known == plain.known and got.restore.model.triple == plain.model.triple
    seen, df, total = set(), (Counter(), Counter()), [0, 0]
    for i, t in rows:
        least = list(enumerate(toxicity.minhashes(toxicity.LETTERS.findall(t.lower()))))
        if sum(m in seen for m in least) < 2:
            total[y[i]] += 1
            df[y[i]].update(toxicity.units(set(got.restore.words(t))))
        seen.update(least)
    assert sum(total) < len(rows)  # the near copy, at least
    several = sum(n + df[0][w] > 2 for w, n in df[1].items())
    strong, share, want = min(20.0, 2 * math.log(max(several, 20))), total[1] / sum(total), {}
    for w, n1 in df[1].items():
        n0 = df[0][w]
        n = n0 + n1
        ratio = 2 * (n1 * math.log(n1 / (n * share)) + (n0 and n0 * math.log(n0 / (n * (1 - share)))))
        odds = math.log((n1 + 0.5) / (total[1] + 1)) - math.log((n0 + 0.5) / (total[0] + 1))
        if n1 / n > share and ratio >= strong and odds >= 2:
            want[w] = odds
    assert got.lexicon == pytest.approx(want) and "scoundrel" in want
    x = np.array([got.features(got.restore.words(t)) for _, t in rows])
    assert got.center == pytest.approx(x.mean(axis=0)) and got.scale == pytest.approx(x.std(axis=0) + 1e-6)
    assert got.weights == pytest.approx(labels.logistic((x - got.center) / got.scale, np.array([y[i] for i, _ in rows])), abs=1e-6)


def test_quality_knows_how_rare_a_label_is():
    """Texts that say nothing are scored by the share of label 1, whatever the balance of training batches."""
    rng = np.random.default_rng(14)
    text = lambda: " ".join(rng.choice(["ba", "de", "mi", "ro"], 40))
    model = quality.Network([(text(), int(i % 10 == 0)) for i in range(200)], steps=60)
    score = model([text() for _ in range(200)])
    assert abs(score.mean() - 0.1) < 0.08 and (score >= 0.5).mean() < 0.05


def test_responses_are_those_of_a_plain_convolution():
    rng = np.random.default_rng(15)
    x, table = rng.integers(0, 256, (3, quality.CHUNK)).astype(np.uint8), rng.normal(size=(quality.WIDTH, 256, 4)).astype(np.float32)
    got = quality.responses(x, table)
    for i, at, f in ((0, 0, 0), (1, 17, 3), (2, quality.CHUNK - quality.WIDTH, 2)):
        assert got[i, at, f] == pytest.approx(sum(table[k, x[i, at + k], f] for k in range(quality.WIDTH)), abs=1e-4)


@pytest.mark.parametrize(("hidden", "word"), [("sc0undrel", "scoundrel"), ("s.c.o.u.n.d.r.e.l", "scoundrel"), ("fi3ndish", "fiendish"), ("fiendi$h", "fiendish"), ("fiendiiiiish", "fiendish")])
def test_restoring(hidden, word):
    model = toxicity.Restorer(Counter({"scoundrel": 9, "fiendish": 9, "baka": 50, "delo": 50, "rone": 40}), {"scoundrel", "fiendish"})
    assert word in model.words(f"baka {hidden} delo")
    assert word in model.words(" ".join(word))


RESTORED = Counter({"scoundrel": 9, "fiendish": 9, "baka": 50, "delo": 50, "rone": 40, "toad": 9, "idiot": 9})


@pytest.mark.parametrize("gap", [" ", "  ", "   "])
def test_restoring_spaced_phrases_word_by_word(gap):
    model = toxicity.Restorer(RESTORED, set(RESTORED))
    phrase = ["rone", "scoundrel", "fiendish", "delo", "idiot", "baka", "scoundrel", "toad", "rone", "delo", "idiot"]
    assert len("".join(phrase)) > toxicity.LONG_TOKEN
    for sep in (" ", "-"):
        found = model.words("baka, " + gap.join(sep.join(w) for w in phrase) + " delo.")
        assert {"scoundrel", "fiendish", "idiot", "toad"} <= set(found)


def test_restoring_long_tokens():
    model = toxicity.Restorer(RESTORED, set(RESTORED))
    assert "scoundrel" in model.words("baka-" * 8 + "sc0undrel" + "-delo" * 8)
    assert "fiendish" in model.words("f" + "i" * 60 + "endish")
    assert "idiot" in model.words("baka_delo_rone_baka_delo_rone_baka_delo_1d10t_rone_baka_delo")


@pytest.mark.parametrize(("hidden", "word"), [("i  d  i  o  t", "idiot"), ("i- d- i- o- t", "idiot"), ("704", "toa"), ("70@", "toa"), ("1d10t", "idiot"), ("idioot", "idiot"), ("scounddrel", "scoundrel")])
def test_restoring_without_cheap_tests_before(hidden, word):
    model = toxicity.Restorer(RESTORED + Counter({"toa": 9}), {*RESTORED, "toa"})
    assert word in model.words(f"baka {hidden} delo")
    assert model.words("2024") == []  # a number that reads as no known word


def test_decoding_finds_known_words_among_many_paths():
    rng = np.random.default_rng(13)
    words = Counter({"".join(map(chr, rng.integers(97, 123, 6))): 1 for _ in range(300)})
    model = toxicity.Restorer(words + Counter({"zqxjkv": 1}), {"zqxjkv"})
    for token in ("zqx*kv", "z*x*k*", "z.q.x.j.k.v"):
        best = min(everything(model, token, "zqxjkv"))
        assert (model.decode(token) == best[1]) and (token != "zqx*kv" or best[1] == "zqxjkv")


def everything(model, token, known):
    """(cost, word) of all readings of a token."""
    paths = [("", 0.0)]
    for run in re.finditer(r"(.)\1*", token):
        options = model.readings(run[1], len(run[0]))
        paths = [(w + x, c + p) for w, c in paths for x, p in options + ([(known[len(w)], toxicity.HIDDEN)] if run[0] == "*" and known.startswith(w) and w != known and known[len(w)] not in model.letters else [])]
    for w, c in paths:
        s = f"  {w} "
        yield c + sum(model.model.cost(s[i - 2 : i], s[i]) for i in range(2, len(s))) - toxicity.KNOWN_BONUS * (w in model.known), w


def test_decoding_takes_the_best_path():
    counts = Counter({"idiot": 5, "toad": 3, "tool": 8})
    model = toxicity.Restorer(counts, set())
    for token in ("1d10t", "t00l", "t0@d"):
        best, paths = None, [("", 0.0)]
        for run in re.finditer(r"(.)\1*", token):
            paths = [(w + x, c + p) for w, c in paths for x, p in model.readings(run[1], len(run[0]))]
        for w, c in paths:
            s = f"  {w} "
            total = c + sum(model.model.cost(s[i - 2 : i], s[i]) for i in range(2, len(s)))
            best = min(best, (total, w)) if best else (total, w)
        assert model.decode(token) == best[1]


def plain_score(net: quality.Network, text: bytes) -> float:
    """The network's probability, one place of one chunk at a time."""
    pooled = np.zeros(quality.HIDDEN)
    for at in quality.starts(len(text)).tolist():
        part = text[at : at + quality.CHUNK]
        grams = [part[i : i + quality.GRAM] for i in range(max(1, len(part) - quality.GRAM + 1))]
        part = part.ljust(quality.CHUNK, b"\0")
        places = range(quality.CHUNK - quality.WIDTH + 1)
        top = [max(sum(float(net.table[k, part[i + k], f]) for k in range(quality.WIDTH)) for i in places) for f in range(quality.FILTERS)]
        u = np.array([max(t, 0.0) for t in top] + [len(set(grams)) / len(grams)])
        pooled = np.maximum(pooled, u @ net.a + net.b)
    return float(1 / (1 + np.exp(-(pooled @ net.w + net.c[0]))))


NETWORK_TEXTS = ["some words of a text", "", "junk! " * 30, " ".join(f"word{i * 7 % 31}" for i in range(140)), "中文 text"]


def test_network_scores_are_those_of_plain_loops():
    net = quality.Network([("abc " * i, i % 2) for i in range(6)], steps=5)
    assert net(NETWORK_TEXTS).tolist() == pytest.approx([plain_score(net, t.encode()) for t in NETWORK_TEXTS], abs=1e-5)


def test_network_gradients_are_those_of_differences():
    net = quality.Network([])
    for name in ("table", "a", "b", "w", "c"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.table += 0.05
    x, have, owner = quality.cut([t.encode() for t in NETWORK_TEXTS])
    y = np.array([1, 0, 0, 1, 1.0])
    found = net.gradients(x, have, owner, y)

    def loss() -> float:
        top = quality.responses(x, net.table).max(axis=1)
        z = np.maximum(np.hstack([np.maximum(top, 0), quality.novelty(x, have)[:, None]]) @ net.a + net.b, 0)
        p = np.array([labels.sigmoid(z[owner == i].max(axis=0) @ net.w + net.c)[0] for i in range(len(y))])
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    rng = np.random.default_rng(16)
    for param, grad in zip((net.table, net.a, net.b, net.w, net.c), found, strict=True):
        flat, given = param.reshape(-1), np.asarray(grad).reshape(-1)
        some = np.flatnonzero(given)
        some = rng.choice(some, min(20, len(some)), replace=False)
        assert len(some)
        for i in [*some.tolist(), 0]:
            here, step = flat[i], 1e-6
            flat[i] = here + step
            up = loss()
            flat[i] = here - step
            down = loss()
            flat[i] = here
            assert given[i] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_chunks_cover_whole_texts():
    for n in (0, 1, 511, 512, 513, 2000, 5003):
        at = quality.starts(n)
        covered = set()
        for a in at:
            covered.update(range(int(a), int(a) + quality.CHUNK - quality.WIDTH + 1))
        assert covered >= set(range(max(0, n - quality.WIDTH + 1))) and at[-1] + quality.CHUNK >= n


def lm_expected(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tok = [(i, [*WORD.findall(lower(t)), None]) for i, t in rows]
    train = [t for i, t in tok if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    total, kinds = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip([None, *t[:-1]], t, strict=True))
    weight = dict.fromkeys((v for v, _ in pairs), 1.0)
    for (v, _), n in pairs.items():
        weight[v] -= (n - 0.75) / c[v]
    once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
    cut = max(0.05, once / (once + 2 * twice))
    single = lambda w: (c[w] - cut) / total if w in c else cut * kinds / total
    out = []
    for i, t in tok:
        s = 0.0
        for v, w in zip([None, *t[:-1]], t, strict=True):
            rest = weight.get(v, 1.0)
            s += math.log10((pairs[v, w] - 0.75) / c[v] + rest * single(w) if (v, w) in pairs else max(rest, 1e-6) * single(w))
        out.append((i, len(t), sum(w in c for w in t), sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in t), s))
    return out, total


@pytest.mark.parametrize(("segments", "split"), [(None, 1 << 16), (8, 1), (32, 40)])
def test_lm(docs, corpus, segments, split):
    rows = [*corpus, (None, "unlearned words w1 w2"), (7, "w1 w2 w1 w2"), (7, "w1 w2 w1 w2")]
    got = lm.lm_scores(docs(rows), segments=segments, split=split).collect()
    want, total = lm_expected(rows)
    key = lambda r: (str(r[0]), r[1], round(r[3], 6))
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    assert len(found) == len(want) and {r.train_tokens for r in got} == {total}
    for a, b in zip(found, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and abs(a[4] - b[4]) / b[1] < 0.02, (a, b)


def test_query_keeps_pairs_seen_once(spark, docs, tmp_path):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(40)]
    learn, other = [i for i in range(40) if not held[i]], held.index(True)
    docs([(learn[0], "alpha beta"), (learn[1], "gamma delta"), (other, "alpha beta")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op6_lm_scores(spark, str(tmp_path)).collect()}
    # 6 tokens: four words once and the end twice
    cut = 4 / 6
    once, end = (1 - cut) / 6, (2 - cut) / 6
    first = 0.25 / 2 + (1 - 2 * 0.25 / 2) * once
    want = math.log10(first) + math.log10(0.25 + 0.75 * once) + math.log10(0.25 + 0.75 * end)
    assert got[other].held_out and got[other].score == pytest.approx(want, abs=0.02)


def test_frequent_contexts_are_cut(docs):
    model = lm.train(docs([(i, f"the w{i} the x{i}") for i in range(200)]), segments=8, split=1)
    facts = model.facts
    the = np.argmax(facts.cut_parts)
    cells = facts.cells().tolist()
    assert len(facts.cut_ids) == 2 and facts.cut_parts[the] == -(-400 // (facts.tokens // 8)) >= 3
    assert sum(facts.cut_ids[the] * facts.words <= c < (facts.cut_ids[the] + 1) * facts.words for c in cells) == facts.cut_parts[the]
    # 400 different successors, each seen once
    assert facts.cut_weights[the] == pytest.approx(0.75)
    model.drop()


def test_lm_of_words_seen_once_is_finite(docs):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(40)]
    got = lm.lm_scores(docs([(held.index(False), "a b c"), (held.index(True), "c a z")])).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_without_training(docs):
    assert lm.lm_scores(docs([])).collect() == []
    (r,) = lm.lm_scores(docs([(None, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score, r.held_out) == (3, 0, 0, 0.0, None)


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 0), (1, 1 << 40), (1000, 5000), (3000, (1 << 63)), (500, 500)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True)) if n else np.zeros(0, np.uint64)
    data = np.concatenate([np.zeros(3, np.uint64), *lm.EliasFano.of(values, top).arrays()])
    ef, end = lm.EliasFano.read(data, 3)
    assert end == len(data) and ef.get(np.arange(n)).tolist() == values.tolist()
    probe = np.unique(np.concatenate([values, rng.integers(0, top, 200, dtype=np.uint64, endpoint=True)]))
    at = ef.find(probe)
    known = set(values.tolist())
    for x, i in zip(probe.tolist(), at.tolist(), strict=True):
        assert (i >= 0) == (x in known) and (i < 0 or values[i] == x)
    if n:
        middle = np.full(len(probe), n // 2)
        inside = ef.find(probe, middle, np.full(len(probe), n))
        assert all(i < 0 or i >= n // 2 for i in inside.tolist())


def test_mixing_meets_targets(docs, marked, label_table):
    rows = [(i, t) for i, t, _, _ in marked] + [(900, None), (901, " "), (None, "baka delo")]
    got = mixing.mixing(docs(rows), label_table, targets=(0.1, 0.8, 0.02, 0.08)).collect()
    assert len(got) == len(rows)
    tokens = np.array([r.tokens for r in got], float)
    p, rate = np.array([r.p for r in got]), np.array([r.rate for r in got])
    assert (rate >= 0).all() and rate[tokens == 0].tolist() == [1.0, 1.0] and np.allclose(p.sum(axis=1), 1)
    assert (tokens * rate) @ p / tokens.sum() == pytest.approx([0.1, 0.8, 0.02, 0.08], abs=0.01)
    for bad in ((0.5, 0.5), (0.5, 0.6, -0.1, 0.0), (0.3, 0.3, 0.3, 0.3)):
        with pytest.raises(ValueError):
            mixing.mixing(docs(rows), label_table, targets=bad)


def test_mixing_solves_the_least_squares():
    """Many steps end where the gradient vanishes, but for rates held at zero."""
    rng = np.random.default_rng(4)
    tokens, p = rng.integers(1, 50, 60).astype(float), rng.dirichlet((0.3, 0.3, 0.3), 60)
    total, share, goal, pull = tokens.sum(), tokens @ p / tokens.sum(), np.array([0.6, 0.3, 0.1]), 0.001
    residuals, rate = np.zeros((0, 3)), 1 / (1 + pull)
    for _ in range(200):
        _, start = mixing.rates(tokens, p, residuals, rate, pull)
        residuals = np.vstack([residuals, (goal - (tokens * start) @ p / total) / share])
    r, _ = mixing.rates(tokens, p, residuals, rate, pull)
    gradient = p @ (((tokens * r) @ p / total - goal) / share) + pull * (r - 1)
    assert np.abs(gradient[r > 0]).max() < 1e-3 and (gradient[r == 0] >= -1e-3).all()
    assert (tokens * r) @ p / total == pytest.approx(goal, abs=0.01)


def test_resampling_keeps_columns_and_expectation(docs, marked, label_table):
    rows = docs([(i, t) for i, t, _, _ in marked])
    out = mixing.resampled(rows, label_table, names=("quality",), targets=(0.05, 0.95), budget=1.3)
    good = {i for i, _, q, _ in marked if q}
    kept = Counter(r.doc_id for r in out.collect())
    assert out.columns == rows.columns and good <= set(kept)
    assert mixing.resampled(docs([]), label_table, targets=(0.25,) * 4).collect() == []


ODD = ["", " \n\t", "<|endoftext|> a<|startoftext|>. b", "don't it's. ΣΑΣ Σ! café café ½ 12.5% (x) --- a\x1cb 　c d", "İstanbul!!! ß ẞ ﬁ ǅ", "a\x0bb\x0cc", "中文字 text。 ok", "<|endoftext|>.,;", "x" * 3000, "word*** %%%. !!??", "Mixed CASE Words's", "́x ẞ y̧z"]


def test_ids_are_the_tokenizers(corpus):
    from tokenizers import Tokenizer

    texts = ODD + [t or "" for _, t in corpus]
    plain = Tokenizer.from_file(tokenizer_file())
    ids, count, marks = packing.Encoder(tokenizer_file())(pa.array(texts))
    assert len(marks) == len(ids)
    for own, text in zip(np.split(ids, np.cumsum(count)[:-1]), texts, strict=True):
        assert own.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("size", [64, 2048])
def test_packing_is_a_round_trip(docs, corpus, size):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(ODD))]
    got = packing.pack(docs(rows), tokenizer_file(), size=size).collect()
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    padding, total = 0, 0
    for ps in sequences.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding <= 0.02 * total


def test_packing_odd_rows(docs):
    assert packing.pack(docs([]), tokenizer_file()).collect() == []
    got = packing.pack(docs([(None, None), (2, "a"), (2, "a")]), tokenizer_file()).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) in ([("2", 2), ("2", 2), ("None", 1)], [("2", 1), ("2", 1), ("2", 2), ("None", 1)])


def price(n: int, size: int) -> int:
    return 0 if n & (n - 1) == 0 else size - n


def test_cuts_are_the_best():
    rng = np.random.default_rng(8)
    for size in (32, 40):
        for _ in range(30):
            pos = np.array([0, *np.cumsum(rng.integers(1, 20, 30))])
            pen = np.array([0, *rng.integers(0, 9, 30)])
            cost = [0] + [math.inf] * 30
            for j in range(1, 31):
                for i in range(j):
                    n = int(pos[j] - pos[i])
                    if n <= size:
                        cost[j] = min(cost[j], cost[i] + price(n, size) + int(pen[j]))
            ends = [0, *packing.way(packing.best_cuts(pos, pen, size), 30)]
            steps = [(int(pos[b] - pos[a]), int(pen[b])) for a, b in zip(ends, ends[1:], strict=False)]
            assert sum(price(n, size) + p for n, p in steps) == cost[30] and all(n <= size for n, _ in steps)


def test_a_stream_in_parts_is_packed_like_the_whole():
    rng = np.random.default_rng(9)
    docs = [(i, rng.integers(0, 99, n).astype(np.int32), rng.random(n) < 0.05) for i, n in enumerate(rng.integers(1, 400, 300))]

    def run(stream):
        packer = packing.Packer(64, 8, (0, 2, 6), 0, stream)
        rows = [r for d in docs for r in packer.add(*d)]
        assert stream > 1 << 20 or rows  # some are given out before the end
        return rows + list(packer.flush(True))

    whole = run(1 << 30)
    assert run(500) == whole == run(3000)
    assert sum(r[2] for r in whole) == sum(len(d[1]) for d in docs)


def test_packing_more_than_a_stream(docs):
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(f"v{x}." for x in rng.integers(0, 50, 3000))) for i in range(12)]
    got = packing.pack(docs(rows).coalesce(1), tokenizer_file(), stream=1 << 14).collect()
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and sum(filled.values()) == sum({r.doc_id: r.doc_tokens for r in got}.values()) > 1 << 17
    assert sum(price(n, 2048) for n in filled.values()) <= 0.01 * sum(filled.values())


def test_pipeline(spark, docs, marked, label_table, tmp_path):
    import corpus_pipeline

    rows = [(i, t) for i, t, _, _ in marked] + [(2000 + i, marked[i][1]) for i in range(0, 200, 2)] + [(3000, None), (None, "no id"), (3001, "")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    label_table.write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"{i}"))
        at = spark.read.parquet(str(tmp_path / f"{i}"))
        seen.append(Counter(r.doc_id for r in at.select("doc_id").collect()))
        assert i == 4 or at.columns == docs([]).columns
    good = {i for i, _, q, t in marked if q and not t}
    bad = {i for i, _, _, t in marked if t}
    assert len(bad & set(seen[0])) <= 0.05 * len(bad) and len(good - set(seen[0])) <= 0.02 * len(good)
    assert not any(2000 + i in seen[1] for i in range(0, 200, 2)) and sum((3000 in seen[1], 3001 in seen[1])) == 1
    assert set(seen[2]) <= set(seen[1]) and set(seen[4]) == set(seen[3])
    assert len((good & set(seen[2])) - set(seen[3])) <= 0.02 * len(good)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(seen[4].values())
