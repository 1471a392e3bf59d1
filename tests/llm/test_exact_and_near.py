"""Exact copies, SimHash, line and passage deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tickloom.llm import exact_dedup, line_dedup, simhash, substring_dedup
from tickloom.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def strip(t: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def exact_expected(rows):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        g = groups[strip(t)]
        keep = min(g)[1]
        out.append((i, keep, len(g), keep == i, hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [64 << 20, 3000])
def test_exact(docs, corpus, most):
    got = exact_dedup.exact_dedup(docs(corpus), most=most)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == exact_expected(corpus)


def test_exact_odd_rows(docs):
    assert exact_dedup.exact_dedup(docs([])).collect() == []
    rows = [(None, "a b"), (3, "ab"), (3, "ab"), (2, "a  b"), (9, "c"), (None, "d")]
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs(rows)).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (3, 2, 4, False), (3, 2, 4, False), (2, 2, 4, True), (9, 9, 1, True), (None, None, 1, True)], key=str)
    kept = exact_dedup.drop_copies(docs(rows))
    assert kept.columns == docs([]).columns and sorted(map(str, [r.doc_id for r in kept.collect()])) == ["2", "9", "None"]
    same = exact_dedup.drop_copies(docs([(3, "a b")] * 4 + [(5, "ab")] + [(None, "none")] * 3 + [(3, "other")])).collect()
    assert sorted((str(r.doc_id), r.text) for r in same) == [("3", "a b"), ("3", "other"), ("None", "none")]


def test_trie_spills_and_keeps_everything(tmp_path):
    rng = np.random.default_rng(1)
    keys = [bytes(rng.integers(97, 100, rng.integers(0, 30)).astype(np.uint8)) for _ in range(3000)]
    keys = [b"prefix" + k for k in keys] + keys  # a branching above earlier spills
    trie = exact_dedup.Trie(4000, f"file:{tmp_path}/spilled")
    want: dict[bytes, tuple] = {}
    for i, k in enumerate(keys):
        payload = (i % 5, i, 1)
        trie.add(k, payload)
        want[k] = exact_dedup.better(want[k], payload) if k in want else payload
    assert len(list((tmp_path / "spilled").iterdir())) > 1
    found = list(trie.items())
    assert not list((tmp_path / "spilled").iterdir())
    assert len(found) == len(want) and dict(found) == want


def fingerprint(t: str | None, size: int = 4) -> int:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_expected(prints: list[tuple[int, int]]) -> dict[int, int]:
    ids, f = [i for i, _ in prints], np.array([p for _, p in prints], np.uint64)
    comp = list(ids)
    changed = True
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    while changed:
        new = [min(c for c, ok in zip(comp, row, strict=True) if ok) for row in near]
        changed, comp = new != comp, new
    return dict(zip(ids, comp, strict=True))


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash(docs, corpus, block):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(docs(corpus), block=block).collect()}
    prints = [(i, fingerprint(t)) for i, t in corpus]
    comp = components_expected(prints)
    assert got == {i: (format(p, "016x"), comp[i]) for i, p in prints}
    assert len(set(comp.values())) < len(set(p for _, p in prints))  # there are links between different fingerprints


def test_simhash_finds_every_link_of_planted_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    rows = [int(b) for b in base]
    for b in base:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(bit)
            rows.append(x)
    rows = list(dict.fromkeys(rows))
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(rows)], "fp long, id long")
    for block in (4096, 2):
        scratch = Scratch(spark, "test")
        from tickloom.llm.components import components

        low = {r.b: r.a for r in components(simhash.link_forests(frame, scratch, 4, block), scratch).collect()}
        assert {i: low.get(i, i) for i in range(len(rows))} == components_expected(list(enumerate(rows)))


def test_tables_of_links_are_few_files_and_stars_take_no_round(spark, docs, corpus, tmp_path, monkeypatch):
    """However many partitions a shuffle has, as Hadoop's local file system may start a process for each file."""
    from tickloom.llm.components import components

    files: dict[str, int] = {}
    write = Scratch.write

    def counted(self, df, name, **options):
        out = write(self, df, name, **options)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        chain = [(i, i + 1) for i in range(2000) if i % 20 != 19]
        spark.createDataFrame(chain, "a long, b long").write.parquet(f"{tmp_path}/chains")
        low = components(spark.read.parquet(f"{tmp_path}/chains"), Scratch(spark, "test"))
        assert {r.b: r.a for r in low.collect()} == {i: i - i % 20 for i in range(2000) if i % 20}
        most = spark.sparkContext.defaultParallelism
        assert len(files) > 2 and max(files.values()) <= most < 64
        files.clear()
        low = components(low.select("a", "b"), Scratch(spark, "test"))
        assert list(files) == ["links0"] and low.count() == 1900
        docs(corpus).write.parquet(f"{tmp_path}/docs")
        assert simhash.keep_one(spark.read.parquet(f"{tmp_path}/docs")).count() < len(corpus)
        assert max(n for name, n in files.items() if name.startswith(("links", "prints", "tried", "shingles"))) <= most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_simhash_odd_rows(docs):
    assert simhash.simhash_dedup(docs([])).collect() == []
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(docs([(None, ""), (4, None), (2, " "), (7, "some words that differ from nothing"), (None, "alone among all the other rows")])).collect()}
    assert {(None, "0" * 16, 2), (4, "0" * 16, 2), (2, "0" * 16, 2)} <= got and (7, format(fingerprint("some words that differ from nothing"), "016x"), 7) in got
    assert sum(c is None for i, _, c in got if i is None) == 1
    text = " ".join(f"v{i}" for i in range(400))  # one with a doc_id, one without, that differ a little
    ends = (text + " end" * n for n in range(1, 60))
    other = next(t for t in ends if 0 < bin(fingerprint(t) ^ fingerprint(text)).count("1") <= 4)
    pair = simhash.simhash_dedup(docs([(8, text), (None, other)])).collect()
    assert pair[0].fingerprint != pair[1].fingerprint and {r.component_id for r in pair} == {8}
    kept = simhash.keep_one(docs([(None, ""), (4, None), (2, " "), (7, "some words that differ")]))
    assert kept.columns == docs([]).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7"]
    many = simhash.keep_one(docs([(None, "a b c d e f")] * 3 + [(4, "own words of another")] * 2 + [(4, "a third text of its own")]))
    assert sorted((str(r.doc_id), r.text) for r in many.collect()) == [("4", "a third text of its own"), ("4", "own words of another"), ("None", "a b c d e f")]
    with pytest.raises(ValueError):
        simhash.simhash_dedup(docs([]), most=5)


def test_keep_one_takes_near_copies_of_five_word_similarity(docs):
    """300 words with 5 changed: similarity about 0.85, fingerprints that differ by more than 4 bits."""
    rng = np.random.default_rng(11)
    base = [[f"v{x}" for x in rng.integers(0, 5000, 300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    near, far = set(), set()
    for i, w in enumerate(base):
        for at, changed in ((100, 5), (200, 25)):
            x = list(w)
            for k in rng.choice(np.arange(10, 290, 10), changed, replace=False):
                x[k] = "changed"
            alike = len(sets(w) & sets(x)) / len(sets(w) | sets(x))
            (near if alike >= 0.8 else far).add(at + i)
            rows.append((at + i, " ".join(x)))
    group = []
    for k in range(60):  # a chain: each is near to the next only
        group.append((1000 + k, " ".join(f"u{x}" for x in range(6 * k, 6 * k + 120))))
    assert len(near) == len(far) == 40
    assert sum(bin(fingerprint(dict(rows)[100 + i]) ^ fingerprint(dict(rows)[i])).count("1") > 4 for i in range(40)) > 20
    kept = {r.doc_id for r in simhash.keep_one(docs(rows + group)).collect()}
    assert kept == set(range(40)) | far | {1000}


def test_keep_one_links_close_fingerprints(docs):
    """Texts that repeat one sentence and end differently: close fingerprints, sets of a similarity below 0.8."""
    rng = np.random.default_rng(4)
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, bits = [], []
    while len(rows) < 24:
        sentence = [f"s{x}" for x in rng.integers(0, 9000, 11)] * 8
        a, b = (sentence + [f"e{x}" for x in rng.integers(0, 9000, 14)] for _ in range(2))
        assert len(sets(a) & sets(b)) < 0.8 * len(sets(a) | sets(b))
        differ = bin(fingerprint(" ".join(a)) ^ fingerprint(" ".join(b))).count("1")
        if differ <= 4:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
            bits.append(differ)
    assert len(set(bits)) > 1  # equal ones and others
    comp = components_expected([(i, fingerprint(t)) for i, t in rows])
    assert set(comp.values()) == set(range(0, 24, 2))
    assert {r.doc_id for r in simhash.keep_one(docs(rows)).collect()} == set(comp.values())
    bridge = [(30, rows[1][1] + " more"), (-1, rows[0][1] + " end")]  # by sets of the one and of the other text
    assert {r.doc_id for r in simhash.keep_one(docs(rows + bridge)).collect()} == set(comp.values()) - {0} | {-1}
    with pytest.raises(ValueError):
        simhash.keep_one(docs([]), most=5)


def test_entries_apart_are_compared_once_and_with_all_of_their_band():
    rng = np.random.default_rng(6)
    whole = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
    sets = [whole, whole[:90], whole[:85], whole[:40], whole[50:]]
    keys = np.tile(np.arange(simhash.BANDS), (5, 1))
    keys[4, 0] = 99
    row = lambda i, k, low: {"key": k, "low": low, "id": i, "keys": keys[i].tolist(), "shingles": sets[i].tobytes()}
    rows = [row(0, 0, 0), row(1, 0, 0), row(2, 0, 2), row(3, 0, 3), *(row(i, 1, min(i, 2)) for i in range(5))]
    batches = pa.Table.from_pylist(rows, pa.schema([("key", pa.int64()), ("low", pa.int64()), ("id", pa.int64()), ("keys", pa.list_(pa.int64())), ("shingles", pa.binary())])).to_batches(4)
    got = [(r["a"], r["b"]) for b in simhash.apart(iter(batches), 0.8) for r in b.to_pylist()]
    assert got == [(0, 2)]


def lines_expected(rows, window, long=200):
    first: dict[tuple, tuple] = {}
    places = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if strip(x)]
        places[i] = lines, at
        for s in range(len(at) - window + 1):
            first.setdefault(tuple(lines[k] for k in at[s : s + window]), (i, at[s]))
        for k in at:
            if len(lines[k]) >= long:
                first.setdefault(("long", lines[k]), (i, k))
    out = []
    for i, (lines, at) in places.items():
        gone = set()
        for s in range(len(at) - window + 1):
            if first[tuple(lines[k] for k in at[s : s + window])] < (i, at[s]):
                gone.update(at[s : s + window])
        gone.update(k for k in at if first.get(("long", lines[k]), (i, k)) < (i, k))
        out.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [1, 2, 3])
def test_lines(docs, corpus, window):
    got = line_dedup.line_dedup(docs(corpus), window=window)
    want = lines_expected(corpus, window)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[2] for r in want) > 0


def test_lines_odd_rows(docs):
    assert line_dedup.line_dedup(docs([])).collect() == []
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "x\na\nb"), (2, "b\nc\nd")]
    got = sorted(((r.doc_id, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs(rows)).collect()), key=str)
    assert got == sorted([(1, 0, "a\nb\nc"), (1, 0, "a\nb\nc"), (None, 2, "x"), (2, 2, "d")], key=str)


def test_long_lines_go_alone_and_heavy_ones_by_broadcast(docs, monkeypatch):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(i, f"own {i}\n{long}\nother {i}" if i % 3 else f"{long}\nboth\nlines {i % 2}") for i in range(40)] + [(90, long), (91, "own 1")]
    for heavy in (1000, 2):
        monkeypatch.setattr(line_dedup, "HEAVY", heavy)
        assert sorted(map(tuple, line_dedup.line_dedup(docs(rows)).collect())) == lines_expected(rows, 2)


def test_a_run_is_found_from_one_fingerprint(docs):
    """Of three lines the middle one alone is selected where its hash is the least."""
    import itertools

    names = [f"line {i}" for i in range(30)]
    hashes = {r.x: r.h for r in docs([(1, "\n".join(names))]).selectExpr("explode(split(text, '\n')) AS x").selectExpr("x", "xxhash64(x) AS h").collect()}
    run = next(r for r in itertools.permutations(names, 3) if hashes[r[1]] < min(hashes[r[0]], hashes[r[2]]))
    rows = [(1, "\n".join(run)), (2, "\n".join(run))]
    picked = line_dedup.fingerprints(line_dedup.keys(docs(rows), "text", "doc_id"), 2, 200).collect()
    assert [(r.id, r.line) for r in sorted(picked)] == [(1, 1), (2, 1)]
    assert sorted(map(tuple, line_dedup.line_dedup(docs(rows)).collect())) == [(1, 3, 0, "\n".join(run)), (2, 3, 3, "")]


def test_no_plan_of_lines_has_python(docs, monkeypatch):
    plans = []
    write = Scratch.write

    def seen(self, df, name, **options):
        plans.append(df._jdf.queryExecution().toString())
        return write(self, df, name, **options)

    monkeypatch.setattr(Scratch, "write", seen)
    plans.append(line_dedup.line_dedup(docs([(1, "a\nb"), (2, "a\nb")]))._jdf.queryExecution().toString())
    assert len(plans) == 6
    for plan in plans:
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def passages_expected(rows, size):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = []
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize(("batches", "runs"), [(4, 4), (5, 1), (1, 1)])
def test_passages(docs, corpus, batches, runs):
    got = substring_dedup.remove_repeats(docs(corpus), batch_count=batches, most_runs=runs)
    assert sorted(map(tuple, got.collect())) == passages_expected(corpus, 13)


def test_passages_files_of_a_batch(spark, tmp_path, monkeypatch):
    """Five megabytes of text make one file of fingerprints and one of answers; and many buckets give the same result."""
    rng = random.Random(8)
    words = [rng.randbytes(200).hex() for _ in range(12_000)]
    rows = [(i, " ".join(words[i * 100 : i * 100 + 130])) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    files: list[str] = []
    drop = substring_dedup.FingerprintIndex.drop

    def counted(index):
        files.extend(f for t in index.tables for f in spark.table(t).inputFiles())
        drop(index)

    monkeypatch.setattr(substring_dedup.FingerprintIndex, "drop", counted)
    for bucket_bytes, least, most in ((substring_dedup.BUCKET_BYTES, 1, 2), (256 << 10, 8, 64)):
        monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket_bytes)
        files.clear()
        got = substring_dedup.remove_repeats(spark.read.parquet(f"{tmp_path}/documents"), batch_count=2)
        assert sorted(map(tuple, got.collect())) == passages_expected(rows, 13)
        assert least <= len(files) <= most


def test_passages_odd_rows(docs):
    assert substring_dedup.remove_repeats(docs([])).collect() == []
    text = " ".join(f"v{i}" for i in range(20))
    rows = [(None, text), (5, text), (5, text), (-3, text), (8, "short"), (9, None)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs(rows)).collect()), key=str)
    assert got == sorted([(None, 20, 0), (5, 20, 20), (5, 20, 20), (-3, 20, 0), (8, 1, 0), (9, 0, 0)], key=str)


def test_long_words_of_structure_are_told_apart(docs):
    """Thue-Morse words and their complements, which collide in polynomial hashes modulo a power of two."""
    from tickloom.llm.common import WordHash

    bits = [bin(i).count("1") & 1 for i in range(2048)]
    pair = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    head = " ".join(f"v{i}" for i in range(12))
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs([(1, f"{head} {pair[0]}"), (2, f"{head} {pair[1]}"), (3, f"{head} {pair[0]}")])).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    for n in (1, 7, 8, 9, 64, 255, 256, 257, 2048):
        words = [p[:n] for p in pair] + ["b" * n, "b" * (n + 1), "\0" * n]
        data = np.frombuffer(" ".join(words).encode() + b" ", np.uint8)
        end = np.flatnonzero(data == 32)
        begin = np.concatenate([[0], end[:-1] + 1])
        assert len(set(WordHash(11)(data, begin, end).tolist())) == len(set(words))


def test_groups_are_those_of_sql(spark):
    from tickloom.llm.common import long_hash

    ids = np.array([0, 1, -1, 64, 1 << 62, -(1 << 63)], np.int64)
    frame = spark.createDataFrame([(int(i),) for i in ids], "x long").selectExpr("xxhash64(x) AS h")
    assert [r.h for r in frame.collect()] == long_hash(ids).tolist()


def test_index_takes_batches_one_after_another(spark, docs):
    text = " ".join(f"v{i}" for i in range(15))
    index = substring_dedup.FingerprintIndex(spark, 13, 4, 1, most_runs=2)
    for i in range(4):
        index.add(docs([(i, text if i else text + " more")]).select("doc_id", "text"))
        assert index.runs <= 2
    docs_of = np.concatenate([np.frombuffer(r.doc, np.int64) for r in index.answers().collect()])
    assert sorted(docs_of.tolist()) == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    index.drop()


def test_a_tag_tells_equal_hashes_apart():
    h, tag = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint32)
    assert substring_dedup.known(np.array([5, 5, 9, 9], np.uint64), np.array([2, 3, 3, 4], np.uint32), h, tag).tolist() == [True, False, True, False]
