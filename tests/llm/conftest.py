import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, tokens string, key string, bucket string, lines string, p string, sha string, keep_id string, grouped int, rate double, copy int, text_read string, kept_id int, kept_hash int, gone string, grp int, h string, th string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves. rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", None, None, 7, None, "x", "y", "z", "l", "p", "s", "k", 1, 0.5, 2, "r", 3, 4, "g", 5, "h", "t") for i, t in rows], SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): words of a small vocabulary, copies, near copies, shared passages, empty and odd texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["The", "of", "Ünï", "中文", "É"]
    text = lambda n: "".join(rng.choice(words) + rng.choice((" ", " ", "\n", "\t ")) for _ in range(n))
    base = [text(rng.randint(5, 160)) for _ in range(60)]
    passage = text(40)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 7]) for i in range(30)]
    rows += [(200 + i, f" {base[10]}\n") for i in range(4)]
    for i in range(25):
        w = base[20 + i % 5].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((300 + i, " ".join(w)))
    rows += [(400 + i, text(20) + passage + text(20)) for i in range(20)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "a b c"), (505, None), (506, "x" * 50_000), (507, text(9000)), (508, "same " * 700), (509, "l1\nl2\nl3\n\nl4\nl1\nl2\nl3"), (510, "l2\nl3\n \nl4\nnew"), (511, "l9\nl9\nl9\nl9")]
    rng.shuffle(rows)
    return rows
