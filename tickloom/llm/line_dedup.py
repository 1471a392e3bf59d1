"""Line deduplication by winnowing, with DataFrame functions alone.

The lines of a document that aren't blank are hashed. Of every `window` consecutive hashes the least (the first of
equal ones) is selected as a fingerprint, so two documents with `window` equal lines in a row have a fingerprint in
common; a line of `long` code points or more is always one. There is one row for each selected position. Fingerprints
that stand at one position only are left out, the positions of the rest are joined: a position matches the first one
with which it can be extended, to the left and right together, by the `window` - 1 lines that the guarantee asks for (a
long line by none). The lines that such matches cover go where the matched position is an earlier one. Beyond
`window` - 1 lines on either side the next fingerprint takes over, so every line of a later repeated run of `window`
lines or more goes, as does every later repetition of a long line, and the first run of all stays.

Positions are (doc_id, line). All pairs of a group are never formed: joins are with one row for each fingerprint or
extension, counts and minima are combined before the shuffle. Fingerprints and extensions with more than one in `HEAVY`
of all positions are joined by broadcast instead of in one task; there are at most HEAVY * (`window` + 1) of them.

Defined cases: null text counts as empty. Blank lines (nothing but [\\x20\\x09-\\x0D]) take no part and stay. A line's
end is \\n. Within one document later repetitions go too. Null doc_ids come after all others. Rows with equal doc_id and
text are one document's, and get the same answer; with equal doc_id and other texts they are ordered by a hash of the
text. Of documents with fewer lines than a window only long lines can go. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES, Scratch

LAST = (1 << 63) - 1
#: A key with more than this part of all rows is a heavy one.
HEAVY = 1000


def lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def keys(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Of each document its key (id, th) and its text."""
    s = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(s).alias("th"), s.alias("text"))


def fingerprints(rows: DataFrame, window: int, long: int) -> DataFrame:
    """A row for each selected position: its document (id, th), line, fingerprint m, and in xs what it extends to.

    xs has for each number of lines to the left, 0 to window - 1, a second hash of the `window` lines then matched (null
    where the document doesn't have them), and last one of the line alone if it is long. `at` has the lines' numbers
    from window - 1 lines before the position to as many behind it; those beyond the document are null.
    """
    seen = rows.select("id", "th", F.transform(lines("text"), lambda x, i: F.struct(i.alias("i"), x.alias("line"))).alias("lines"))
    kept = F.filter("lines", lambda x: F.translate(x["line"], SPACES, "") != "")
    hashed = seen.select("id", "th", kept.alias("k")).select(
        "id",
        "th",
        F.transform("k", lambda x: x["i"]).alias("at"),
        F.transform("k", lambda x: F.xxhash64(x["line"])).alias("h"),
        F.transform("k", lambda x: F.xxhash64(F.lit("line"), x["line"])).alias("g"),
        F.transform("k", lambda x: F.char_length(x["line"]) >= long).alias("long"),
    )
    n = F.size("h")
    firsts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))
    least = F.transform(firsts, lambda s: s + F.array_position(F.slice("h", s + 1, window), F.array_min(F.slice("h", s + 1, window))).cast("int") - 1)
    lone = F.filter(F.transform("long", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    placed = hashed.select("id", "th", "at", "h", "g", "long", F.explode(F.array_union(least, lone)).alias("p"))

    def whole(left: int) -> Column:
        first = F.col("p") - left
        return F.when((first >= 0) & (first + window <= n), F.xxhash64(F.lit(left), F.slice("g", F.greatest(first, F.lit(0)) + 1, window)))

    alone = F.when(F.get("long", F.col("p")), F.xxhash64(F.lit("long"), F.get("g", F.col("p"))))
    around = F.array(*[F.get("at", F.col("p") + d) for d in range(1 - window, window)])
    return placed.select("id", "th", F.get("at", F.col("p")).alias("line"), F.get("h", F.col("p")).alias("m"), F.array(*[whole(s) for s in range(window)], alone).alias("xs"), around.alias("at"))


def joined(left: DataFrame, right: DataFrame, on: list[str], heavy: int) -> DataFrame:
    """Rows of left with the row of right that has their key. right: one row a key, and n, how many of left have it.

    The few keys with `heavy` rows or more are broadcast, so that their rows need not meet in one task.
    """
    few = F.broadcast(right.where(F.col("n") >= heavy).drop("n"))
    most = right.where(F.col("n") < heavy).drop("n")
    hot = F.broadcast(right.where(F.col("n") >= heavy).select(*on))
    return left.join(few, on).unionByName(left.join(hot, on, "left_anti").join(most.hint("merge"), on))


def repeated_lines(docs: DataFrame, scratch: Scratch, text: str, doc_id: str, window: int, long: int) -> DataFrame:
    """id, th, gone: of each document that has any, the numbers of the lines that go."""
    every = scratch.write(fingerprints(keys(docs, text, doc_id), window, long), "selected")
    heavy = every.count() // HEAVY + 1
    shared = scratch.write(every.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    some = joined(every, shared, ["m"], heavy)
    spread = some.select("id", "th", "line", "m", "at", F.posexplode("xs").alias("left", "x")).where("x IS NOT NULL")
    spread = scratch.write(spread, "matched")
    place = F.struct("id", "th", "line")
    first = spread.groupBy("m", "left", "x").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.write(first, "first")
    later = joined(spread, first, ["m", "left", "x"], heavy).where(place > F.col("first"))
    # `left` lines before the position and the rest of the window behind it; a long line alone.
    covered = F.when(F.col("left") == window, F.array("line")).otherwise(F.slice("at", F.greatest(window - F.col("left"), F.lit(1)), window))
    return later.select("id", "th", F.explode(covered).alias("line")).groupBy("id", "th").agg(F.collect_set("line").alias("gone"))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 2, long: int = 200) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_removed, kept_text."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = scratch.write(repeated_lines(docs, scratch, text, doc_id, window, long), "gone")
    for name in ("selected", "shared", "matched", "first"):
        scratch.drop(name)
    # Texts are dealt by their keys whatever the other side's size, so that the plan is the same for every input.
    both = keys(docs, text, doc_id).join(gone.hint("merge"), ["id", "th"], "left").select("doc_id", lines("text").alias("lines"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("lines"), i)))
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("kept_text"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT *, lead(line) OVER w AS next, lead(i) OVER w AS j
  FROM l WHERE regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') <> ''
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, i, j, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) > 1 AS again
  FROM k WHERE next IS NOT NULL
), lone AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS again
  FROM k WHERE length(line) >= 200
), gone AS (
  SELECT doc_id, i FROM later WHERE again UNION SELECT doc_id, j FROM later WHERE again UNION SELECT doc_id, i FROM lone WHERE again
)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i
GROUP BY l.doc_id
"""
