"""Spelling variants: words that differ by one character, through an errata trie.

The words stand in a trie, whose nodes lie in heavy paths: a node's heavy child is the one with the most
words (ties: the largest character), its other children are light; the end of a word is a child too.
Two words that are one edit apart part at one node, and at most one of them goes on by its heavy child.
So it is enough to merge each light subtree, the smaller side, once: its words are entered again with
the character at that node

* replaced by the heavy child's character (then light subtrees of one node also meet each other there),
* skipped, or
* preceded by the heavy child's character, which is that one skipped on the heavy side;

and where such an erratum ends at a word, or two replaced ones at the same place, there is a pair. A word
lies in at most log2(words) light subtrees, so errata are few, and each pair is found exactly once (of a
run of equal characters only the last is skipped).

Over the cluster: words are range-sorted into ranges of about ``RANGE`` code points, so a subtree is
an interval of words and each range walks its part of the trie on its own. Only nodes on the way to a
range's first or last word may go on in other ranges; their children are counted over all ranges
(128-bit hashes of their prefixes) before the walk. Errata meet words by plain joins on the text. A place
gathers at most one erratum for each character of the alphabet, so no group is large.

Edge cases: null or empty texts have no words. Repeated rows count again. A word has no form if it has
no near word, or none that is ``RATIO`` times as frequent. Forms are followed to the last by doubling.
An empty table gives an empty one. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.common import CRC32_SQL, crc32_sql, strings, written

RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")  # letters up to U+00FF as UTF-8
LEAST = 7
TWICE = 2
RATIO = 10
RANGE = 1 << 20
BUFFER = 1 << 18
BUFFER_BYTES = 1 << 25

Edit = Callable[[int | None, bytes], bytes]
BORDERS = "p int, depth int, node binary, char int, n long"
ERRATA = "variant string, replaced int, word string, n long"


def _counted(edit: Edit | None, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = Counter(), 0

        def out() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for at in range(0, len(words), 8192):
                some = words[at : at + 8192]
                texts = pa.array(some, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([texts, pa.array([counts[w] for w in some], pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            raw, at = strings(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                found = RUN.findall(raw[at[k] : at[k + 1]].tobytes().lower())
                for word, n in Counter(w for w in found if len(w) >= least).items():
                    word = edit(doc_id, word) if edit else word
                    if len(word) - word.count(b"\xc3") >= least:
                        counts[word] += n
                        size += len(word)
                if len(counts) > BUFFER or size > BUFFER_BYTES:
                    yield from out()
                    size = 0
        yield from out()

    return run


def word_counts(docs: DataFrame, edit: Edit | None = None, least: int = LEAST, often: int = TWICE) -> DataFrame:
    """word and n: the runs of letters, A-Z lower-cased, of at least ``least`` code points that occur at
    least ``often`` times. ``edit`` may change a run (doc_id, UTF-8 bytes), always alike."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_counted(edit, least), "word string, n long")  # a partition's counts are one row a word
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _next(word: str, depth: int) -> int:
    """The character after ``depth`` of them, -1 at the end."""
    return ord(word[depth]) if depth < len(word) else -1


def _digests(word: str) -> list[bytes]:
    """A hash of each prefix of ``word``, the empty one first."""
    sha = hashlib.blake2b(digest_size=16)
    found = [sha.digest()]
    for c in word:
        sha.update(c.encode())
        found.append(sha.digest())
    return found


def _commons(words: list[str]) -> list[int]:
    """How many first characters each of sorted ``words`` has in common with the one before it."""
    return [len(words[0]), *(len(commonprefix(pair)) for pair in pairwise(words))]


def _borders(words: list[str], commons: list[int]) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, hash, low, high) of the nodes that may go on in other ranges: the prefixes of the first
    and of the last word, each with the interval of ``words`` (sorted) under it."""
    with_first = list(accumulate(commons, min))
    high = len(words)
    for depth, node in enumerate(_digests(words[0])):
        while with_first[high - 1] < depth:
            high -= 1
        yield depth, node, 0, high
    with_last = [*accumulate([*commons[:0:-1]], min, initial=len(words[-1]))][::-1]
    low = 0
    for depth, node in enumerate(_digests(words[-1])):
        while with_last[low] < depth:
            low += 1
        if low > 0:  # else the first word's
            yield depth, node, low, len(words)


def _children(words: list[str], depth: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(character, low, high) of each child of a node."""
    found, at = [], low
    for k in range(low + 1, high + 1):
        if k == high or _next(words[k], depth) != _next(words[at], depth):
            found.append((_next(words[at], depth), at, k))
            at = k
    return found


def _sorted(rows: pa.Table) -> tuple[list[str], list[int]]:
    pairs = sorted(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))
    return [w for w, _ in pairs], [n for _, n in pairs]


def _at_borders(rows: pa.Table) -> pa.Table:
    """How many words go on by each character from the nodes at the borders of a range."""
    words, _ = _sorted(rows)
    p = rows.column("p")[0].as_py()
    found = [(p, depth, node, c, high - low) for depth, node, a, b in _borders(words, _commons(words)) for c, low, high in _children(words, depth, a, b)]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["p", "depth", "node", "char", "n"])


def light(words: list[str], heavy: dict[bytes, int]) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, depth, heavy character) of each light subtree of sorted distinct ``words``.

    ``heavy``: the heavy children, counted over all ranges, of the nodes at the borders.
    """
    commons = _commons(words)
    for depth, node, a, b in _borders(words, commons):
        if node in heavy:
            yield from ((low, high, depth, heavy[node]) for c, low, high in _children(words, depth, a, b) if c != heavy[node])
    todo = [(0, len(words))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        depth = min(commons[a + 1 : b])
        children = _children(words, depth, a, b)
        todo += [(low, high) for _, low, high in children]
        if a > 0 and b < len(words):
            _, most = max((high - low, c) for c, low, high in children)
            yield from ((low, high, depth, most) for c, low, high in children if c != most)


def _errata(words_of: pa.Table, borders: pa.Table) -> pa.Table:
    """The words of light subtrees, entered again: ``replaced`` is the place of a replaced character."""
    found = []
    if len(words_of):
        words, counts = _sorted(words_of)
        heavy = dict(zip(borders.column("node").to_pylist(), borders.column("heavy").to_pylist(), strict=True))
        for low, high, depth, most in light(words, heavy):
            best = chr(most)
            for word, n in zip(words[low:high], counts[low:high], strict=True):
                before, own, after = word[:depth], word[depth : depth + 1], word[depth + 1 :]
                found.append((before + best + own + after, None, word, n))
                if own:
                    found.append((before + best + after, depth, word, n))
                    if not after.startswith(own):
                        found.append((before + after, None, word, n))
    columns = zip(*found, strict=True) if found else ([], [], [], [])
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["variant", "replaced", "word", "n"])


def near_words(words: DataFrame, size: int = RANGE) -> DataFrame:
    """word, n_near and best (struct of minus n, and word) of each of ``words`` (distinct; word, n) that
    has near ones; best is the one of largest n, then the smallest word."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    ranged = written(words.repartitionByRange(max(1, -(-total // size)), "word").withColumn("p", F.spark_partition_id()))
    borders = written(ranged.groupBy("p").applyInArrow(_at_borders, BORDERS))
    counts = borders.groupBy("depth", "node", "char").agg(F.sum("n").alias("n")).groupBy("depth", "node")
    heavy = counts.agg(F.max(F.struct("n", "char")).alias("most"), F.count("*").alias("children")).where("children > 1")
    known = borders.select("p", "depth", "node").distinct().join(heavy.select("depth", "node", F.col("most.char").alias("heavy")), ["depth", "node"])
    errata = written(ranged.groupBy("p").cogroup(known.select("p", "node", "heavy").groupBy("p")).applyInArrow(_errata, ERRATA))
    hit = errata.join(words.select(F.col("word").alias("variant"), F.col("n").alias("m")), "variant")
    one, best = F.lit(1).cast("long").alias("n_near"), lambda n, w: F.struct((-F.col(n)).alias("less"), F.col(w).alias("word")).alias("best")
    mine = hit.select("word", one, best("m", "variant"))
    theirs = hit.select(F.col("variant").alias("word"), one, best("n", "word"))
    # replaced at one place to one text: at most one for each character, and near each other
    meet = errata.where("replaced is not null").groupBy("variant", "replaced").agg(F.sort_array(F.collect_list(best("n", "word"))).alias("all")).where(F.size("all") > 1)
    each = meet.select("all", F.posexplode("all").alias("at", "own"))
    other = F.when(F.col("at") == 0, F.col("all")[1]).otherwise(F.col("all")[0])
    met = each.select(F.col("own.word").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), other.alias("best"))
    found = mine.unionByName(theirs).unionByName(met).groupBy("word")
    return found.agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variant_groups(words: DataFrame, ratio: int = RATIO, size: int = RANGE) -> DataFrame:
    """word, n, n_near, form, form_n and root of each of ``words`` (distinct; word, n).

    A word's form is its best near word, if that is at least ``ratio`` times as frequent; its root is the
    last of the forms that follow from it, or the word itself.
    """
    words = written(words.select("word", "n"))
    near = near_words(words, size)
    found = words.join(near, "word", "left")
    ratio = F.when(-F.col("best.less") >= F.col("n") * ratio, F.col("best"))
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), ratio["word"].alias("form"), (-ratio["less"]).alias("form_n")))
    roots = written(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # a form is at least ``ratio`` times as frequent, so chains are short and have an end
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = written(moved)
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


SQL = f"""
WITH RECURSIVE {CRC32_SQL}, runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
), marked AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS mark, CAST(count(*) AS BIGINT) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, {crc32_sql("mark")} AS h FROM marked, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed
  ) GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2
), places AS (
  SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM words
), less AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM places
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM places a JOIN places b
  ON a.i = b.i AND length(a.word) = length(b.word) AND substr(a.word, 1, a.i - 1) || substr(a.word, a.i + 1) = substr(b.word, 1, b.i - 1) || substr(b.word, b.i + 1) AND a.word <> b.word
  UNION ALL SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON w.word = l.short
  UNION ALL SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON w.word = l.short
), best AS (
  SELECT word, CAST(count(*) AS BIGINT) AS n_near, min((-m, other)) AS top FROM near GROUP BY word
), found AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 10 * words.n THEN top[2] END AS form, CASE WHEN -top[1] >= 10 * words.n THEN -top[1] END AS form_n
  FROM words LEFT JOIN best USING (word)
), roots AS (
  SELECT word, word AS root, 0 AS step FROM found
  UNION ALL SELECT roots.word, found.form, step + 1 FROM roots JOIN found ON roots.root = found.word WHERE found.form IS NOT NULL
)
SELECT word, n, n_near, form, form_n, (SELECT arg_max(root, step) FROM roots WHERE roots.word = found.word) AS root FROM found
"""
