"""Line dedup by site-relative frequency, in DataFrame functions only.

For each host, the share of its pages that contain a line is the line's ratio; lines with a ratio
above ``ratio`` (and on ``least`` pages or more) are boilerplate and go from every page of that
host. A page counts a line once. Lines are compared exactly but for surrounding spaces; blank
lines are layout and always stay.

A line on over ``ratio`` of the pages is one of at most (mean lines a page) / ``ratio`` such lines
of its host, so a host's boilerplate is a short list whatever its size. Lines meet as 64-bit
hashes, summed before the shuffle; the texts themselves are not shuffled while all lists together
stay under ``broadcast_rows`` hashes. Beyond that they are joined by host, with the rows of each
host dealt over ``SALTS`` groups.

Edge cases: a null text stays null with 0 lines; an empty text is one blank line. Pages whose host
is null form one host. A page that loses every line becomes an empty text. Rows are pages, repeated
doc_ids or not. Other columns pass through unchanged, of any name and type, but for any called like
the two counts, which these replace; an empty table gives an empty one. Very long texts are cut in
lines as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.common import fresh, named, without, written

RATIO = 0.05
LEAST = 3
BROADCAST_ROWS = 1_000_000
SALTS = 64


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, least: int = LEAST, copies: bool = True) -> DataFrame:
    """(host, lines): the hashes of the boilerplate lines of each host that has some. Without
    ``copies``, pages of a host with equal texts count as one."""
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), line_hash))
    pages = pages.select(host.alias("host"), F.coalesce(lines, F.array().cast("array<long>")).alias("lines"), F.xxhash64(text).alias("page"))
    if not copies:
        pages = pages.groupBy("host", "page").agg(F.first("lines").alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("found"))
    frequent = counts.where(F.col("found") >= least).join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("found") > F.lit(ratio) * F.col("pages"))
    return frequent.groupBy(counts["host"]).agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, broadcast_rows: int = BROADCAST_ROWS, copies: bool = True, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``pages`` with their boilerplate lines gone from ``text``, and the counts n_lines and n_dropped
    (under ``names``; they replace columns so named)."""
    pages = without(pages, *names)
    own = fresh(pages, list(names))
    found = written(boilerplate(pages, F.col(host), F.col(text), ratio, least, copies)).select(F.col("host").alias(f"{own}host"), F.col("lines").alias(f"{own}lines"))
    size = found.agg(F.count("*"), F.sum(F.size(f"{own}lines"))).first()
    same = F.col(host).eqNullSafe(F.col(f"{own}host"))
    if size[0] + (size[1] or 0) <= broadcast_rows:
        joined = pages.join(F.broadcast(found), same, "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS))
        salted = found.withColumn(f"{own}salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = pages.withColumn(f"{own}with", salt).join(salted, same & (F.col(f"{own}with") == F.col(f"{own}salt")), "left")
    lines, drop = F.split(F.col(text), "\n"), F.col(f"{own}lines")
    kept = F.when(drop.isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(drop, line_hash(x))))
    count = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    joined = joined.select(*(named(c) for c in pages.columns), kept.alias(f"{own}kept"), count.alias(f"{own}n"))
    dropped = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col(f"{own}n") - F.size(f"{own}kept")).cast("long")
    joined = joined.select("*", dropped.alias(f"{own}gone"))
    left = F.when(F.col(f"{own}gone") > 0, F.array_join(f"{own}kept", "\n")).otherwise(F.col(text))
    return joined.select(*(left.alias(c) if c == text else named(c) for c in pages.columns), F.col(f"{own}n").alias(names[0]), F.col(f"{own}gone").alias(names[1]))


SQL = """
WITH page AS (
  SELECT row_number() OVER () AS id, * FROM documents
), line AS (
  SELECT id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM page
), total AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), frequent AS (
  SELECT l.source, trim(l.line) AS line
  FROM line l JOIN total t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(l.line) <> ''
  GROUP BY l.source, trim(l.line), t.pages
  HAVING count(DISTINCT l.id) >= 3 AND count(DISTINCT l.id) > 0.05 * t.pages
), kept AS (
  SELECT l.id, count(*) AS n_lines, count(f.line) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (f.line IS NULL), '') AS text
  FROM line l LEFT JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND trim(l.line) = f.line
  GROUP BY l.id
)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE k.text END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM page p LEFT JOIN kept k USING (id)
"""
