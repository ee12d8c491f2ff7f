"""Line deduplication: a suffix order over sequences of line ids, by distributed prefix doubling. DataFrame functions only.

A document is the sequence of its lines that are not blank. The name of a line is its 128-bit digest. In round k the
name of a block of 2^k lines is the digest of its two halves' names, so equal names are
equal blocks, and the suffixes that share a name form an interval of the suffix array whose common prefix is at least 2^k. (Names
tell classes apart; the order *among* classes decides nothing here and is never computed, so no group
is ever sorted in one task.) Only suffixes whose block occurs twice go on to round k + 1; the rounds end when none does.

A run of at least ``min_lines`` lines, or a single line of at least ``long_line`` bytes, that also starts earlier (smaller doc_id, or the same document and earlier line) is a
later copy and its lines are deleted; overlapping runs count. Blank lines take no part and stay.

Counting combines on the map side and rows meet counts through equi-joins, which adaptive execution may split: a line that a third of all
rows hold is no obstacle. Only a document's own lines are gathered.

Defined cases: a null text has no lines; a null id has no place in the order, its text stays whole and removes nothing elsewhere; rows that repeat an
id are one document and must repeat its text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_row, documents, drop_saved, id_text, saved, sorted_side

MIN_LINES = 2
LONG_LINE = 250  # bytes


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _filled(lines: Column) -> Column:
    """Places of the lines that are not blank."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.translate(F.get(lines, i), " \t\x0b\x0c\r", "") != "")


def _twice(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, q, name, ...) whose name occurs at two places or more."""
    names = blocks.groupBy("name").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("name")
    return blocks.join(names, "name")


def _follow(left: DataFrame, right: DataFrame, gap: Column) -> DataFrame:
    """Each block of ``left`` joined with the block of ``right`` that starts ``gap`` lines after it."""
    after = right.select(F.col("doc_id").alias("r_doc"), F.col("q").alias("r_q"), F.col("name").alias("r_name"))
    return left.join(after, (F.col("doc_id") == F.col("r_doc")) & (F.col("q") + gap == F.col("r_q")))


def doubled(lines: DataFrame, limit: int | None = None) -> list[DataFrame]:
    """levels[k]: (doc_id, q, name) of the blocks of 2^k lines that occur twice or more, while 2^k <= limit."""
    levels = [saved(_twice(lines).select("doc_id", "q", "name", "long"), "lines0")]
    while not levels[-1].isEmpty() and (limit is None or 2 ** len(levels) <= limit):
        now = levels[-1]
        pairs = _follow(now.drop("long"), now, F.lit(2 ** (len(levels) - 1))).select("doc_id", "q", _digest(F.col("name"), F.col("r_name")).alias("name"))
        levels.append(saved(_twice(saved(pairs, "pairs")).select("doc_id", "q", "name"), f"lines{len(levels)}"))
    return levels


def longest_blocks(levels: list[DataFrame]) -> DataFrame:
    """(doc_id, longest_block): the largest 2^k for which a block of 2^k of the document's lines occurs at another
    place too; its longest common prefix with another suffix is at least that and less than twice that."""
    out = None
    for k, level in enumerate(levels):
        of_level = level.select("doc_id").distinct().select("doc_id", F.lit(2**k).cast("long").alias("longest_block"))
        out = of_level if out is None else out.unionByName(of_level)
    return out.groupBy("doc_id").agg(F.max("longest_block").alias("longest_block"))


def _later(blocks: DataFrame) -> DataFrame:
    """The blocks of which an equal one starts earlier."""
    first = blocks.groupBy("name").agg(F.min(F.struct("doc_id", "q")).alias("first"))
    return blocks.join(first, "name").filter(F.struct("doc_id", "q") > F.col("first")).select("doc_id", "q")


def later_copies(levels: list[DataFrame], min_lines: int) -> DataFrame:
    """(doc_id, q): starts of the blocks of ``min_lines`` lines that also start earlier."""
    k = min_lines.bit_length() - 1
    if len(levels) <= k:
        return levels[0].filter("false").select("doc_id", "q")
    blocks = levels[k]
    if min_lines > 2**k:  # two overlapping blocks
        blocks = _follow(blocks, blocks, F.lit(min_lines - 2**k)).select("doc_id", "q", _digest(F.col("name"), F.col("r_name")).alias("name"))
        blocks = saved(blocks, "blocks")
    return _later(blocks)


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_runs, longest_block (see ``longest_blocks``; 0 if
    no line occurs twice), kept_text."""
    return by_row(id_text(docs, id_col, text_col), lambda rows: _line_dedup(rows, min_lines, long_line))


def _line_dedup(texts: DataFrame, min_lines: int, long_line: int) -> DataFrame:
    base = texts.select("doc_id", F.split("text", "\n").alias("lines"))
    line = lambda i: F.get(F.col("lines"), i)
    one = lambda i: F.struct(F.unhex(F.md5(line(i).cast("binary"))).alias("name"), (F.octet_length(line(i)) >= long_line).alias("long"))
    named = base.filter("doc_id is not null").select("doc_id", F.posexplode(F.transform(_filled(F.col("lines")), one)).alias("q", "x")).select("doc_id", "q", "x.name", "x.long")
    named = saved(named, "lines").dropDuplicates(["doc_id", "q"])
    levels = doubled(named)
    longest = longest_blocks(levels)
    covered = later_copies(levels, min_lines).select("doc_id", F.explode(F.sequence(F.col("q"), F.col("q") + (min_lines - 1))).alias("q"))
    covered = covered.unionByName(_later(levels[0].filter("long")))
    gone = covered.groupBy("doc_id").agg(F.collect_set("q").alias("gone"))
    of_doc = saved(longest.join(gone, "doc_id", "left"), "gone")
    drop_saved(*levels[1:])
    rows = base.join(sorted_side(of_doc), "doc_id", "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    rows = rows.select("doc_id", "lines", "longest_block", _filled(F.col("lines")).alias("filled"), gone.alias("gone"))
    places = F.transform("gone", lambda q: F.get(F.col("filled"), q))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), places)
    return rows.select(
        "doc_id",
        F.size("filled").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.size(F.array_except("gone", F.transform("gone", lambda q: q + 1))).cast("long").alias("n_runs"),
        F.coalesce("longest_block", F.lit(0)).alias("longest_block"),
        F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n").alias("kept_text"),
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_block", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op7_line_dedup": r"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents
), n AS (
  SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS q FROM l WHERE regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') <> ''
), b AS (
  SELECT doc_id, q, line, lead(line) OVER (PARTITION BY doc_id ORDER BY q) AS nx FROM n
), r AS (
  SELECT doc_id, q, row_number() OVER (PARTITION BY line, nx ORDER BY doc_id, q) AS rn FROM b WHERE nx IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest([q, q + 1]) AS q FROM r WHERE rn > 1
    UNION ALL SELECT doc_id, q FROM (SELECT doc_id, q, row_number() OVER (PARTITION BY line ORDER BY doc_id, q) AS rn FROM n WHERE strlen(line) >= 250) WHERE rn > 1)
), suf AS (
  SELECT doc_id, q, md5(line) AS h FROM n
), grow AS (
  SELECT doc_id, q, 1 AS len, h FROM (SELECT doc_id, q, h, count(*) OVER (PARTITION BY h) AS c FROM suf) WHERE c > 1
  UNION ALL
  SELECT doc_id, q, len, h FROM (
    SELECT g.doc_id, g.q, g.len + 1 AS len, md5(g.h || s.h) AS h, count(*) OVER (PARTITION BY md5(g.h || s.h)) AS c
    FROM grow g JOIN suf s ON s.doc_id = g.doc_id AND s.q = g.q + g.len
  ) WHERE c > 1
), lcp AS (
  SELECT doc_id, max(len) AS longest FROM grow GROUP BY doc_id
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE prev IS NULL OR prev <> q - 1) AS n_runs
  FROM (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) AS prev FROM gone) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS t FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.p = l.p
  LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.q = n.q WHERE g.q IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_runs, 0) AS n_runs,
  CAST(coalesce(pow(2, floor(log2(x.longest))), 0) AS BIGINT) AS longest_block, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id) c USING (doc_id)
LEFT JOIN runs r USING (doc_id) LEFT JOIN lcp x USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
}
