"""Audit of how five filters interact: what each removes alone, after others, and on average over all orders.

Duplicates are found by sorting. Rows are dealt by ranges of (128-bit text fingerprint, doc_id) and sorted by fingerprint, full text
and doc_id; each row is compared with its predecessor, byte by byte. So copies that a third of all rows repeat lie
in as many ranges as they fill, and no task holds a group. Ranges end inside a group of copies at times: every range also reports the texts of its first and
last fingerprint with their least id there (one row each, unless different texts share a fingerprint), and a row that is the first of its text in its
range is a duplicate if an earlier range has the text under a smaller id. Texts move once, in that sort.

Each row's failures are a mask of five bits. Masks are merged into counters per (part, mask), labels included; the counters are additive, so
every figure of every order and step follows from the 32 counters of a part: what precedes a step is a set of filters (16 for each filter), and the Shapley sum
gives a document with k failing filters 120 / k times to each of them.

Defined cases: a null text is empty (0 words: it fails A only, and E if a smaller id is empty too); a null source is the part ''; a null id ranks after
all others and is a duplicate of any equal text that has an id, but not of others without one; rows that repeat an id and its text are no duplicates of each other;
an id with several labels is good (toxic) if one of them is; labels without a document are ignored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, drop_saved, saved

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
DUPLICATE = 1 << FILTERS.index("E")
_SYMBOLS = re.compile(rb"[#$%&*|]")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUES = bytes(range(0x80, 0xC0))


def text_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails. bytes.split() splits at space, tab, line feed, vertical tab, form feed
    and carriage return alone."""
    words = raw.split()
    n = len(words)
    mask = 1 if n < 200 else 0
    if 100 * len(set(words)) < 50 * n:
        mask |= 2
    if 100 * len(raw.translate(None, _NOT_UPPER)) > 2 * len(raw.translate(None, _CONTINUES)):
        mask |= 4
    if _SYMBOLS.search(raw):
        mask |= 8
    return mask


#: A row of the sorted pass. border: a text (f, x) of the range's first or last fingerprint with its least id there. Other rows name their text only if
#: they are the first of it in their range and it is of the range's first fingerprint: an earlier range can make them duplicates.
_ROWS = "border boolean, doc_id long, part string, mask int, f binary, x binary"
_FIELDS = pa.schema([("border", pa.bool_()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("f", pa.binary()), ("x", pa.binary())])


class _Sorted:
    """Compares neighbours over the batches of one range. Holds the last text, and digests of the texts of the first and the current fingerprint."""

    def __init__(self):
        self.f = self.first_f = self.text = self.x = self.mask = None
        self.least = None  # least id of the current text, in this range; null ids rank last
        self.first, self.last = [], []  # (f, x, least) of the texts of the first and of the current fingerprint

    def row(self, f: bytes, raw: bytes, doc):
        """(mask, f, x) of the next row; f and x are null unless an earlier range may hold its text."""
        if f != self.f:
            self.f, self.text, self.last = f, None, []
            if self.first_f is None:
                self.first_f = f
        if raw != self.text:
            self.text, self.least, self.mask, self.x = raw, doc, text_mask(raw), hashlib.sha256(raw).digest()
            self.last.append((f, self.x, doc))
            if f == self.first_f:
                self.first.append(self.last[-1])
        if doc != self.least:
            return self.mask | DUPLICATE, None, None
        return (self.mask, f, self.x) if f == self.first_f else (self.mask, None, None)

    def ends(self):
        return self.first + (self.last if self.f != self.first_f else [])


def _compare(batches):
    state = _Sorted()
    for batch in batches:
        found = [state.row(f.as_py(), raw.as_py(), doc) for f, raw, doc in zip(batch.column("f"), batch.column("text"), batch.column("doc_id").to_pylist(), strict=True)]
        if found:
            mask, f, x = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(found)), batch.column("doc_id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(f, pa.binary()), pa.array(x, pa.binary())], schema=_FIELDS)
    if ends := state.ends():
        f, x, least = zip(*ends, strict=True)
        n = len(ends)
        yield pa.RecordBatch.from_arrays([pa.array([True] * n), pa.array(least, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(f, pa.binary()), pa.array(x, pa.binary())], schema=_FIELDS)


def fingerprint(text):
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: doc_id, part, mask (bit i: it fails filter FILTERS[i])."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("f", fingerprint(F.col("text")))
    # The sample that chooses the ranges holds fingerprints, ids and row numbers, never texts. Row numbers part rows that agree in all else.
    key = ["f", F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(*key, F.monotonically_increasing_id())
    inside = dealt.sortWithinPartitions("f", "text", key[1])
    out = saved(inside.mapInArrow(_compare, _ROWS), "audit")
    # A text that several ranges report: its least id anywhere. At most the texts of two fingerprints a range.
    borders = out.filter("border").groupBy(F.col("f").alias("bf"), F.col("x").alias("bx")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("ranges")).filter("ranges > 1")
    settled = out.filter("not border and f is null").select("doc_id", "part", "mask")
    open_ = out.filter("not border and f is not null").join(borders, (F.col("f") == F.col("bf")) & (F.col("x") == F.col("bx")), "left")
    smaller = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("least") < F.col("doc_id")))
    open_ = open_.select("doc_id", "part", F.when(smaller, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))
    both = settled.unionByName(open_)
    both._millrace_path = out._millrace_path
    return both


def mask_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Additive counters per (part, mask): n, good, toxic."""
    by_id = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    marks = marks.filter("label_id is not null").groupBy("label_id").agg(F.coalesce(F.max("good"), F.lit(0)).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    # Rows without an id have no label; they don't meet in one task of the join.
    named = by_id.filter("doc_id is not null").join(marks, F.col("doc_id") == F.col("label_id"), "left")
    named = named.select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = by_id.filter("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    total = lambda c: F.sum(F.col("n") * F.col(c)).alias(c)
    return named.unionByName(nameless).groupBy("part", "mask").agg(total("good"), total("toxic"), F.sum("n").alias("n"))


def _bits(order: str) -> int:
    return sum(1 << FILTERS.index(x) for x in order)


def order_report(counters: DataFrame) -> DataFrame:
    """The figures of every part, order and step from its counters."""
    own_of = {f: _bits(f) for f in FILTERS}
    before = sorted({(_bits(o[:k]), own_of[o[k]]) for o in ORDERS for k in range(len(FILTERS))})
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("prior"), F.lit(o).alias("own")) for p, o in before])).alias("x")
    rows = counters.select("part", "mask", "n", "good", "toxic", pairs).select("part", "mask", "n", "good", "toxic", "x.prior", "x.own")
    fails, passed = F.expr("(mask & own) <> 0"), F.expr("(mask & prior) = 0")
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    per = rows.groupBy("part", "prior", "own").agg(
        total(F.expr("(mask & (prior | own)) = 0")).alias("kept"),
        total(fails & passed).alias("removed"),
        total(fails & ~passed).alias("redundant"),
        total(F.expr("mask = own")).alias("unique_fails"),
        total(fails & passed, "good").alias("good_lost"),
        total(fails & passed, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * F.expr("120 div bit_count(mask)")).otherwise(0)).alias("shapley"),
    )
    # The 600 steps belong to 80 pairs (filters before, filter): each pair's steps are a constant of the plan.
    steps = {(p, o): [] for p, o in before}
    for order in ORDERS:
        for k, f in enumerate(order):
            steps[_bits(order[:k]), own_of[f]].append((order, k + 1))
    table = counters.sparkSession.createDataFrame([(p, o, order, k) for (p, o), found in steps.items() for order, k in found], "prior int, own int, filter_order string, step int")
    return per.join(F.broadcast(table), ["prior", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    masks = failure_masks(docs, id_col, text_col, part_col)
    counters = saved(mask_counters(masks, labels), "counters")
    drop_saved(masks)
    return order_report(counters)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = {
    "op12_filter_audit": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), m AS (
  SELECT part,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN least < doc_id OR (doc_id IS NULL AND least IS NOT NULL) THEN 16 ELSE 0 END) AS mask,
    CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) THEN 1 ELSE 0 END AS good,
    CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) THEN 1 ELSE 0 END AS toxic
  FROM d
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), o(filter_order, used) AS (
  SELECT CAST('' AS VARCHAR), 0
  UNION ALL
  SELECT filter_order || letter, used + bit FROM o, f WHERE used & bit = 0
), s AS (
  SELECT filter_order, step, f.bit AS own, coalesce((SELECT sum(g.bit) FROM f g WHERE strpos(left(filter_order, CAST(step - 1 AS INTEGER)), g.letter) > 0), 0)::INTEGER AS prior
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k, f
  WHERE used = 31 AND f.letter = substr(filter_order, CAST(step AS INTEGER), 1)
)
SELECT part, filter_order, step,
  sum(CASE WHEN mask & (prior | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & prior = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & prior <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & prior = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & prior = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(sum(CASE WHEN mask & own <> 0 AND mask & prior = 0 THEN n ELSE 0 END)) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step, own
"""
}
