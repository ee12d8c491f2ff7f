"""Quality selection by importance resampling.

Three generative models of hashed n-grams (words or runs of other signs, and pairs of neighbours) share one table of
``BUCKETS`` buckets: the target model counts labelled good documents (quality 1, not toxic), the bad model the other labelled
documents, the raw model all documents. The target and the bad model are smoothed towards the raw model: a bucket's ratio is that of its
count to the count the raw model expects, ``SMOOTH`` added to both. A document's log importance weight is the sum over its n-grams
of the log ratio of target to bad, both signs, shrunk by ``SHRINK`` towards 0 (a soft threshold), because n-grams that a few labelled documents
happen to hold have small ratios of no meaning. The sum is divided by the square root of the n-gram count (in units of ``NGRAMS``, about the
mean document): a plain sum lets chance ratios decide about long documents, a mean hides a few strong signs in a long text; held-out errors
are in the README. So an n-gram that good documents lack and bad ones repeat counts by its evidence at every table
size, as does one that good documents repeat and bad ones lack.

Documents are sampled without replacement by Gumbel top-k: the k largest sums of log weight and Gumbel noise are
kept, the noise being a hash of the id. k is the number of documents whose weight lies above the cut that errs least on held-out
labelled documents. The k-th largest sum is found by histograms of ever smaller ranges, not by a sort.

Labels are read as a documented sample: ``LABELS`` rows at most, the first by a hash of the id; one half fits the target
and bad models, the other finds the cut. The raw model, the weights and the selection cover all documents. What reaches the driver is the bucket table (fixed
size), the labelled sample and histograms.

Defined cases: a null or empty text has no n-grams and weight 0; a null id shares one noise value; rows that repeat an
id share its noise and its fate if their texts agree; several labels of an id count as the worst; null labels don't count; without usable labels all
weights are 0 and all documents stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, id_text, saved

BITS = 20
BUCKETS = 1 << BITS
LABELS = 50_000
SMOOTH, SHRINK = 0.5, 2.0
NGRAMS = 1000
SEED = 29
_U = np.uint64
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")


class _Hashes(dict):
    """Token hashes; the table starts anew when it is full."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        got = self[token] = xxhash.xxh3_64_intdigest(token)
        return got


_HASHES = _Hashes()


def ngrams(text: bytes) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a text in UTF-8."""
    tokens = _TOKEN.findall(text.lower())
    x = np.fromiter(map(_HASHES.__getitem__, tokens), dtype=_U, count=len(tokens))
    two = (x[:-1] * _U(0x9E3779B97F4A7C15) + x[1:]) * _U(0xBF58476D1CE4E5B9)
    two ^= two >> _U(29)
    two *= _U(0x94D049BB133111EB)
    return np.concatenate((x >> _U(64 - BITS), two >> _U(64 - BITS))).astype(np.int64)


_COUNT_FIELDS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64()), ("bad", pa.int64())])


def _counts(ids: np.ndarray, good: np.ndarray):
    """ids: sorted ids of the labelled documents to fit; good: which of them are good."""

    def run(batches):
        raw, target, bad = (np.zeros(BUCKETS, dtype=np.int64) for _ in range(3))
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                grams = ngrams(text.as_py())
                np.add.at(raw, grams, 1)
                doc = doc.as_py()
                if doc is not None and len(ids):
                    i = np.searchsorted(ids, doc)
                    if i < len(ids) and ids[i] == doc:
                        np.add.at(target if good[i] else bad, grams, 1)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *[pa.array(c[seen]) for c in (raw, target, bad)]], schema=_COUNT_FIELDS)

    return run


def log_ratios(raw: np.ndarray, target: np.ndarray, bad: np.ndarray | None = None) -> np.ndarray:
    """The shrunk log ratio of target to bad by bucket. Without labelled bad documents all that is not target stands for them."""
    if bad is None or not bad.sum():
        bad = raw - target
    if not target.sum() or not bad.sum():
        return np.zeros(len(raw), dtype=np.float32)
    excess = lambda c: np.log((c + SMOOTH) / (raw * (c.sum() / raw.sum()) + SMOOTH))
    ratio = excess(target) - excess(bad)
    return (np.sign(ratio) * np.maximum(np.abs(ratio) - SHRINK, 0)).astype(np.float32)


def log_weight(ratios: np.ndarray, text: bytes) -> float:
    grams = ngrams(text)
    return float(ratios[grams].sum(dtype=np.float64)) * (NGRAMS / max(len(grams), 1)) ** 0.5


def _weigh(table):
    """Appends the log weight to batches whose last column is the text as bytes."""

    def run(batches):
        ratios = table.value
        for batch in batches:
            w = [log_weight(ratios, t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(w, pa.float64())], names=[*batch.schema.names[:-1], "log_weight"])

    return run


def weighed(docs: DataFrame, table, weight: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the log weight as column ``weight``; texts don't move."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    raw = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(docs.columns, plain, strict=True)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    schema = ", ".join(f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, docs.schema.fields, strict=True))
    return raw.mapInArrow(_weigh(table), f"{schema}, log_weight double").toDF(*docs.columns, weight)


def labelled(labels: DataFrame, limit: int = LABELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, good (bool) and fit (bool; else held out) of at most ``limit`` labelled documents, by id."""
    one = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good"))
    h = F.xxhash64("doc_id", F.lit(SEED))
    rows = sorted((r.doc_id, r.good, r.fit) for r in one.select("doc_id", "good", (F.pmod(h, F.lit(2)) == 0).alias("fit"), h.alias("h")).orderBy("h", "doc_id").limit(limit).collect())
    ids, good, fit = zip(*rows, strict=True) if rows else ((), (), ())
    return np.array(ids, dtype=np.int64), np.array(good, dtype=bool), np.array(fit, dtype=bool)


def fitted(docs: DataFrame, ids: np.ndarray, good: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """The table of log ratios. docs: doc_id, text (bytes)."""
    counts = docs.mapInArrow(_counts(ids[fit], good[fit]), "bucket int, raw long, target long, bad long")
    table = counts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "target", "bad")]).toArrow()
    of = {c: np.zeros(BUCKETS) for c in ("raw", "target", "bad")}
    for c, x in of.items():
        x[table.column("bucket").to_numpy()] = table.column(c).to_numpy()
    return log_ratios(**of)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight above which documents count as good with the fewest errors; ties go to the lower cut."""
    values = np.unique(weights)
    cuts = np.concatenate(([values[0] - 1], (values[:-1] + values[1:]) / 2)) if len(values) else np.array([-np.inf])
    lost = np.searchsorted(np.sort(weights[good]), cuts, side="right")
    passed = (~good).sum() - np.searchsorted(np.sort(weights[~good]), cuts, side="right")
    return float(cuts[np.argmin(lost + passed)]) if len(weights) else -np.inf


def gumbel_key(id_col: str, weight_col: str) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(SEED + 1)), 12).cast("double") + 0.5) / float(1 << 52)
    return F.col(weight_col) - F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, few: int = 10_000, bins: int = 512) -> float:
    """The k-th largest value of the column ``key``, 1 <= k <= rows."""
    edge = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    lo, hi, need = edge.lo, edge.hi, k
    while True:
        inside = keys.filter((F.col("key") >= lo) & (F.col("key") <= hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width <= lo:
            return hi
        place = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1))
        found = {r.b: r for r in inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            if need <= found[b].n:
                break
            need -= found[b].n
        lo, hi = found[b].lo, found[b].hi
        if lo == hi:
            return lo
        if found[b].n <= few:
            values = sorted((r.key for r in keys.filter((F.col("key") >= lo) & (F.col("key") <= hi)).select("key").collect()), reverse=True)
            return values[need - 1]


class Selection:
    """A fitted selection: the table of log ratios and the least key that is kept."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        spark = docs.sparkSession
        base = id_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
        ids, good, fit = labelled(labels)
        self.table = spark.sparkContext.broadcast(fitted(base, ids, good, fit))
        weights = base.mapInArrow(_weigh(self.table), "doc_id long, weight double")
        self.weights = saved(weights, "weights").withColumn("key", gumbel_key("doc_id", "weight"))
        held = spark.createDataFrame([(int(i), bool(g)) for i, g in zip(ids[~fit], good[~fit], strict=True)], "doc_id long, good boolean")
        # One row a label, however many rows share its id: the worst weight counts. At most LABELS rows reach the driver.
        checked = self.weights.join(F.broadcast(held), "doc_id").groupBy("doc_id").agg(F.min("weight").alias("weight"), F.first("good").alias("good")).collect()
        cut = best_cut(np.array([r.weight for r in checked]), np.array([r.good for r in checked], dtype=bool))
        k = self.weights.filter(F.col("weight") > cut).count()
        self.least = kth_largest(self.weights, k) if k else float("inf")


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, log_weight, gumbel_key, kept."""
    s = Selection(docs, labels)
    return s.weights.select("doc_id", F.col("weight").alias("log_weight"), F.col("key").alias("gumbel_key"), (F.col("key") >= s.least).alias("kept"))


def keep_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The selected documents, with all their columns; texts are weighed where they are read and never shuffled."""
    s = Selection(docs, labels)
    weight = free_name(docs, "weight")
    return weighed(docs, s.table, weight).filter(gumbel_key("doc_id", weight) >= s.least).drop(weight)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
