"""Removal of repeated strings by prefix-free parsing.

A rolling hash over ``K`` bytes marks triggers: in every window of ``length`` bytes the place with the least hash. So
each window has exactly one trigger, which depends on the window's bytes alone, and consecutive windows that share a trigger
form a phrase. Phrases overlap by length - 1 bytes: every window lies inside one phrase, as a suffix
of it cut to ``length`` bytes. Equal windows lie at the same distance from equal triggers.

The dictionary is the set of distinct phrases, the parse their sequence in the corpus. A phrase that occurs
earlier in the corpus makes all its windows repeats. What is left to compare are windows of different phrases under
one trigger: for such phrases the suffixes of the dictionary, cut to ``length`` bytes, are sorted by their bytes (a suffix array of the
phrases of a trigger), neighbours whose common prefix is the whole ``length`` are equal windows, and among those the parse's corpus order
tells the earliest. Windows of different triggers differ, so the arrays of all triggers together are the dictionary's; other phrases,
the bulk, have no equal window under another phrase and are dropped after one shuffle. Windows are thus compared byte by byte, phrases by
a 128-bit key. The full suffix array of the corpus is never formed; the README says why.

Groups are sorted in partitions by trigger in bounded batches. A trigger with more than ``group_rows`` phrases (the
edge of a passage that very many documents share) is not gathered: its windows are aggregated one by one.

Defined cases: a null text is empty; texts shorter than ``length`` stay whole; a null id has no place in the order, so its
text stays whole and removes nothing elsewhere; rows that repeat an id are one document and must repeat its text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row, documents, id_text, saved, sorted_side
from .spans import ROWS, cut_spans, repeats_and_mixed, stretches

LENGTH, K = 100, 32
SEGMENT = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=_U))


def rolled(raw: bytes, n: int) -> np.ndarray:
    """A 64-bit polynomial hash of every n-byte string, from hashes of doubling lengths."""
    h = _BYTE[np.frombuffer(raw, np.uint8)]
    total, size, out, have = len(h), 1, None, 0
    while True:
        if n & size:
            if out is None:
                out, have = h, size
            else:
                m = total - have - size + 1
                out = out[:m] * _U(pow(_BASE, size, 1 << 64)) + h[have : have + m]
                have += size
        if 2 * size > n:
            return out
        m = total - 2 * size + 1
        h = h[:m] * _U(pow(_BASE, size, 1 << 64)) + h[size : size + m]
        size *= 2


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def phrases(length: int):
    """A cutter for ``stretches``: trigger hash, phrase digest, first window and number of windows."""
    k = min(K, length)

    def cut(raw: bytes):
        for at in range(0, len(raw) - length + 1, SEGMENT):
            part = raw[at : at + SEGMENT + length - 1]
            grams = _mix(rolled(part, k))
            # The leftmost of equal hashes wins: the place is the low part of the key.
            keys = (grams & ~_U(0x1FFFFF)) | np.arange(len(grams), dtype=_U)
            least = _least(keys, length - k + 1)
            start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
            end = np.concatenate((start[1:], [len(least)]))
            digest = [xxhash.xxh3_64_intdigest(part[s : e + length - 1]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
            yield grams[(least[start] & _U(0x1FFFFF)).astype(np.intp)], np.array(digest, dtype=_U), start + at, end - start

    return cut


_PHRASE_FIELDS = pa.schema([("t", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
_SPAN_FIELDS = pa.schema([("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def _fetch(length: int):
    """The bytes of the phrases that a document is asked for."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for doc, text, wanted in zip(batch.column("doc_id"), batch.column("text"), batch.column("wanted"), strict=True):
                raw = text.as_py()
                for x in wanted.as_py():
                    for c, v in zip(out, (x["t"], doc.as_py(), x["start"], raw[x["start"] : x["start"] + x["extent"] + length - 1]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PHRASE_FIELDS, strict=True)], schema=_PHRASE_FIELDS)

    return run


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, document and place of every window of the phrases of a batch."""
    texts = batch.column("bytes").to_pylist()
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    count = sizes - length + 1
    every = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(texts), np.uint8), length)
    first = np.repeat(np.cumsum(sizes) - sizes, count)
    inside = np.arange(int(count.sum()), dtype=np.int64) - np.repeat(np.cumsum(count) - count, count)
    doc = np.repeat(batch.column("doc_id").to_numpy(), count)
    return np.ascontiguousarray(every[first + inside]).view(f"S{length}").ravel(), doc, np.repeat(batch.column("start").to_numpy(), count) + inside


def _repeated_windows(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Spans of the windows that an earlier window of the batch equals: a suffix array by bytes, then corpus order among equals."""
    w, doc, at = _windows(batch, length)
    _, rank = np.unique(w, return_inverse=True)
    o = np.lexsort((at, doc, rank))
    again = np.zeros(len(w), dtype=bool)
    again[o[1:]] = (rank[o[1:]] == rank[o[:-1]]) & ((doc[o[1:]] != doc[o[:-1]]) | (at[o[1:]] != at[o[:-1]]))
    doc, at = doc[again], at[again]
    o = np.lexsort((at, doc))
    doc, at = doc[o], at[o]
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)))[: len(at)])
    last = np.concatenate((cut[1:], [len(at)]))[: len(cut)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(at[cut]), pa.array(at[last] + length)], schema=_SPAN_FIELDS)


def _sorted_groups(length: int, batch_rows: int = 6_000):
    """Over partitions sorted by trigger: work on whole triggers, at least ``batch_rows`` phrases at a time."""

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            t = held.column("t").to_numpy()
            if len(t) >= batch_rows and t[0] != t[-1]:
                n = int(np.flatnonzero(t != t[-1])[-1]) + 1
                yield _repeated_windows(held.slice(0, n), length)
                held = held.slice(n)
        if held is not None and held.num_rows:
            yield _repeated_windows(held, length)

    return run


_WINDOW_FIELDS = pa.schema([("w", pa.binary()), ("doc_id", pa.int64()), ("at", pa.int64())])


def _each_window(length: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                w, doc, at = _windows(batch.slice(i, 500), length)
                raw = w.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[j : j + length] for j in range(0, len(raw), length)], pa.binary()), pa.array(doc), pa.array(at)], schema=_WINDOW_FIELDS)

    return run


def _crowded(rows: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows under triggers with very many phrases, by aggregation of the windows' bytes."""
    windows = saved(rows.select("t", "doc_id", "start", "bytes").mapInArrow(_each_window(length), "w binary, doc_id long, at long"), "windows")
    firsts = windows.groupBy("w").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    later = windows.join(firsts, "w").filter(F.struct("doc_id", "at") > F.col("first"))
    return later.select("doc_id", F.col("at").alias("s"), (F.col("at") + length).alias("e"))


def repeated_strings(docs: DataFrame, length: int = LENGTH, group_rows: int = 20_000, many: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets)."""
    return by_row(id_text(docs, id_col, text_col), lambda rows: _repeated_strings(rows, length, group_rows, many))


def _repeated_strings(texts: DataFrame, length: int, group_rows: int, many: int) -> DataFrame:
    base = texts.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = base.filter("doc_id is not null").mapInArrow(stretches(phrases(length), many), ROWS)
    found = saved(repeats_and_mixed(rows, True).select("t", "doc_id", "start", "extent", "mixed"), "phrases")
    whole = found.filter("not mixed").select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("extent") + length - 1).alias("e"))
    mixed = found.filter("mixed")
    wanted = mixed.groupBy("doc_id").agg(F.collect_list(F.struct("t", "start", "extent")).alias("wanted"))
    fetched = saved(base.join(sorted_side(wanted), "doc_id").select("doc_id", "text", "wanted").mapInArrow(_fetch(length), "t long, doc_id long, start long, bytes binary"), "dictionary")
    crowded = saved(mixed.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > group_rows).select("t"), "crowded")
    spans = whole
    few = fetched
    if not crowded.isEmpty():
        few = fetched.join(crowded, "t", "left_anti")
        spans = spans.unionByName(_crowded(fetched.join(crowded, "t", "left_semi"), length))
    sorted_spans = few.repartition("t").sortWithinPartitions("t").select("t", "doc_id", "start", "bytes").mapInArrow(_sorted_groups(length), "doc_id long, s long, e long")
    return cut_spans(base, spans.unionByName(sorted_spans))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_strings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
