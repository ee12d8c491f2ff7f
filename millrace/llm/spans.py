"""First occurrences of content-keyed stretches of text, and cutting byte spans out of documents.

A stretch is (t, d, doc_id, place): t and d are its 128-bit key, place packs its first byte and extent. The mapper
combines the stretches of about 32 MB of text at a time: of equal ones only the earliest goes on, the others are known to be
repeats. What reaches a reducer for one key is thus one row per 32 MB of input at most, however many copies there are; reducers
stream over sorted rows and hold one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sorted_side

#: Kinds of rows: the earliest of its key in its chunk; a known repeat; a stretch under a trigger that is
#: known to have several contexts; a marker for such a trigger.
FIRST, REPEAT, MIXED, MARKER = 0, 1, 2, 3

ROWS = "t long, d long, doc_id long, place long"
FIELDS = pa.schema([("t", pa.int64()), ("d", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
CHUNK_BYTES = 32_000_000


def place(start: np.ndarray, extent: np.ndarray, kind) -> np.ndarray:
    return (start.astype(np.int64) << 20) | (extent.astype(np.int64) << 4) | kind


def table(t, d, doc, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(d.view(np.int64)), pa.array(doc), pa.array(at)], schema=FIELDS)


def combined(t: np.ndarray, d: np.ndarray, doc: np.ndarray, start: np.ndarray, extent: np.ndarray, many: int | None) -> pa.RecordBatch:
    """One chunk's rows. With ``many``, triggers of more than so many contexts in the chunk are sent on as mixed."""
    o = np.lexsort((start, doc, d, t))
    t, d, doc, start, extent = t[o], d[o], doc[o], start[o], extent[o]
    new_t = np.concatenate(([True], t[1:] != t[:-1]))[: len(t)]
    new = new_t | np.concatenate(([True], d[1:] != d[:-1]))[: len(t)]
    other = new | np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])))[: len(t)]
    if not other.all():  # rows of a repeated id are one document
        return combined(t[other], d[other], doc[other], start[other], extent[other], many)
    kind = np.where(new, FIRST, REPEAT)
    if many is not None and len(t):
        group = np.cumsum(new_t) - 1
        crowded = np.bincount(group, weights=new) > many
        kind = np.where(new & crowded[group], MIXED, kind)
        mark = new_t & crowded[group]
        m = t[mark]
        zero = np.zeros(len(m), dtype=np.int64)
        t, d, doc = np.concatenate((t, m)), np.concatenate((d, zero.view(d.dtype))), np.concatenate((doc, zero))
        start, extent, kind = np.concatenate((start, zero)), np.concatenate((extent, zero)), np.concatenate((kind, zero + MARKER))
    return table(t, d, doc, place(start, extent, kind))


def stretches(cut, many: int | None):
    """A mapInArrow function over (doc_id, text as bytes). ``cut(bytes)`` gives arrays t, d, start, extent."""

    def run(batches):
        held, size = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return combined(*cols, many)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py()
                for t, d, start, extent in cut(raw):
                    held.append((t, d, np.full(len(t), doc.as_py(), dtype=np.int64), start, extent))
                size += len(raw)
                if size >= CHUNK_BYTES and held:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


class _Stream:
    """Reducer state between batches: the last trigger, its last key, whether it is mixed, and its only first row."""

    def __init__(self, want_mixed: bool):
        self.want_mixed = want_mixed
        self.t = self.d = self.doc = self.at = None
        self.mixed = False
        self.held = None

    def work(self, t, d, doc, at, kind):
        """Rows of kinds FIRST and MARKER, sorted by t, markers first, then d, doc_id, place."""
        if not len(t):
            return []
        out = []
        marker = kind == MARKER
        new_t = np.concatenate(([self.t is None or t[0] != self.t], t[1:] != t[:-1]))
        new = new_t | np.concatenate(([self.d is None or d[0] != self.d], d[1:] != d[:-1]))
        # A marker's d is no context: the row after it starts one.
        new[1:] |= marker[:-1]
        if self.d is None:
            new[0] = True
        same = np.concatenate(([doc[0] == self.doc and at[0] == self.at], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])))
        first, repeat = new & ~marker, ~new & ~marker & ~same  # the same place again comes from a repeated id
        out.append((t[repeat], d[repeat], doc[repeat], (at[repeat] & ~np.int64(15)) | REPEAT))
        if self.want_mixed:
            group = np.cumsum(new_t)  # 0: the trigger of the batch before goes on
            contexts = np.bincount(group, weights=first, minlength=group[-1] + 1)
            marked = np.bincount(group, weights=marker, minlength=group[-1] + 1) > 0
            if self.held is not None:
                contexts[0] += 1
            mixed = marked | (contexts > 1)
            mixed[0] |= self.mixed
            if self.held is not None and (mixed[0] or group[0] > 0 or group[-1] > 0):
                if mixed[0]:
                    out.append(self.held)
                self.held = None
            go = first & mixed[group]
            out.append((t[go], d[go], doc[go], (at[go] & ~np.int64(15)) | MIXED))
            last = group[-1]
            self.mixed = bool(mixed[last])
            if not self.mixed:
                i = np.flatnonzero(first & (group == last))
                if len(i):
                    self.held = (t[i], d[i], doc[i], (at[i] & ~np.int64(15)) | MIXED)
        self.t, self.d, self.doc, self.at = t[-1], None if marker[-1] else d[-1], doc[-1], at[-1]
        return out


def _reduce(want_mixed: bool):
    def run(batches):
        state = _Stream(want_mixed)
        for batch in batches:
            t, d, doc, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            kind = at & 15
            ready = (kind == REPEAT) | (kind == MIXED)
            out = [(t[ready], d[ready], doc[ready], at[ready])]
            rest = ~ready
            out += state.work(t[rest], d[rest], doc[rest], at[rest], kind[rest])
            for x in out:
                if len(x[0]):
                    yield table(*x)

    return run


def repeats_and_mixed(rows: DataFrame, want_mixed: bool) -> DataFrame:
    """Of all stretches: the repeats (an equal one starts earlier) and, if wanted, the earliest of every key whose
    trigger t has several keys. Columns t, d, doc_id, start, extent, mixed."""
    kind = F.expr("place & 15")
    by = F.when(kind.isin(FIRST, MARKER), F.col("t")).otherwise(F.xxhash64("d", "doc_id", "place"))
    dealt = rows.repartition(by).sortWithinPartitions("t", F.expr("(place & 15) <> 3"), "d", "doc_id", "place")
    out = dealt.mapInArrow(_reduce(want_mixed), ROWS)
    return out.select("t", "d", "doc_id", F.shiftright("place", 20).alias("start"), F.expr("(place >> 4) & 65535").alias("extent"), (kind == MIXED).alias("mixed"))


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_CUT_FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans; touching ones become one."""
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    cut = np.concatenate(([True], s[1:] > e[:-1]))
    return s[cut], e[np.concatenate((cut[1:], [True]))]


def _cut(min_run: int):
    def run(batches):
        for batch in batches:
            cols = ([], [], [], [], [])
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py()
                found = spans.as_py() or []
                s, e = runs(np.array([x["s"] for x in found], dtype=np.int64), np.array([x["e"] for x in found], dtype=np.int64)) if found else (np.empty(0, np.int64),) * 2
                keep = (e - s >= min_run) | (e - s == len(raw))
                s, e = s[keep].tolist(), e[keep].tolist()
                sha, at = hashlib.sha256(), 0
                for x, y in zip(s, e, strict=True):
                    sha.update(raw[at:x])
                    at = y
                sha.update(raw[at:])
                for c, v in zip(cols, (len(raw), sum(e) - sum(s), len(s), sha.hexdigest(), [{"start": x, "end": y} for x, y in zip(s, e, strict=True)]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(cols, list(_CUT_FIELDS)[1:], strict=True)]], schema=_CUT_FIELDS)

    return run


def cut_spans(base: DataFrame, spans: DataFrame, min_run: int = 1) -> DataFrame:
    """Every document (doc_id, text as bytes) without the bytes of its spans (doc_id, s, e): counts, the checksum of what is
    left and the maximal removed runs. Runs shorter than ``min_run`` bytes stay, unless they are the whole text."""
    of_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return base.join(sorted_side(of_doc), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut(min_run), CUT)
