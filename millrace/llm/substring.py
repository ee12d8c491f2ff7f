"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: h = 2 h + G[byte]. A chunk ends where four bits of h are zero, which
depends on the last 16 bytes alone, so boundaries move with the text when something is inserted before it. A chunk that finds no such
place within 64 bytes ends where two bits are zero, and after 96 bytes anywhere. Chunks have
16 to 96 bytes, 32 on average, and are known by a 128-bit digest. A chunk is a repeat when an equal one
starts earlier (smaller doc_id, or the same document and earlier start). Runs of neighbouring repeated chunks of at least
``min_run`` bytes, or that are a whole document, are removed; shorter ones (a common short line, say) stay.

Chunks of one digest are combined where they are read, so frequent passages send one row per 32 MB of text
(see ``spans``). Texts are shuffled once, to be cut.

Defined cases: a null text is empty; a null id has no place in the order, so its text stays whole and removes nothing elsewhere; rows
that repeat an id are one document and must repeat its text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row, documents, id_text, saved
from .spans import ROWS, cut_spans, repeats_and_mixed, stretches

MIN_CHUNK, SOFT_CHUNK, MAX_CHUNK = 16, 64, 96
MIN_RUN = 64
_MASK, _SOFT_MASK = np.uint32(0xF000), np.uint32(0xC000)
#: Gear values: one 32-bit hash per byte value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], dtype=np.uint32)


def gear(raw: bytes) -> np.ndarray:
    """The gear hash after each byte, right in its lowest 16 bits: sums over the last 16 bytes by doubling."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    for size in (1, 2, 4, 8):
        h[size:] = h[size:] + (h[:-size] << np.uint32(size))
    return h


def boundaries(raw: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    h = gear(raw)
    cuts = (np.flatnonzero((h & _MASK) == 0) + 1).tolist()
    soft = None
    out, at, n, i, k = [], 0, len(raw), 0, len(cuts)
    while at < n:
        i = bisect_left(cuts, at + MIN_CHUNK, i)
        end = cuts[i] if i < k else n
        if end > at + SOFT_CHUNK:
            if soft is None:
                soft = (np.flatnonzero((h & _SOFT_MASK) == 0) + 1).tolist()
            j = bisect_left(soft, at + SOFT_CHUNK)
            end = min(end, soft[j] if j < len(soft) else n, at + MAX_CHUNK)
        at = min(end, n)
        out.append(at)
    return out


def chunks(raw: bytes):
    if not raw:
        return
    ends = boundaries(raw)
    starts = [0, *ends[:-1]]
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(starts, ends, strict=True)]), dtype="<u8").reshape(-1, 2)
    start, end = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)
    yield digests[:, 0].copy(), digests[:, 1].copy(), start, end - start


def substring_dedup(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets)."""
    return by_row(id_text(docs, id_col, text_col), lambda rows: _substring_dedup(rows, min_run))


def _substring_dedup(texts: DataFrame, min_run: int) -> DataFrame:
    base = texts.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = base.filter("doc_id is not null").mapInArrow(stretches(chunks, None), ROWS)
    repeats = saved(repeats_and_mixed(rows, False).select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("extent")).alias("e")), "chunks")
    return cut_spans(base, repeats, min_run)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
