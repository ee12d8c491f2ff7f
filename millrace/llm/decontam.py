"""Benchmark decontamination with one Aho-Corasick automaton.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased: digits, a-z and every
character outside ASCII. A benchmark item of n words gives its windows of 13 consecutive words, or, with fewer
words, one window of all of them. The windows of all items form one automaton; each text is scanned once by it.

The automaton reads words, not characters: every word of the benchmark gets a code of a fixed number of letters
(one alphabet for each place in the code, so that codes can only match in step), any other word gets a code of
its own that no pattern holds. A match's end therefore gives the index of its last word, and word offsets map
it back to the original text.

The operator needs no shuffle: the table of documents is only mapped. The benchmark is read in blocks
of at most ``block_bytes`` bytes of text (the proven bound on what the driver holds and broadcasts); a longer item is cut into parts that
overlap by a window less one word. Where there are more blocks, each gets its own automaton and its own scan, one after the other over
a saved copy of the documents with row numbers, and the matches of a row are merged by its number.

Defined cases: null or wordless texts have no words, no hit and are clean, whatever their ids; items without words match
nothing; items of one id count once, and a null item id counts as the id ''; empty tables give empty or clean results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, id_text, saved, sorted_side

WINDOW = 13
SHARE = 20  # contaminated from one word in so many
#: Every byte that is no part of a word becomes a space.
_WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_WORD_RUN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BASE = 32


def words(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8. bytes.lower() lowers A-Z alone."""
    return text.lower().translate(_WORD_BYTES).split()


class Automaton:
    """Benchmark windows, ready to scan word lists."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        found: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            w = words((text or "").encode())
            if w:
                for i in range(max(1, len(w) - window + 1)):
                    found[tuple(w[i : i + window])].add(item)
        vocabulary = {x: i for i, x in enumerate(sorted({x for w in found for x in w}))}
        self.width = 1
        while _BASE**self.width < len(vocabulary):
            self.width += 1
        self.codes = {x: self._code(i) for x, i in vocabulary.items()}
        self.other = chr(1) * self.width
        self.windows = list(found.items())
        self.automaton = ahocorasick.Automaton()
        for i, (w, _) in enumerate(self.windows):
            self.automaton.add_word("".join(self.codes[x] for x in w), i)
        if self.windows:
            self.automaton.make_automaton()

    def _code(self, i: int) -> str:
        out = []
        for place in range(self.width):
            i, digit = divmod(i, _BASE)
            out.append(chr(256 + place * _BASE + digit))
        return "".join(out)

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit intervals of word indexes (end exclusive) and the items met."""
        if not self.windows:
            return [], set()
        get, other = self.codes.get, self.other
        coded = "".join([get(x, other) for x in w])
        hits, items = [], set()
        for end, i in self.automaton.iter(coded):
            window, of = self.windows[i]
            e = end // self.width + 1
            hits.append((e - len(window), e))
            items |= of
        return merged(hits), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals; touching ones stay one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Word intervals as code point offsets of the original text."""
    if not spans:
        return []
    at = [m.span() for m in _WORD_RUN.finditer(text.lower())]
    chars = lambda n: len(text[:n].decode())
    return [{"start": chars(at[s][0]), "end": chars(at[e - 1][1])} for s, e in spans]


_OUT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, hits array<struct<s:int,e:int>>"
_ARROW = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("hits", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
    ]
)


_AUTOMATA: dict[str, Automaton] = {}


def _automaton(name: str, items: Broadcast, window: int) -> Automaton:
    """One automaton a worker process and broadcast block; the last one is kept."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = Automaton(items.value, window)
    return _AUTOMATA[name]


def _row(text: bytes, n_words: int, items: list[str], hits: list[tuple[int, int]]) -> dict:
    return {
        "n_words": n_words,
        "n_hit": sum(e - s for s, e in hits),
        "items": items,
        "spans": char_spans(text, hits),
        "hits": [{"s": s, "e": e} for s, e in hits],
    }


def _with_key(batch: pa.RecordBatch, rows: list[dict]) -> pa.RecordBatch:
    found = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
    return pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=[batch.schema.names[0], *_ARROW.names])


def _scan(items: Broadcast, window: int):
    """Over batches of (key, text): the key, of any type, and what is found in the text."""

    name = uuid.uuid4().hex

    def run(batches):
        automaton = _automaton(name, items, window)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                w = words(text)
                hits, of = automaton.scan(w)
                rows.append(_row(text, len(w), sorted(of), hits))
            yield _with_key(batch, rows)

    return run


def _parts(text: str, block_bytes: int, window: int) -> list[str]:
    """A text, or the overlapping parts of one that is longer than a block, which have the same windows."""
    raw = text.encode()
    if len(raw) <= block_bytes:
        return [text]
    w = words(raw)
    out, at = [], 0
    while True:
        end, size = at, 0
        while end < len(w) and (end - at < window or size + len(w[end]) < block_bytes):
            size += len(w[end]) + 1
            end += 1
        out.append(b" ".join(w[at:end]).decode())
        if end >= len(w):
            return out
        at = end - window + 1


def benchmark_blocks(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str, window: int = WINDOW):
    """Lists of (item, text) of about ``block_bytes`` bytes of text at most; one list at a time is held."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    block, size = [], 0
    for row in items.toLocalIterator():
        for part in _parts(row.t, block_bytes, window):
            n = len(part.encode())
            if block and size + n > block_bytes:
                yield block
                block, size = [], 0
            block.append((row.i, part))
            size += n
    yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = 8_000_000,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids as strings), spans (code point offsets in
    the original text), contaminated."""
    base = id_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return _scanned(base, benchmark_blocks(benchmark, block_bytes, item_col, item_text_col, window), window)


def _scanned(base: DataFrame, blocks, window: int) -> DataFrame:
    """base: a key of any type and the text as bytes."""
    key, kind = base.columns[0], base.dtypes[0][1]
    first, second = next(blocks), next(blocks, None)
    if second is None:
        out = base.mapInArrow(_scan(base.sparkSession.sparkContext.broadcast(first), window), f"{key} {kind}, {_OUT}")
    else:
        out = _merge_scans(base, chain((first, second), blocks), window)
    return out.select(key, "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _merge_scans(base: DataFrame, blocks, window: int) -> DataFrame:
    """Several blocks: the matches of a row in all of them, united. Rows are known by numbers given in a saved copy."""
    key, kind = base.columns[0], base.dtypes[0][1]
    numbered = saved(base.withColumn("row", F.monotonically_increasing_id()), "numbered")
    hit = None
    for block in blocks:
        items = base.sparkSession.sparkContext.broadcast(block)
        part = numbered.select("row", "text").mapInArrow(_scan(items, window), f"row long, {_OUT}").filter("n_hit > 0").select("row", "items", "hits")
        part = saved(part, "hits")
        items.destroy()
        hit = part if hit is None else hit.unionByName(part)
    hit = hit.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("hits")).alias("hits"))
    count = numbered.join(sorted_side(hit), "row", "left").select(key, "text", "items", "hits")

    def run(batches):
        for batch in batches:
            rows = []
            for text, items, hits in zip(*(batch.column(k).to_pylist() for k in ("text", "items", "hits")), strict=True):
                rows.append(_row(text, len(words(text)), items or [], merged([(h["s"], h["e"]) for h in hits or []])))
            yield _with_key(batch, rows)

    return count.mapInArrow(run, f"{key} {kind}, {_OUT}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 8_000_000) -> DataFrame:
    """The clean documents with all their columns. Rows are judged each by its own text (known by its MD5): equal texts share their
    fate, null and repeated ids decide nothing for other texts."""
    text_key = free_name(docs, "clean_text")
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    found = _scanned(docs.select(F.unhex(F.md5(raw)).alias("t"), raw.alias("text")), benchmark_blocks(benchmark, block_bytes, "item_id", "text", window), window)
    bad = found.filter("contaminated").select(F.col("t").alias(f"{text_key}_bad")).distinct()
    named = docs.withColumn(text_key, F.unhex(F.md5(raw)))
    return named.join(sorted_side(bad), F.col(text_key) == F.col(f"{text_key}_bad"), "left_anti").drop(text_key)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM benchmark),
p AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM p),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw) dw JOIN win ON dw.g = win.g AND dw.n = win.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
