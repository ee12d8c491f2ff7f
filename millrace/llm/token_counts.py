"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The tokenizer is a byte-pair encoding with scores and byte fallback (a sentencepiece model; its path is a
parameter). A sequence of pieces is the encoding of its text exactly when every two neighbours are the encoding
of theirs. So the encoding of a prefix ends with the one piece t for which the encoding of what precedes t ends
with a piece that is compatible with t; count[i] = count[i - len(t)] + 1. One pass over a text thus gives the count
at every prefix, and no prefix is encoded again.

In such models pieces never hold a space after another character, nor a line feed, so encodings never cross
the start of a word. The programme runs per word and keeps its table of count changes for words that
return; the table of a text is the concatenation of those of its words. Where a model has other pieces, the programme runs over
the whole text.

``TokenCounter.deltas`` holds, for each code point, the change of the count when that code point is added.
``tokens_at`` and ``longest_prefix`` answer truncation and budget questions from it alone.

Defined cases: null and empty texts have no tokens; ids may be null or repeat, each row is counted by itself;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text

SPACE = "▁"
LIMIT = 4096
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class TokenCounter:
    """Prefix counts under one sentencepiece BPE model. Memory is bounded: two generations of ``keep`` words, and
    piece pairs."""

    def __init__(self, model_file: str, keep: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        usable = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {p: r for r, p in enumerate(sorted((model.id_to_piece(i) for i in usable), key=lambda p: -model.get_score(model.piece_to_id(p))))}
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.rank) and not any("\n" in p for p in self.rank)
        # Lengths of the pieces of three characters or more that end in three given ones, longest first.
        ends = defaultdict(set)
        for p in self.rank:
            if len(p) > 2:
                ends[p[-3:]].add(len(p))
        self.lengths = {e: (*sorted(x, reverse=True), 2, 1) for e, x in ends.items()}
        self.keep = keep
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words, self.older = {}, {}  # by word without the space before it
        self.firsts = {}  # words without a space before them, which start lines
        self.line_feed = self._table("\n")

    def _merge(self, s: str) -> list[str]:
        """The encoding of a short string: merge the best-ranked pair, leftmost first, until none is left."""
        parts, rank = list(s), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, a: str, b: str) -> bool:
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            got = self._merge(a + b) == [a, b] if a else self._merge(b) == [b]
            if len(self.pairs) > 2 * self.keep:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def counts(self, s: str) -> list[int]:
        """Token counts of all prefixes of a unit whose spaces are written as the model does; counts[0] is 0."""
        count, last = [0], [""]
        rank, pairs, lengths = self.rank, self.pairs.get, self.lengths.get
        for i in range(1, len(s) + 1):
            for n in lengths(s[i - 3 : i], (2, 1)) if i > 2 else (2, 1)[2 - i :]:
                if n > i:
                    continue
                t = s[i - n : i]
                if t in rank:
                    more = 1
                elif n == 1:
                    more = len(t.encode())
                else:
                    continue
                a = last[i - n]
                fits = pairs((a, t))
                if self._fits(a, t) if fits is None else fits:
                    count.append(count[i - n] + more)
                    last.append(t)
                    break
            else:
                raise AssertionError("every prefix has an encoding")
        return count

    def _table(self, s: str) -> bytes:
        c = self.counts(s)
        return array("h", [y - x for x, y in zip(c, c[1:])]).tobytes()

    def _word(self, w: str) -> bytes:
        """The table of a word and the space before it."""
        if len(self.words) > self.keep:
            self.older = dict(self.words)
            self.words.clear()
        got = self.words[w] = self.older.get(w) or self._table(SPACE + w)
        return got

    def _first(self, w: str) -> bytes:
        if len(self.firsts) > self.keep // 4:
            self.firsts.clear()
        got = self.firsts[w] = self._table(w)
        return got

    def deltas(self, text: str) -> bytes:
        """For each code point of the text the change of the count, as little-endian 16-bit integers."""
        if not text:
            return b""
        if not self.by_word:
            return self._without_dummy(self._table(SPACE + text.replace(" ", SPACE)))
        out = []
        get, word = self.words.get, self._word
        for i, line in enumerate(text.replace(SPACE, " ").split("\n")):
            if i:
                out.append(self.line_feed)
            else:
                line = " " + line
            if line:
                parts = line.split(" ")
                if "" in parts[1:]:
                    out.extend([self._table(u) for u in _RUNS.findall(line.replace(" ", SPACE))])
                else:
                    first = parts[0]
                    if first:
                        out.append(self.firsts.get(first) or self._first(first))
                    out.extend([get(p) or word(p) for p in parts[1:]])
        return self._without_dummy(b"".join(out))

    @staticmethod
    def _without_dummy(table: bytes) -> bytes:
        """The space that the model puts before a text is no part of it; its count goes to the first code point."""
        d = np.frombuffer(table, "<i2").copy()
        d[1] += d[0]
        return d[1:].tobytes()


def tokens_at(deltas: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(np.frombuffer(deltas, "<i2")[:n_chars].sum(dtype=np.int64))


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    fit = np.flatnonzero(np.frombuffer(deltas, "<i2").cumsum(dtype=np.int64) <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


_COUNTERS: dict[str, TokenCounter] = {}


def counter(model_file: str) -> TokenCounter:
    """One counter a worker process; its tables outlive a task."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = TokenCounter(model_file)
    return _COUNTERS[model_file]


def prefix_counts(docs: DataFrame, model_file: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", store: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, fit_chars (longest prefix within ``limit`` tokens) and,
    with ``store``, prefix_deltas (zlib of the table of count changes)."""
    base = id_text(docs, id_col, text_col)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("fit_chars", pa.int64())] + [("prefix_deltas", pa.binary())] * store
    schema = pa.schema(fields)

    def run(batches):
        c = counter(model_file)
        for batch in batches:
            ids, cols = batch.column(0), ([], [], [], [])
            for text in batch.column(1):
                text = text.as_py()
                d = c.deltas(text)
                n = tokens_at(d, len(text))
                cols[0].append(len(text.encode()))
                cols[1].append(n)
                cols[2].append(len(text) if n <= limit else longest_prefix(d, limit))
                if store:
                    cols[3].append(zlib.compress(d, 1))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, f[1]) for x, f in zip(cols, fields[1:], strict=False)]], schema=schema)

    return base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fit_chars long" + ", prefix_deltas binary" * store)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = prefix_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), store=False)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")
