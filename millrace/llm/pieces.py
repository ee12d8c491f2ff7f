"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder is the score-ordered agenda of adjacent symbol pairs: a text starts as one symbol per character, every neighbouring pair whose concatenation is a piece enters a heap
under (best score, leftmost place), and the top pair is merged until the heap is empty. A merge puts the pairs with its two new neighbours on
the heap; entries whose symbols have changed since are skipped when they come up. Symbols that are no piece fall back to their bytes.

Merges never cross a place at which no piece holds the two characters side by side. Where the vocabulary has no piece with a
space after another character and none with a line feed, the agenda therefore runs per word (a word and the spaces before it), and the results
of words that return are kept, in a table of bounded size. Under any other vocabulary it runs over the whole text.

Decoding joins the bytes of the pieces: byte pieces form runs that are read as UTF-8, an invalid byte
becomes U+FFFD, control pieces are silent, the unknown piece has its own surface, and the one space that the model puts before a text goes.

The encoder is checked against the sentencepiece library in Arrow batches: all words that are new to a worker's tables in a batch go to the library in one call,
and a difference fails the job. Whole texts can be compared too.

Defined cases: null and empty texts have no ids and decode to the empty text; ids of rows may be null or repeat, each row is encoded by
itself; other columns are ignored; an empty table gives an empty result; a very long word takes one heap, n log n in its length.
Models that aren't BPE, or that hold unused pieces (which the library splits up again) or user-defined ones (which never merge), are refused.
"""

from __future__ import annotations

from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text

SPACE = "▁"
_PROBES = ["a", " a", "a ", "  a  b ", "a\tb\n c\r", "Ａ ﬁ é é", " 　x", "\x00​"]
#: Longer words are encoded each time they come.
LONGEST_KEPT = 48
#: Up to so many symbols the agenda is a list, beyond a heap.
SHORT = 40
NEVER = float("inf")


class PieceCodec:
    """Encoder and decoder of one model; tables of at most ``keep`` words and their older generation."""

    def __init__(self, model_file: str, keep: int = 400_000):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(model.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.id_of = {model.id_to_piece(i): i for i in plain}
        #: What makes a pair come early in the agenda: less is earlier.
        self.cost = {p: -model.get_score(i) for p, i in self.id_of.items()}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = None if all(model.is_byte(i) for i in self.byte) else model.unk_id()
        self.normalised = all(model.normalize(t) == self._spaced(t) for t in _PROBES)  # nothing but the spaces changes
        self.by_word = self.normalised and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id_of)
        self.keep = keep
        self.words: dict[str, bytes] = {}  # by word without the space before it
        self.older: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        surface = lambda i: b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else bytes([self.byte.index(i)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode()
        self.surface = [surface(i) for i in ids]
        self.is_byte = [model.is_byte(i) for i in ids]
        self.silent = [model.is_control(i) for i in ids]
        self.silent_ids = {i for i in ids if self.silent[i]}
        #: Only a piece that starts with the space sign loses it at the start of a text.
        self.leads = [not model.is_unknown(i) and not model.is_byte(i) and model.id_to_piece(i).startswith(SPACE) for i in ids]
        self.fresh: list[tuple[str, int, list[int]]] = []
        self.line_feed = self._ids("\n")
        #: Ids of a line feed at the start of a text, which the library puts a space before.
        self.line_start = len(self._ids(SPACE)) // 4 + len(self.line_feed) // 4
        # User-defined pieces have the score 0; any other kind of model shows in the ids of ordinary text.
        odd = [p for p, x in self.cost.items() if x == 0.0 and len(p) > 1] + ["An ordinary line of text, to tell the kind of model."]
        if any(np.frombuffer(self.encode(f"x{p}x"), np.int32).tolist() != model.encode(f"x{p}x") for p in odd):
            raise ValueError("not a plain BPE model")
        self.check_fresh()
        self.strips = model.decode([self.id_of[SPACE]]) == "" if SPACE in self.id_of else False

    @staticmethod
    def _spaced(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def agenda(self, s: str) -> list[str]:
        """The symbols of ``s`` (spaces written as the model does) after all merges."""
        part = list(s)
        return part if len(part) < 2 else self._short(part) if len(part) <= SHORT else self._long(part)

    def _short(self, part: list[str]) -> list[str]:
        """The agenda as the list of the scores of neighbouring pairs: the best, of equals the leftmost, comes next."""
        cost = self.cost.get
        agenda = [cost(x + y, NEVER) for x, y in zip(part, part[1:])]
        while True:
            best = min(agenda)
            if best == NEVER:
                return part
            i = agenda.index(best)
            merged = part[i] = part[i] + part.pop(i + 1)
            del agenda[i]
            if not agenda:
                return part
            if i:
                agenda[i - 1] = cost(part[i - 1] + merged, NEVER)
            if i < len(agenda):
                agenda[i] = cost(merged + part[i + 1], NEVER)

    def _long(self, part: list[str]) -> list[str]:
        """The agenda as a heap; entries whose symbols have changed since are skipped."""
        cost = self.cost.get
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost(part[i] + part[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, a, b, size = heappop(heap)
            x, y = part[a], part[b]
            if not x or not y or len(x) + len(y) != size or right[a] != b:
                continue
            merged = part[a] = x + y
            part[b] = ""
            after = right[a] = right[b]
            if after < n:
                left[after] = a
                if (c := cost(merged + part[after])) is not None:
                    heappush(heap, (c, a, after, size + len(part[after])))
            before = left[a]
            if before >= 0 and (c := cost(part[before] + merged)) is not None:
                heappush(heap, (c, before, a, size + len(part[before])))
        return [p for p in part if p]

    def _ids(self, s: str, as_text: str | None = None, skip: int = 0) -> bytes:
        """The ids of a stretch. Encoded by the library, ``as_text`` gives the same ids after its first ``skip``."""
        parts, id_of = self.agenda(s), self.id_of
        try:
            out = [id_of[p] for p in parts]
        except KeyError:
            out = []
            for p in parts:
                i = id_of.get(p)
                if i is not None:
                    out.append(i)
                elif self.unknown is None:
                    out += [self.byte[b] for b in p.encode()]
                elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one piece
                    out.append(self.unknown)
        if as_text is not None:
            self.fresh.append((as_text, skip, out))
        return array("i", out).tobytes()

    def check_fresh(self) -> int:
        """Compare what was encoded anew since the last call with the library, in one call to it; the number of stretches. Words are apart in
        both (see ``by_word``), so a text's ids agree when those of its words do."""
        fresh, self.fresh = self.fresh, []
        for (text, skip, got), want in zip(fresh, self.library.encode([t for t, _, _ in fresh], num_threads=1) if fresh else (), strict=True):
            if got != want[skip:]:
                raise ValueError(f"the library encodes {text!r} differently")
        return len(fresh)

    def _word(self, w: str) -> bytes:
        """The ids of a word and the space before it."""
        got = self.older.get(w) or self._ids(SPACE + w, w)
        if len(w) <= LONGEST_KEPT:
            if len(self.words) >= self.keep:
                self.older = dict(self.words)
                self.words.clear()
            self.words[w] = got
        return got

    def _first(self, w: str) -> bytes:
        """The ids of a word that starts a line."""
        got = self._ids(w, "\n" + w, self.line_start)
        if len(w) <= LONGEST_KEPT:
            if len(self.firsts) >= self.keep // 4:
                self.firsts.clear()
            self.firsts[w] = got
        return got

    def _unit(self, s: str) -> bytes:
        """The ids of a run of spaces, alone or with the word behind it."""
        got = self.units.get(s) or self._ids(s, s.replace(SPACE, " ")[1:] or None)
        if len(s) <= LONGEST_KEPT:
            if len(self.units) >= self.keep // 4:
                self.units.clear()
            self.units[s] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit integers."""
        if not text:
            return b""
        if not self.by_word:
            return self._ids(self._spaced(text) if self.normalised else self.library.normalize(text), text)
        out, word = [], self._word
        get = self.words.get
        for k, line in enumerate(text.replace(SPACE, " ").split("\n")):
            if k:
                out.append(self.line_feed)
            elif not line:
                out.append(self._unit(SPACE))  # the space before the text stands alone
                continue
            else:
                line = " " + line
            words = line.split(" ")
            first = words[0]
            if first:
                out.append(self.firsts.get(first) or self._first(first))
            del words[0]
            if "" not in words:
                out += [get(w) or word(w) for w in words]
                continue
            spaces = 0
            for w in words:
                if not w:
                    spaces += 1
                elif spaces:
                    out.append(self._unit(SPACE * (spaces + 1) + w))
                    spaces = 0
                else:
                    out.append(get(w) or word(w))
            if spaces:
                out.append(self._unit(SPACE * spaces))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any sequence of ids."""
        surface, at = self.surface, 0
        while at < len(ids) and self.silent[ids[at]]:
            at += 1
        raw = b"".join([surface[i] for i in ids])
        if self.strips and at < len(ids) and self.leads[ids[at]]:
            raw = raw[1:]
            strip = at
        else:
            strip = -1
        if self.silent_ids.isdisjoint(ids):  # a control piece ends a run of byte pieces
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        out, run = [], bytearray()
        for k, i in enumerate(ids):
            if self.is_byte[i]:
                run += surface[i]
                continue
            out.append(_run_text(run))
            run.clear()
            out.append(surface[i].decode()[1 if k == strip else 0 :])
        out.append(_run_text(run))
        return "".join(out)


def _run_text(run: bytearray) -> str:
    """A run of byte pieces as text; each byte at which no valid character starts becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        lead = run[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(bytes(run[at : at + n]).decode())
            at += n
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec a worker process; its tables outlive a task."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def _rows(model_file: str, check: str | None, decode: bool, batch_rows: int, schema: pa.Schema):
    def run(batches):
        c = codec(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                texts = part.column(1).to_pylist()
                found = [c.encode(t) for t in texts]
                if check:
                    c.check_fresh()
                else:
                    c.fresh.clear()
                ends = np.cumsum([0, *[len(x) // 4 for x in found]])
                values = np.frombuffer(b"".join(found), dtype=np.int32)
                cols = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))]
                if decode:
                    cols.append(pa.array([c.decode(x.tolist()) for x in np.split(values, ends[1:-1])] if texts else [], pa.string()))
                if check == "texts":
                    want = c.library.encode(texts, num_threads=1)
                    cols.append(pa.array([w == x.tolist() and c.library.decode(w) == c.decode(w) for w, x in zip(want, np.split(values, ends[1:-1]), strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", check: str | None = "words", decode: bool = False, batch_rows: int = 128) -> DataFrame:
    """One row per document: doc_id, ids, with ``decode`` decoded (the text of the ids).

    With ``check`` 'words' every word that is not in a worker's tables yet is also encoded by the library, in one call for an Arrow batch, and a difference
    fails the job. With 'texts' whole texts are compared as well, and agrees tells whether the library gives the same ids and, from them, the same text."""
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("decoded", pa.string())] * decode + [("agrees", pa.bool_())] * (check == "texts")
    kinds = "doc_id long, ids array<int>" + ", decoded string" * decode + ", agrees boolean" * (check == "texts")
    return id_text(docs, id_col, text_col).mapInArrow(_rows(model_file, check, decode, batch_rows, pa.schema(fields)), kinds)


def decode_ids(encoded: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with a further column: the text of its ids (null: the empty text)."""
    from pyspark.sql.pandas.functions import arrow_udf

    def run(ids: pa.Array) -> pa.Array:
        c = codec(model_file)
        return pa.array([c.decode(x.values.tolist()) if x.is_valid else "" for x in ids], pa.string())

    # The annotations are strings in this module, so the types are given in full here.
    run.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return encoded.withColumn(text_col, arrow_udf(run, "string")(F.col(ids_col)))


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
