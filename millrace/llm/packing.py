"""Best-fit packing with certified bounds.

Each document becomes its token ids and an end id. Documents longer than a sequence are cut into pieces of the
full length, the remainder first; only they are cut. Pieces are dealt into partitions of bounded size, and every
partition packs its own by best-fit decreasing. Dual-feasible functions give a lower bound on the bins a
partition needs: a partition that meets its bound is certified. Partitions with a gap release all bins that are not full, certified ones only their
emptiest; the released pieces are dealt anew with
those of other partitions and packed again, as long as that saves sequences. What a round doesn't release is final.

A partition holds only lengths, checksums and ids, at most about ``partition_rows`` rows; texts are tokenized where they are
read and never shuffled. Results of a round are written to the shared folder.

Defined cases: a null text is empty and becomes the end id alone; rows that repeat an id are packed each by itself; null ids are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, drop_saved, id_text, partitions, saved

LENGTH = 2048
END_ID = 0
#: How byte-level BPE with the usual pattern cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WHITE_RUN = 10_000
_WHITE = re.compile(r"\s{%d}" % WHITE_RUN)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the letters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class IdEncoder:
    """Ids of whole texts as the ``tokenizers`` library gives them, as little-endian 32-bit integers.

    For a byte-level BPE with the usual pattern and merges in the order of their ids, the vocabulary is handed to tiktoken,
    which computes the same ids in a third of the time (tests compare the two over all kinds of code points). Texts that hold the string
    of a special token or a very long run of white space (on which the other library's pattern gives up), and all texts under any other tokenizer, are encoded
    by ``tokenizers`` itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.fast = self._same_in_tiktoken(spec)

    @staticmethod
    def _same_in_tiktoken(spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if spec.get("normalizer") or not usual or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab.get(a + b, -1) for a, b in merges]
        if made != sorted(made) or len(set(made)) != len(made) or made and made[0] < 256:
            return None
        import tiktoken

        byte = _byte_of_letter()
        ranks, made_ids = {}, set(made)
        for token, i in vocab.items():
            if i in made_ids or len(token) == 1:
                ranks[bytes(byte[c] for c in token)] = i
        if len(ranks) != 256 + len(made):
            return None
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [self.fast is None or any(s in t for s in self.special) or (len(t) >= WHITE_RUN and _WHITE.search(t) is not None) for t in texts]
        slow = iter(self.tokenizer.encode_batch_fast([t for t, w in zip(texts, whole, strict=True) if w], add_special_tokens=False)) if any(whole) else None
        return [array("I", next(slow).ids if w else self.fast.encode_ordinary(t)).tobytes() for t, w in zip(texts, whole, strict=True)]


_ENCODERS: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_FIELDS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces_of(ids: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of a document's ids; the first piece takes the remainder."""
    n = len(ids) // 4
    first = n % length or min(n, length)
    out, at, size = [], 0, first
    while at < n:
        out.append((len(out), at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
        at, size = at + size, length
    return out


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """All pieces of all documents (doc_id, text)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        e = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(d, *p) for d, ids in zip(part.column(0).to_pylist(), e.encode(part.column(1).to_pylist()), strict=True) for p in pieces_of(ids + end, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE_FIELDS, strict=True)], schema=_PIECE_FIELDS)

    return docs.mapInArrow(run, _PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size, by best-fit decreasing. Open bins are kept by the room left in them."""
    bins = np.empty(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, made = made, capacity, made + 1
        bins[i] = b
        if room > s:
            by_room[room - s].append(b)
            rooms |= 1 << (room - s)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins from two families of dual-feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    total = int((count * size).sum())
    best = -(-total // capacity)
    n_up, mass_up = np.cumsum(count[::-1])[::-1], np.cumsum((count * size)[::-1])[::-1]
    cut = np.arange(1, capacity // 2 + 1)  # sizes over capacity - cut count as whole bins, those under cut as nothing
    large = n_up[capacity - cut + 1] if capacity else 0
    middle = mass_up[cut] - mass_up[capacity - cut + 1]
    best = max(best, int(np.max(large + -(-middle // capacity))))
    for k in range(1, 51):  # rounded functions: x stays where (k + 1) x is whole, else floor((k + 1) x) / k
        whole, rest = np.divmod((k + 1) * size, capacity)
        value = np.where(rest == 0, size * k, whole * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


_PACKED = _PIECES + ", bin long, offset long, gap long, open boolean"


def _pack_partition(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].to_numpy(dtype=np.int64)
        bins = best_fit(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        gap = len(fill) - lower_bound(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        offset = np.empty(len(sizes), dtype=np.int64)
        offset[order] = ends - sizes[order] - (np.cumsum(fill) - fill)[bins[order]]
        released = (fill < capacity) if gap > 0 else (fill < capacity * 3 // 4)
        base = int(pdf["part"].iloc[0]) << 32
        return pdf.drop(columns="part").assign(bin=bins + base, offset=offset, gap=gap, open=released[bins])

    return run


def pack(pieces: DataFrame, capacity: int = LENGTH, partition_rows: int = 50_000, rounds: int = 8) -> DataFrame:
    """Pieces with sequence_id, offset and gap: by how many sequences the partition that packed the piece may lie over its lower bound
    (0: certified). Rounds go on while the released pieces get fewer sequences than they had; ``rounds`` bounds their number."""
    spark = pieces.sparkSession
    rest, final, before, kept = pieces, None, None, None
    for r in range(rounds):
        n = rest.count()
        if not n and r:
            break
        # Later rounds deal into fewer, fuller partitions, so that the released pieces meet others.
        parts = max(math.ceil(n / partition_rows), 1 if r else partitions(spark))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(r)), F.lit(parts)))
        packed = dealt.groupBy("part").applyInPandas(_pack_partition(capacity), _PACKED)
        packed = saved(packed.withColumn("sequence_id", (F.lit(r).cast("long") * F.lit(1 << 56)) + F.col("bin")), f"pack{r}")
        used = packed.agg(F.count_distinct("sequence_id").alias("all"), F.count_distinct(F.when(F.col("open"), F.col("sequence_id"))).alias("open")).first()
        if before is not None and used.all >= before:  # no gain: what the round before did with these pieces stays
            final = kept if final is None else final.unionByName(kept)
            drop_saved(packed)
            kept = None
            break
        done = packed.filter(~F.col("open"))
        final = done if final is None else final.unionByName(done)
        kept, before = packed.filter("open"), used.open
        rest = kept.select(*pieces.columns)
    if kept is not None:
        final = final.unionByName(kept)
    return final.select(*pieces.columns, "sequence_id", "offset", "gap")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap."""
    return pack(saved(token_pieces(id_text(docs, id_col, text_col), tokenizer, length, end_id), "pieces"), length)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
