"""Sentencepiece encoding, the filter audit and the Merkle manifest against the library and plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import filter_audit, manifest, pieces, queries
from millrace.llm.common import intermediates, saved

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WIDE = "doc_id long, text string, source string, lang string, n_chars long, mask string, f string, h string, tree string, rank string, part string, at string, n string, ids string"


def wide(spark, rows):
    """Rows of documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, s, g, n, *["x"] * 9) for d, t, s, g, n in rows], WIDE)


# --- sentencepiece


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), dtype=np.int32).tolist()


SCRAPS = ["▁", " ", "  ", "     ", "\n", "\t", "a", "the", "ing", "é", "é", "我们", "\U0001f600", "\x00", "<s>", "</s>", "<0x0A>", "<unk>", "�", "\xa0", "ﬁ", "12", "Straße", "аб"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(SCRAPS), st.text(max_size=6).filter(lambda t: t.isprintable())), max_size=30))
def test_ids_and_text_as_the_library(scraps):
    c, text = pieces.codec(MODEL), "".join(scraps)
    ids = ids_of(c, text)
    assert ids == c.library.encode(text)
    assert c.decode(ids) == c.library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999), st.sampled_from([28705, 259, 0, 1, 2])), max_size=20))
def test_any_ids_decode_as_in_the_library(ids):
    c = pieces.codec(MODEL)
    assert c.decode(ids) == c.library.decode(ids)


@pytest.mark.parametrize("text", [" " * 60_001 + "x", "\n" * 50_000, "a" * 70_000, "我们" * 30_000, "ab " * 50_000 + "   ", " " * 37, "𝔘" * 9000])
def test_very_long_words_and_white_space(text):
    c = pieces.codec(MODEL)
    assert ids_of(c, text) == c.library.encode(text) and c.decode(ids_of(c, text)) == text


def test_tables_are_bounded_and_forgetting_changes_nothing():
    c, rng = pieces.PieceCodec(MODEL, keep=50), random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(0, 7))) for _ in range(30)) + "\n" + str(rng.random())
        assert ids_of(c, text) == c.library.encode(text)
    assert len(c.words) <= 50 and len(c.older) <= 50 and len(c.firsts) <= 13 and len(c.units) <= 13


def test_a_difference_from_the_library_is_found():
    c = pieces.PieceCodec(MODEL)
    c.encode("plain words\nand  more")
    assert c.check_fresh() >= 4 and c.check_fresh() == 0
    c.words["broken"] = c._ids("▁broken", "brokem")
    with pytest.raises(ValueError, match="brokem"):
        c.check_fresh()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(SCRAPS), max_size=60))
def test_list_and_heap_agree(scraps):
    c, part = pieces.codec(MODEL), list("".join(scraps).replace(" ", "▁"))
    if len(part) > 1:
        assert c._short(part[:]) == c._long(part[:])


def test_whole_texts_where_words_are_not_apart():
    c = pieces.PieceCodec(MODEL)
    c.by_word = False
    rng = random.Random(4)
    for _ in range(100):
        text = "".join(rng.choice(SCRAPS) for _ in range(40))
        assert ids_of(c, text) == c.library.encode(text)


def test_encode_texts_rows(spark):
    rows = [(1, "A text"), (1, "another  text "), (None, "A text"), (2, None), (3, ""), (4, " lead"), (5, "é" * 3000)]
    df = wide(spark, [(d, t, None, None, 0) for d, t in rows])
    lib = pieces.codec(MODEL).library
    got = pieces.encode_texts(df, MODEL, check="texts", decode=True).collect()
    want = sorted((str(d), lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for d, t in rows)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == want and all(r.agrees for r in got)
    assert pieces.encode_texts(df.limit(0), MODEL, decode=True).count() == 0
    again = pieces.decode_ids(pieces.encode_texts(df, MODEL), MODEL).collect()
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in again) == want
    part = spark.createDataFrame([([28705, 229],), (None,), ([],)], "ids array<int>")
    assert sorted(r.t for r in pieces.decode_ids(part, MODEL, text_col="t").collect()) == ["", "", lib.decode([28705, 229])]


def test_op11_digests(spark):
    lib = pieces.codec(MODEL).library
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = lib.encode(d.text or "")
        want[d.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op11_sentencepiece"](spark, SF).collect()}
    assert got == want


# --- filter audit


def audit(rows, labels):
    """The report by running every order over every row."""
    fails, parts = [], sorted({s or "" for *_, s, _ in rows})
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    rank = lambda d: (d is None, d or 0)
    for d, text, s, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if any((u or "") == t and rank(e) < rank(d) for e, u, *_ in rows) else set()
        fails.append((s or "", f, d in good, d in toxic))
    out = {}
    for p in parts:
        mine = [x for x in fails if x[0] == p]
        share = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[f] += len(gone)
                failing = sum(f in x[1] for x in mine)
                out[p, "".join(order), k + 1] = [len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (q, order, k), row in out.items():
            if q == p:
                row.append(share[order[k - 1]])
    return out


def reported(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def audit_rows(seed, n):
    rng = random.Random(seed)
    hot = " ".join(f"h{i}" for i in range(250))
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        words = [rng.choice(["Aa", "b", "c#", "Z", "e"]) if kind == 1 else f"w{rng.randrange(2000)}" for _ in range(rng.choice([0, 1, 199, 200, 230]))]
        text = hot if kind < 2 else None if kind == 2 and rng.random() < 0.3 else rng.choice([" ", "\t", "\x0b", " "]).join(words)
        rows.append((rng.choice([None, rng.randrange(n), i, i]), text, rng.choice([None, "", "web", "hot", "hot"]), None))
    return rows


@pytest.mark.parametrize("parts", [1, 8, 61])
def test_audit_against_plain_orders(spark, parts):
    rows = audit_rows(parts, 240)
    rng = random.Random(parts)
    labels = [(rng.choice([None, *range(240)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)]
    df = wide(spark, [(d, t, s, None, 0) for d, t, s, _ in rows]).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = reported(filter_audit.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == audit(rows, labels)


def test_texts_that_share_a_fingerprint(spark, monkeypatch):
    """With one fingerprint for all texts the order by text alone tells them apart, over every border."""
    monkeypatch.setattr(filter_audit, "fingerprint", lambda text: F.lit(b"\0"))
    rows = audit_rows(5, 200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = reported(filter_audit.filter_audit(wide(spark, [(d, t, s, None, 0) for d, t, s, _ in rows]), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == audit(rows, [])


def test_audit_of_an_empty_table(spark):
    assert filter_audit.filter_audit(wide(spark, []), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


# --- manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tower(hs):
    """Levels of a tree."""
    out = [hs]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps(levels, i):
    found = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        found.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return found


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, s, g, n: sha("".join(map(enc, (d, s, g, n, t))))
    low = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m.group().lower(), t)
    langs = defaultdict(list)
    for d, t, s, g, n in rows:
        tampered = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        langs[g].append((d, leaf(d, t, s, g, n), leaf(d, low(t) if tampered else t, s, g, n)))
    names = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tower([h for _, h, _ in sorted(langs[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]) for g in names}
    top = tower([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (d, h, changed) in enumerate(sorted(langs[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
            proof = steps(trees[g], i) + steps(top, k)
            at = changed
            for left, right in proof:
                at = sha(left + at + right)
            out.append((str(d), h, trees[g][-1][0], top[-1][0], sha("".join(x + y for x, y in proof)), at, at == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("n,langs", [(1, 1), (2, 2), (8, 1), (9, 1), (65, 1), (300, 1), (90, 9), (700, 12)])
def test_manifest_against_a_plain_tree(spark, tmp_path, n, langs):
    rng = random.Random(n + langs)
    names = [None, "", "é", "zh", "Z", *[f"l{i}" for i in range(langs)]][:langs] if langs > 1 else ["en"]
    rows = [(rng.choice([None, i, i, i, rng.randrange(n)]), rng.choice([None, "", "Text ABC É", f"Row {i}", "same"]), rng.choice([None, "s", "1:"]), names[0] if rng.random() < 0.3 else rng.choice(names), rng.choice([None, i])) for i in range(n)]
    rows += rows[:5]
    wide(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_merkle"](spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == plain_manifest(rows)


def test_manifest_of_an_empty_table(spark, tmp_path):
    wide(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op13_merkle"](spark, str(tmp_path)).count() == 0


def test_intermediates_are_deleted(spark, tmp_path):
    import os

    with intermediates(spark) as made:
        manifest.merkle_manifest(wide(spark, [(i, "t", "s", "en", 1) for i in range(20)])).write.parquet(f"{tmp_path}/out")
        left = [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert made and left and not any(os.path.exists(p.removeprefix("file:")) for p in made)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    kept = saved(spark.range(3), "outside")
    assert kept.count() == 3
